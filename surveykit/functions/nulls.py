"""Column helpers whose handling of missing values differs from Spark's default."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def n_distinct(col: str | Column) -> Column:
    """Distinct count in which a missing value counts as one more value."""
    col = F.col(col) if isinstance(col, str) else col
    has_null = F.coalesce(F.max(F.when(col.isNull(), 1).otherwise(0)), F.lit(0))
    return F.count_distinct(col) + has_null.cast("bigint")


def sum_rm(col: str | Column) -> Column:
    """Sum over the non-missing values; 0 when there are none."""
    return F.coalesce(F.sum(col), F.lit(0))


def sum_na(col: str | Column) -> Column:
    """Sum that is missing as soon as one value is missing."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.sum(col))


def max_na(col: str | Column) -> Column:
    """Maximum that is missing as soon as one value is missing."""
    return F.when(F.count(col) == F.count(F.lit(1)), F.max(col))


#: Decimal numbers; keeps out texts such as ``3d`` that the JVM would read as a number.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(col: str | Column) -> Column:
    """Text to double; text that is no decimal number becomes null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.cast("string").rlike(_NUMBER), col.try_cast("double"))


def to_int(col: str | Column) -> Column:
    """Text to integer by way of double, so that ``'3.0'`` is 3 and ``'X'`` is null."""
    return to_number(col).try_cast("int")


def standard_error(col: str | Column) -> Column:
    """Sample standard deviation over the root of the row count."""
    return F.stddev_samp(col) / F.sqrt(F.count(F.lit(1)))
