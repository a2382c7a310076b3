"""Order-free fingerprints of tables, and layers that carry theirs beside them.

A fingerprint is the number of rows and two sums of 64-bit row hashes. It does not depend on the order of rows, changes
when a row changes, is missing or is doubled, and is one aggregation without a shuffle of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType)


@dataclass(frozen=True)
class Fingerprint:
    n: int
    a: int
    b: int

    @classmethod
    def of(cls, row: Row | dict) -> Fingerprint:
        return cls(*(int(row[c]) for c in ("n", "a", "b")))


def fingerprint_sums(df: DataFrame, leave: Sequence[str] = ()) -> list[Column]:
    """The aggregates ``n``, ``a``, ``b`` over all columns but those of ``leave``."""
    fields = [f for f in df.schema.fields if f.name not in leave]
    own = [F.col(f"`{f.name}`") for f in fields]
    # a hash passes over nulls, so it is told where they are; nested values are hashed as text for the same reason
    values = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(f.dataType, _NESTED) else c for c, f in zip(own, fields)]
    missing = F.array(*[c.isNull() for c in own]) if own else F.lit(0)

    def total(salt: int) -> Column:
        return F.coalesce(F.sum(F.xxhash64(F.lit(salt), missing, *values).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")

    return [F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")]


def fingerprint(df: DataFrame) -> Fingerprint:
    return Fingerprint.of(df.agg(*fingerprint_sums(df)).first())


def fingerprints(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, n, a, b``: a fingerprint of the other columns for each group."""
    return df.groupBy(*by).agg(*fingerprint_sums(df, by))


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}.fingerprint"


def write_layer(df: DataFrame, path: str) -> Fingerprint:
    """Writes the table and, beside it, the fingerprint of what was written, taken while writing."""
    seen = Observation()
    df.observe(seen, *fingerprint_sums(df)).write.mode("overwrite").parquet(path)
    found = Fingerprint.of(seen.get)
    numbers = [F.lit(str(getattr(found, c))).alias(c) for c in ("n", "a", "b")]
    df.sparkSession.range(1, numPartitions=1).select(*numbers).write.mode("overwrite").parquet(_beside(path))
    return found


def verify_layer(spark: SparkSession, path: str) -> Fingerprint:
    """Reads the layer once and fails unless it holds the rows that were written, as often."""
    wanted = Fingerprint.of(spark.read.parquet(_beside(path)).first())
    found = fingerprint(spark.read.parquet(path))
    if found != wanted:
        raise AssertionError(f"{path} differs from what was written: {found.n} rows, written {wanted.n}")
    return found
