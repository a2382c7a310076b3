"""Register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated function under ``name``, with ``sql`` as its equivalent if there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} exists already")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Columns rounded, because sums of doubles depend on the order of addition."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})


def integer(name: str, kind: str = "bigint") -> Column:
    return F.col(name).cast(kind).alias(name)
