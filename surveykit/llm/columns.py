"""Column names beside a table's own, compared as the session compares names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _folded(df: DataFrame):
    return str if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower


def others(df: DataFrame, *names: str) -> list[str]:
    """The table's columns, without those of the given names."""
    fold = _folded(df)
    given = {fold(n) for n in names}
    return [c for c in df.columns if fold(c) not in given]


def free(df: DataFrame, *stems: str) -> list[str]:
    """Names that the table does not have: the stems, with underscores behind those that it has."""
    fold = _folded(df)
    taken, out = {fold(c) for c in df.columns}, []
    for stem in stems:
        while fold(stem) in taken:
            stem += "_"
        taken.add(fold(stem))
        out.append(stem)
    return out
