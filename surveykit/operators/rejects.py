"""Checks with two outputs: the rows that pass, and those that do not, with rule and reason.

All rules are evaluated in one pass, whose result is stored once; both outputs read it. A bad value so costs its own row
and not the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from .joins import null_safe_join
from .newton import durable
from .spatial import points

_BROKEN, _LINE = "__broken", "__line"


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for rows that are to be rejected; null, like false, lets a row pass."""

    name: str
    reason: str
    broken: Column


@dataclass(frozen=True)
class Checked:
    """``accepted`` has the table's columns; ``rejected`` has further ``rule`` and ``reason`` (of the first rule broken) and ``rules``."""

    accepted: DataFrame
    rejected: DataFrame

    def counts(self) -> DataFrame:
        """``rule, n``: rows that break each rule; a row that breaks several counts for each."""
        return self.rejected.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def checked(df: DataFrame, rules: Sequence[Rule]) -> Checked:
    """Splits the rows by the rules. Every row is in exactly one output; repeated rows stay repeated."""
    if not rules:
        raise ValueError("there must be a rule")
    broken = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    stored = durable(df.withColumn(_BROKEN, broken))
    first = F.get(_BROKEN, F.lit(0))
    reason = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.reason)]), first)
    fine = F.size(_BROKEN) == 0
    return Checked(
        stored.where(fine).select(*df.columns),
        stored.where(~fine).select(*df.columns, first.alias("rule"), reason.alias("reason"), F.col(_BROKEN).alias("rules")))


def repeated(df: DataFrame, keys: Sequence[str], name: str = "repeated", reason: str = "several rows share this key") -> tuple[DataFrame, Rule]:
    """The rows with the size of their key's group, and the rule that rejects groups of more than one row."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    return null_safe_join(df, sizes, list(keys)), Rule(name, reason, F.col("__size") > 1)


def unique_rows(df: DataFrame, keys: Sequence[str]) -> Checked:
    """Accepts rows whose key occurs once; all rows of a repeated key are rejected, since none is known to be right."""
    sized, rule = repeated(df, keys)
    out = checked(sized, [rule])
    return Checked(out.accepted.drop("__size"), out.rejected.drop("__size"))


def location_rules(lon: str = S.LON, lat: str = S.LAT) -> list[Rule]:
    x, y = F.col(lon), F.col(lat)
    return [
        Rule("no_location", "longitude or latitude is missing", x.isNull() | y.isNull()),
        Rule("latitude", "latitude beyond 90 degrees: longitude and latitude are probably swapped", F.isnan(y) | (F.abs(y) > 90)),
        Rule("longitude", "longitude beyond 180 degrees", F.isnan(x) | (F.abs(x) > 180)),
    ]


def points_checked(df: DataFrame, lon: str = S.LON, lat: str = S.LAT, srid: int = 4326) -> Checked:
    """Like :func:`operators.spatial.points`, but bad locations are rejected one by one instead of ending the job."""
    out = checked(df, location_rules(lon, lat))
    return Checked(points(out.accepted, lon, lat, srid), out.rejected)


def count_rules(count: str = S.COUNT, most: float | None = None) -> list[Rule]:
    """Counts must be whole and not negative, and not above ``most`` if that is given; missing counts pass."""
    c = F.col(count)
    rules = [Rule("negative", "a count below 0", c < 0), Rule("fraction", "a count that is no whole number", c != F.floor(c))]
    return rules + ([Rule("too_many", f"a count above {most}", c > F.lit(most))] if most is not None else [])


def read_checked(spark: SparkSession, path: str, schema: T.StructType = S.OBSERVATION, rules: Sequence[Rule] = ()) -> Checked:
    """CSV with a header; lines that do not fit the schema are rejected as ``unreadable``, with the line as reason.

    ``NA`` is null. The header is checked against the schema. Further rules apply to the lines that could be read.
    """
    lines = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType())])
    reader = spark.read.schema(lines).option("header", True).option("nullValue", "NA").option("mode", "PERMISSIVE")
    read = reader.option("columnNameOfCorruptRecord", _LINE).option("enforceSchema", False).csv(path)
    fits = F.col(_LINE).isNull()
    out = checked(read, [Rule("unreadable", "", ~fits), *[Rule(r.name, r.reason, fits & r.broken) for r in rules]])
    rejected = out.rejected.withColumn("reason", F.coalesce(_LINE, "reason")).drop(_LINE)
    return Checked(out.accepted.drop(_LINE), rejected)
