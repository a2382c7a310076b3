"""The given tables seen as survey data, in Spark and as SQL.

``lineitem`` with its dimensions becomes observation records; ``events`` becomes repeated visits. Missing values
are created on purpose, because the given tables have none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import site_year_key, visit_label
from ..operators.clean import drop_sentinel
from ..operators.summaries import occurrence_table

_TABLES = {
    "orders": ("l_orderkey", "o_orderkey", ()),
    "customer": ("o_custkey", "c_custkey", ("orders",)),
    "nation": ("c_nationkey", "n_nationkey", ("orders", "customer")),
    "region": ("n_regionkey", "r_regionkey", ("orders", "customer", "nation")),
    "part": ("l_partkey", "p_partkey", ()),
}

_INTERVALS = {
    f"ObservationCount{k}": (
        f"nullif(cast((l_linenumber * {k} + cast(l_quantity as int)) % 7 as int), 6)", "", "int"
    )
    for k in range(2, 10)
}

#: Column -> (expression understood by both engines, table it needs besides ``lineitem``, type).
COLUMNS: dict[str, tuple[str, str, str]] = {
    "event_id": ("l_orderkey", "", "bigint"),
    "SamplingEventIdentifier": ("concat('EV-', cast(o_custkey as string), '-', cast(l_linenumber as string))", "orders", "string"),
    "RouteIdentifier": ("n_name", "nation", "string"),
    "SurveyAreaIdentifier": ("o_custkey", "orders", "bigint"),
    "ProtocolCode": ("o_orderpriority", "orders", "string"),
    "CollectorNumber": ("c_mktsegment", "customer", "string"),
    "CommonName": ("nullif(p_type, 'PROMO')", "part", "string"),
    "species_id": (
        "case when p_type <> 'PROMO' then ascii(substring(p_type, 1, 1)) * 100 + length(p_type) end", "part", "int"
    ),
    "subnational2_code": ("r_name", "region", "string"),
    "survey_year": ("year(o_orderdate)", "orders", "int"),
    "survey_month": ("month(o_orderdate)", "orders", "int"),
    "survey_day": ("day(o_orderdate)", "orders", "int"),
    "doy": ("dayofyear(o_orderdate)", "orders", "int"),
    "visit": ("l_linenumber", "", "int"),
    "period": ("case when l_linestatus = 'F' then 'am' else 'pm' end", "", "string"),
    "survey": ("case when o_orderstatus = 'P' then 'n' else 'y' end", "orders", "string"),
    "AllSpeciesReported": ("case when o_orderstatus = 'P' then 'No' else 'Yes' end", "orders", "string"),
    "ObservationCount": ("nullif(cast(l_quantity as int), 13)", "", "int"),
    "TimeObservationsStarted": (
        "cast(nullif(l_suppkey % 24, 3) as double) + cast(l_linenumber as double) / cast(8 as double)", "", "double"
    ),
    "latitude": ("cast(44 as double) + cast(o_custkey % 430 as double) / cast(100 as double)", "orders", "double"),
    "longitude": ("cast(-69 as double) + cast(o_custkey * 7 % 700 as double) / cast(100 as double)", "orders", "double"),
    **_INTERVALS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The wanted columns, joining only the tables they come from.

    Every key of ``lineitem`` exists in its dimension, so leaving a table out loses and adds no rows. The
    tables are joined without hints: Spark decides from their sizes.
    """
    needed: list[str] = []
    for col in cols:
        source = COLUMNS[col][1]
        if source:
            needed += [t for t in (*_TABLES[source][2], source) if t not in needed]

    def join(left: DataFrame, name: str) -> DataFrame:
        left_key, right_key, _ = _TABLES[name]
        return left.join(table(spark, sf_dir, name), F.col(left_key) == F.col(right_key))

    base = reduce(join, needed, table(spark, sf_dir, "lineitem"))
    return base.select(*[F.expr(f"cast({COLUMNS[c][0]} as {COLUMNS[c][2]})").alias(c) for c in cols])


def _sql_type(kind: str) -> str:
    return {"string": "varchar"}.get(kind, kind)


OBS_SQL = (
    "obs AS (SELECT "
    + ", ".join(
        f"CAST({expr} AS {kind}) AS {name}".replace("as string)", "as varchar)").replace("AS string)", "AS varchar)")
        for name, (expr, _, kind) in COLUMNS.items()
    )
    + " FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"
    " JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"
    " JOIN part p ON l.l_partkey = p.p_partkey)"
)


def on_obs(body: str, *ctes: str) -> str:
    """SQL over the observation view; ``ctes`` come between the view and the body."""
    return "WITH " + ", ".join([OBS_SQL, *ctes]) + " " + body


_VISITS = {
    "site_id": "cast(user_id % 25 as string)",
    "point_id": "cast(user_id as string)",
    "year": "cast(2011 + day(ts) % 13 as int)",
    "sample": "cast(hour(ts) % 3 + 1 as int)",
    "taxa_code": "case when event_type = 'error' then '(none)' else event_type end",
}

VISITS_SQL = "visits AS (SELECT " + ", ".join(
    f"{e.replace('as string', 'as varchar')} AS {n}" for n, e in _VISITS.items()
) + " FROM events)"


def frog_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with one species each; ``(none)`` stands for a visit without any."""
    return table(spark, sf_dir, "events").select(*[F.expr(e).alias(n) for n, e in _VISITS.items()])


OCCURRENCE_SQL = (
    "occurrence AS (SELECT DISTINCT concat(site_id, '-', point_id, '-', CAST(year AS VARCHAR)) AS \"M\", year AS year2,"
    " CASE WHEN sample = 1 THEN 'visit1' WHEN sample = 2 THEN 'visit2' ELSE 'visit3' END AS \"J\", taxa_code,"
    " 1 AS occurrence FROM visits WHERE taxa_code <> '(none)')"
)


def occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of a site and year on which a species was found."""
    visits = drop_sentinel(frog_visits(spark, sf_dir), "taxa_code", "(none)").select(
        site_year_key("site_id", "point_id", "year").alias("M"), F.col("year").alias("year2"),
        visit_label("sample").alias("J"), "taxa_code",
    )
    return occurrence_table(visits, ["M", "year2", "J", "taxa_code"])


COUNTS_SQL = (
    "site_visits AS (SELECT nullif(event_type, 'error') AS species, user_id AS site, CAST(day(ts) AS INT) AS day,"
    " CAST(hour(ts) % 4 + 1 AS INT) AS visit FROM events)"
)


def site_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single detections by species, site, day and visit 1..4."""
    return table(spark, sf_dir, "events").select(
        F.expr("nullif(event_type, 'error')").alias("species"),
        F.col("user_id").alias("site"),
        F.expr("cast(day(ts) as int)").alias("day"),
        F.expr("cast(hour(ts) % 4 + 1 as int)").alias("visit"),
    )


DRAWS_SQL = (
    "draws AS (SELECT l_returnflag AS param, l_linenumber AS idx, l_orderkey AS draw, l_extendedprice AS value"
    " FROM lineitem)"
)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price records as draws of a parameter by index."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("param"), F.col("l_linenumber").alias("idx"),
        F.col("l_orderkey").alias("draw"), F.col("l_extendedprice").alias("value"),
    )


INTERVALS_SQL = (
    "intervals AS (SELECT SurveyAreaIdentifier AS \"pointID\", doy AS jday, survey_year AS year, period,"
    " CommonName AS spcd, CAST(visit % 2 AS DOUBLE) AS min_d, CAST(visit % 2 + 1 AS DOUBLE) AS max_d,"
    " CAST((visit - 1) % 4 + 1 AS INT) AS interval_no, ObservationCount AS count FROM obs)"
)


def interval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(
        spark, sf_dir, "SurveyAreaIdentifier", "doy", "survey_year", "period", "CommonName", "visit", "ObservationCount"
    )
    v = F.col("visit")
    return obs.select(
        F.col("SurveyAreaIdentifier").alias("pointID"), F.col("doy").alias("jday"), F.col("survey_year").alias("year"),
        "period", F.col("CommonName").alias("spcd"), (v % 2).cast("double").alias("min_d"),
        (v % 2 + 1).cast("double").alias("max_d"), ((v - 1) % 4 + 1).cast("int").alias("interval"),
        F.col("ObservationCount").alias("count"),
    )


STOPS_SQL = (
    "stops AS (SELECT c_custkey AS \"pointID\", 44 + (c_custkey % 430) / 100.0 AS lat,"
    " CASE WHEN c_custkey % 5 = 0 THEN 'n' ELSE 'y' END AS survey FROM customer)"
)


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("pointID"), F.when(key % 5 == 0, "n").otherwise("y").alias("survey")
    )


REPLICATES_SQL = (
    "replicates AS (SELECT CAST(SurveyAreaIdentifier % 791 + 1 AS INT) AS site, CAST(survey_year - 1994 AS INT) AS year_idx, "
    + ", ".join(f"CAST(max(CASE WHEN (visit - 1) % 4 = {k - 1} THEN ObservationCount END) AS DOUBLE) AS r{k}" for k in range(1, 5))
    + " FROM obs GROUP BY 1, 2)"
)


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest count per site, year and replicate, replicates side by side; visit 5 is replicate 1 again."""
    obs = observations(spark, sf_dir, "SurveyAreaIdentifier", "survey_year", "visit", "ObservationCount")

    def rep(k: int) -> Column:
        mine = (F.col("visit") - 1) % 4 == k - 1
        return F.max(F.when(mine, F.col("ObservationCount"))).cast("double").alias(f"r{k}")

    return obs.groupBy(
        (F.col("SurveyAreaIdentifier") % 791 + 1).cast("int").alias("site"),
        (F.col("survey_year") - 1994).cast("int").alias("year_idx"),
    ).agg(*[rep(k) for k in range(1, 5)])
