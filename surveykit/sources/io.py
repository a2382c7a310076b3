"""Reading and writing survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..functions.nulls import to_int, to_number

RINGS = T.StructType([
    T.StructField("cell", T.StringType()),
    T.StructField("ring", T.ArrayType(T.StructType([
        T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    ]))),
])


def read_observations(spark: SparkSession, path: str, schema: T.StructType = S.OBSERVATION) -> DataFrame:
    """CSV with a header; ``NA`` is null. The header is checked against the schema."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "NA")
    return reader.option("enforceSchema", False).csv(path)


def read_whitespace(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Text with columns parted by white space and a header line in every file; ``NA`` is null."""
    names = [f.name for f in schema.fields]
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "").select(parts.alias("p"))
    lines = lines.where(F.col("p") != F.array(*[F.lit(n) for n in names]))
    cols = []
    for k, field in enumerate(schema.fields):
        text = F.nullif(F.get(F.col("p"), F.lit(k)), F.lit("NA"))
        if isinstance(field.dataType, T.StringType):
            cols.append(text.alias(field.name))
        elif isinstance(field.dataType, T.IntegerType):
            cols.append(to_int(text).alias(field.name))
        else:
            cols.append(to_number(text).cast(field.dataType).alias(field.name))
    return lines.select(*cols)


def write_snapshot(df: DataFrame, path: str, year: str = S.YEAR) -> None:
    """One folder per survey year. Rebalancing keeps files near the target size even if one year dominates."""
    df.hint("rebalance", year).write.mode("overwrite").partitionBy(year).parquet(path)


def load_snapshot(spark: SparkSession, path: str, years: Sequence[int] | None = None, year: str = S.YEAR) -> DataFrame:
    """The landed collection; only the folders of the wanted years are read."""
    df = S.normalise_names(spark.read.parquet(path))
    return df if years is None else df.where(F.col(year).isin(list(years)))


def species_lookup(dim: DataFrame, name: str | None = None) -> DataFrame:
    """Code and English name, optionally of the names that contain a text, whatever its case."""
    out = dim.select("species_id", "english_name")
    return out if name is None else out.where(F.contains(F.lower("english_name"), F.lit(name.lower())))


def load_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Cells and their rings from Parquet, or from JSON lines if the path ends so."""
    reader = spark.read.schema(RINGS)
    return reader.json(path) if path.rstrip("/").endswith(".json") else reader.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Adds rows to a result table. Running it twice adds them twice; see :func:`replace_results`."""
    df.write.mode("append").parquet(path)


def replace_results(df: DataFrame, path: str, by: str = "species") -> None:
    """Writes the species in ``df`` and leaves the others; safe to repeat."""
    writer = df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


def read_named(spark: SparkSession, path: str, names: Sequence[str], types: Sequence[str] | None = None) -> DataFrame:
    """CSV without header, with the column names given."""
    types = types or ["string"] * len(names)
    ddl = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
    return spark.read.schema(ddl).option("nullValue", "NA").csv(path)


def write_by_species(df: DataFrame, path: str, species: str = S.SPECIES) -> None:
    """One folder per species."""
    df.hint("rebalance", species).write.mode("overwrite").option("header", True).partitionBy(species).csv(path)


def write_points(df: DataFrame, path: str) -> None:
    """Point layer with ``lon``, ``lat`` and ``srid``."""
    missing = {"lon", "lat", "srid"} - set(df.columns)
    if missing:
        raise ValueError(f"not a point layer, missing {sorted(missing)}")
    df.write.mode("overwrite").parquet(path)


def assert_roundtrip(df: DataFrame, path: str) -> None:
    """Reads a written layer back and fails unless it holds the same rows, as often."""
    back = df.sparkSession.read.parquet(path).select(*df.columns)
    if not df.exceptAll(back).isEmpty() or not back.exceptAll(df).isEmpty():
        raise AssertionError(f"{path} differs from what was written")
