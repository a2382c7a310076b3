"""Yearly snapshots that are landed in steps: only changed years are written, and readers see whole states.

A snapshot is a folder with ``data/snapshot__version=<n>-<id>/<year column>=<year>`` and ``manifests/<n>.json``. A manifest
lists, for each year, the folder that holds it and the fingerprint of its rows. A writer compares the fingerprints of the
new table with those of the last manifest, writes the years that differ into a folder of its own, reads them back, and only then
publishes the next manifest under a name that must not exist yet. So a writer that dies leaves the old state, and
of two writers at the same time one fails. The driver handles a line per year.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from .fingerprint import Fingerprint, fingerprints

VERSION = "snapshot__version"
_NO_YEAR = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Manifest:
    """State ``number`` of a snapshot: its columns, and folder and fingerprint of each year."""

    number: int
    schema: T.StructType
    years: dict[int | None, tuple[str, Fingerprint]]

    def text(self) -> str:
        years = [{"year": y, "folder": f, "n": str(p.n), "a": str(p.a), "b": str(p.b)} for y, (f, p) in self.years.items()]
        return json.dumps({"schema": self.schema.jsonValue(), "years": years})

    @classmethod
    def read(cls, number: int, text: str) -> Manifest:
        held = json.loads(text)
        return cls(number, T.StructType.fromJson(held["schema"]), {y["year"]: (y["folder"], Fingerprint.of(y)) for y in held["years"]})


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, system = _path(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published states, ascending."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifests") if re.fullmatch(r"\d{9}\.json", n))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> Manifest | None:
    """A state, by default the last one; None if nothing was published."""
    known = manifests(spark, path)
    if number is not None and number not in known:
        raise ValueError(f"{path} has no state {number}")
    if not known:
        return None
    number = known[-1] if number is None else number
    return Manifest.read(number, spark.read.text(f"{path}/manifests/{number:09}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, state: Manifest) -> None:
    """Makes a state the last one, in one step; fails if another writer has taken its number."""
    draft, system = _path(spark, f"{path}/manifests/.draft-{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(state.text(), "utf-8"))
    out.close()
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    final, _ = _path(spark, f"{path}/manifests/{state.number:09}.json")
    context = hadoop.FileContext.getFileContext(system.makeQualified(draft).toUri(), spark._jsc.hadoopConfiguration())
    # without options a rename never replaces a file
    context.rename(system.makeQualified(draft), system.makeQualified(final), gateway.new_array(getattr(hadoop, "Options$Rename"), 0))


def read_snapshot(spark: SparkSession, path: str, years: Sequence[int] | None = None, number: int | None = None) -> DataFrame:
    """The rows of a state, by default the last; only the folders of the wanted years are read."""
    state = manifest(spark, path, number)
    if state is None:
        raise ValueError(f"nothing was published in {path}")
    folders = [f"{path}/{folder}" for year, (folder, _) in state.years.items() if years is None or year in years]
    if not folders:
        return spark.createDataFrame([], state.schema)
    rows = spark.read.schema(state.schema).option("basePath", f"{path}/data").parquet(*folders)
    return rows.select(*state.schema.names)


def changed_years(df: DataFrame, state: Manifest | None, year: str = S.YEAR) -> dict[int | None, Fingerprint]:
    """Years of the table that the state lacks or holds with other rows, with their new fingerprints."""
    held = {y: p for y, (_, p) in state.years.items()} if state else {}
    new = {r[year]: Fingerprint.of(r) for r in fingerprints(df, [year]).collect()}
    return {y: p for y, p in new.items() if held.get(y) != p}


def write_changes(df: DataFrame, path: str, year: str = S.YEAR, complete: bool = False) -> Manifest:
    """Publishes the table's years and returns the new state; without a change nothing is written.

    Years that the table does not hold stay as they are, or go if the table is ``complete``. The year must be an
    integer; rows without one are a part of their own. The table is read once for the fingerprints, and once more for
    the changed years only; if it has changed between, the run fails and nothing is published.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if VERSION in (c.lower() for c in df.columns):
        raise ValueError(f"a column may not be called {VERSION}")
    before = manifest(spark, path)
    schema = T.StructType([f for f in df.schema.fields if f.name != year] + [T.StructField(year, df.schema[year].dataType)])
    df = df.select(*schema.names)
    changed = changed_years(df, before, year)
    years = dict(before.years) if before else {}
    if complete:
        kept = {r[year] for r in df.select(year).distinct().collect()}
        years = {y: f for y, f in years.items() if y in kept}
    if before and not changed and years == before.years and schema == before.schema:
        return before
    number = before.number + 1 if before else 1
    if changed:
        own = f"data/{VERSION}={number:09}-{uuid.uuid4().hex[:8]}"
        wanted = F.col(year).isin([y for y in changed if y is not None])
        rows = df.where(wanted | F.col(year).isNull() if None in changed else wanted)
        rows.hint("rebalance", year).write.partitionBy(year).parquet(f"{path}/{own}")
        written = spark.read.schema(schema).parquet(f"{path}/{own}").select(*schema.names)
        if {r[year]: Fingerprint.of(r) for r in fingerprints(written, [year]).collect()} != changed:
            raise RuntimeError("the table has changed while it was written; nothing is published")
        years |= {y: (f"{own}/{year}={_NO_YEAR if y is None else y}", p) for y, p in changed.items()}
    state = Manifest(number, schema, years)
    publish(spark, path, state)
    return state


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all but the last ``keep`` states and the folders that only older or failed writers used.

    Folders of a writer that may still run, whose number is above the last state's, stay. Returns what was removed.
    """
    if keep < 1:
        raise ValueError("at least one state must stay")
    known, gone = manifests(spark, path), []
    states = [manifest(spark, path, n) for n in known[-keep:]]
    used = {folder.split("/")[1] for s in states for folder, _ in s.years.values()}
    for name in _names(spark, f"{path}/data"):
        number = re.fullmatch(rf"{VERSION}=(\d{{9}})-[0-9a-f]{{8}}", name)
        if number and known and int(number[1]) <= known[-1] and name not in used:
            gone.append(f"data/{name}")
    gone = [f"manifests/{n:09}.json" for n in known[:-keep]] + gone  # states go before what they refer to
    for name in gone:
        where, system = _path(spark, f"{path}/{name}")
        system.delete(where, True)
    return gone
