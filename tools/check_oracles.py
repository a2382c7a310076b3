"""Runs registered queries and compares each with its SQL in DuckDB.

    python tools/check_oracles.py [folder of tables] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]").appName("surveykit-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    got = _sorted([tuple(r) for r in spark_df.collect()], spark_df.columns)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(columns)}"
    want = _sorted(cursor.fetchall(), columns)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    names = sorted(columns)
    for a, b in zip(got, want):
        if a != b:
            bad = [(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]
            return f"first difference {bad} in {dict(zip(names, a))}"
    for a, b in zip(got[:50], want[:50]):
        if [type(x) for x in a] != [type(y) for y in b]:
            return f"types differ: {a} against {b}"
    return None


def main() -> int:
    from surveykit.workloads import ORACLES, QUERIES

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), database(folder)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
                note = "equal" if problem is None else f"DIFFERENT: {problem}"
            else:
                rows = df.count()
                problem, note = (None, f"{rows} rows, no SQL") if rows else ("empty", "EMPTY")
        except Exception as error:  # report and go on with the next query
            problem, note = "error", f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:24s} {time.time() - started:6.2f}s  {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    spark.stop()
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
