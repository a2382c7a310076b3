from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F, types as T

from surveykit.operators import rejects as R
from surveykit.operators.lags import keyed_lag
from surveykit.sources import fingerprint as P, snapshots as N


def test_both_outputs_add_up(spark, rows):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, -1.0), (3, 2.5), (4, None), (5, -0.5), (6, 200.0)], "id int, ObservationCount double")
    out = R.checked(df, R.count_rules(most=100))
    assert rows(out.accepted) == [(1, 5.0), (1, 5.0), (4, None)]
    assert rows(out.rejected, "id", "rule", "rules") == [
        (2, "negative", ["negative"]), (3, "fraction", ["fraction"]), (5, "negative", ["negative", "fraction"]), (6, "too_many", ["too_many"])]
    assert rows(out.counts()) == [("fraction", 2), ("negative", 2), ("too_many", 1)]
    assert out.accepted.columns == df.columns and {r.reason for r in out.rejected.collect()} >= {"a count below 0", "a count above 100"}
    empty = R.checked(df.limit(0), R.count_rules())
    assert empty.accepted.count() == empty.rejected.count() == 0
    with pytest.raises(ValueError):
        R.checked(df, [])


def test_unreadable_lines_are_rejected(spark, tmp_path, rows):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])
    (tmp_path / "t.csv").write_text("a,n,x\nu,1,2.5\nv,many,1\nw,NA,NA\ny,7,1,9\nz,-3,0\n")
    out = R.read_checked(spark, str(tmp_path / "t.csv"), schema, R.count_rules("n"))
    assert rows(out.accepted) == [("u", 1, 2.5), ("w", None, None)] and out.accepted.columns == ["a", "n", "x"]
    assert rows(out.rejected, "rule", "reason") == [("negative", "a count below 0"), ("unreadable", "v,many,1"), ("unreadable", "y,7,1,9")]


def test_bad_locations_and_repeated_keys_do_not_end_the_job(spark, rows):
    df = spark.createDataFrame([(1, -66.0, 46.0), (2, 46.0, -166.0), (3, None, 46.0), (4, 200.0, 46.0), (5, float("nan"), 1.0)], "id int, longitude double, latitude double")
    out = R.points_checked(df)
    assert rows(out.accepted, "id", "lon", "lat", "srid") == [(1, -66.0, 46.0, 4326)]
    assert rows(out.rejected, "id", "rule") == [(2, "latitude"), (3, "no_location"), (4, "longitude"), (5, "longitude")]
    keyed = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), (None, 1, 4.0), (None, 1, 4.0)], "site string, year int, v double")
    out = R.unique_rows(keyed, ["site", "year"])
    assert rows(out.accepted) == [("a", 2, 3.0)] and out.rejected.count() == 4 and "__size" not in out.rejected.columns


def test_fingerprints_tell_tables_apart(spark, tmp_path):
    kind = "a int, b string, c array<int>, d double"
    table = [(1, None, [1, None], 0.5), (None, "1", [None, 1], None), (2, "x", None, float("nan")), (2, "x", None, float("nan"))]
    own = P.fingerprint(spark.createDataFrame(table, kind))
    assert own == P.fingerprint(spark.createDataFrame(table[::-1], kind).repartition(3)) and own.n == 4
    others = [table[:-1], table + table[-1:], [(None, "1", [None, 1], 0.5), *table[1:]], [(1, None, [None, 1], 0.5), *table[1:]],
              [(1, None, [1, None], None), (None, "1", [None, 1], 0.5), *table[2:]], []]
    assert len({own, *(P.fingerprint(spark.createDataFrame(t, kind)) for t in others)}) == 7
    swapped = [spark.createDataFrame([x], "a int, b int") for x in ((None, 5), (5, None))]
    assert P.fingerprint(swapped[0]) != P.fingerprint(swapped[1])


def test_layers_are_verified(spark, tmp_path):
    path = str(tmp_path / "layer")
    layer = spark.range(1000).select("id", (F.col("id") * 0.5).alias("lon"), F.lit(46.0).alias("lat")).repartition(4)
    assert P.write_layer(layer, path) == P.verify_layer(spark, path) == P.fingerprint(layer)
    for other in (layer.where("id <> 7"), layer.unionByName(layer.where("id = 7")), layer.withColumn("lat", F.when(F.col("id") == 7, 45.0).otherwise(46.0))):
        other.write.mode("overwrite").parquet(path)
        with pytest.raises(AssertionError, match="differs"):
            P.verify_layer(spark, path)
    assert P.write_layer(layer.where("id < 0"), path).n == 0 == P.verify_layer(spark, path).n


def records(spark, *rows):
    return spark.createDataFrame(rows, "survey_year int, site string, n int")


def test_only_changed_years_are_written(spark, tmp_path, rows):
    path = str(tmp_path / "snap")
    with pytest.raises(ValueError, match="nothing was published"):
        N.read_snapshot(spark, path)
    first = N.write_changes(records(spark, (2016, "a", 1), (2017, "a", 2), (2017, "a", 2), (None, "b", 3)), path)
    assert first.number == 1 and N.write_changes(records(spark, (2017, "a", 2), (2017, "a", 2)), path) == first
    second = N.write_changes(records(spark, (2016, "a", 1), (2017, "a", 2), (2018, "c", 4)), path)
    assert second.years[2016] == first.years[2016] and second.years[2017] != first.years[2017] and second.years[None] == first.years[None]
    out = N.read_snapshot(spark, path)
    assert out.columns == ["site", "n", "survey_year"]
    assert rows(out, "survey_year", "site", "n") == [(2016, "a", 1), (2017, "a", 2), (2018, "c", 4), (None, "b", 3)]
    assert rows(N.read_snapshot(spark, path, number=1), "survey_year", "n") == [(2016, 1), (2017, 2), (2017, 2), (None, 3)]
    some = N.read_snapshot(spark, path, [2017, 2030])
    assert rows(some, "survey_year", "n") == [(2017, 2)] and len(some.inputFiles()) == 1
    assert N.read_snapshot(spark, path, [2030]).count() == 0
    third = N.write_changes(records(spark, (2016, "a", 1)).withColumn("more", F.lit(1.5)), path, complete=True)
    assert set(third.years) == {2016} and rows(N.read_snapshot(spark, path)) == [("a", 1, 1.5, 2016)]
    gone = N.vacuum(spark, path, keep=1)
    assert "manifests/000000001.json" in gone and N.manifests(spark, path) == [3] and rows(N.read_snapshot(spark, path)) == [("a", 1, 1.5, 2016)]
    assert len([g for g in gone if g.startswith("data/")]) == 2


def test_a_writer_that_dies_leaves_the_old_state(spark, tmp_path, rows, monkeypatch):
    path = str(tmp_path / "snap")
    N.write_changes(records(spark, (2016, "a", 1), (2017, "a", 2)), path)
    new = records(spark, (2016, "a", 9), (2017, "a", 9))

    def died(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(N, "publish", died)
        with pytest.raises(KeyboardInterrupt):
            N.write_changes(new, path)
    # and one that dies between two years
    new.where("survey_year = 2016").write.partitionBy("survey_year").parquet(f"{path}/data/{N.VERSION}=000000002-00000000")
    assert rows(N.read_snapshot(spark, path), "survey_year", "n") == [(2016, 1), (2017, 2)]
    state = N.write_changes(new, path)
    assert state.number == 2 and rows(N.read_snapshot(spark, path), "survey_year", "n") == [(2016, 9), (2017, 9)]
    with pytest.raises(Exception, match="(?i)exist"):
        N.publish(spark, path, N.Manifest(2, state.schema, {}))
    assert rows(N.read_snapshot(spark, path), "survey_year", "n") == [(2016, 9), (2017, 9)]
    assert f"data/{N.VERSION}=000000002-00000000" in N.vacuum(spark, path)


@pytest.mark.parametrize("lag", [1, 3])
def test_lag_equals_plain_python(spark, lag, monkeypatch):
    from surveykit.operators import order_stats

    monkeypatch.setattr(order_stats, "_ONE_IN", 40)  # many buckets, some of them with fewer rows than the lag
    rng = random.Random(4)
    table = [(rng.choice(["a", "a", "a", "b", None]), i if i else None, rng.choice([None, 1, 2, 3, 4]), "y") for i in range(3000)] + [("one", 1, 7, "y")]
    df = spark.createDataFrame(table, "g string, o int, x int, x_lag string").repartition(7)
    want = []
    for group in {r[0] for r in table}:
        own = sorted((r for r in table if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0))
        want += [(g, o, x, own[i - lag][2] if i >= lag else None) for i, (g, o, x, _) in enumerate(own)]
    out = keyed_lag(df, "x", ["o"], ["g"], lag)
    assert out.columns == ["g", "o", "x", "x_lag"] and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    one = [(o, x) for _, o, x, _ in sorted(table[:-1], key=lambda r: (r[1] is not None, r[1] or 0))]
    out = keyed_lag(spark.createDataFrame(one, "o int, x int"), "x", ["o"], (), lag, "before")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((o, x, one[i - lag][1] if i >= lag else None) for i, (o, x) in enumerate(one)), key=str)
