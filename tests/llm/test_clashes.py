"""Extra columns whose names clash with those that operators and stages use themselves."""

from __future__ import annotations

import os

import corpus_pipeline as cp
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surveykit.llm import byte_bpe, decontamination as dc, langid, near_duplicates as nd, near_vectors as nv, pseudonyms, queries, sharding, token_counts
from surveykit.storage import shared_folder

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["some words of a text that is long enough", "other words, and a number 4111 1111 1111 1111 here", "", None,
         "some words of a text that is long enough"]
NAMES = ["SCORE", "Lang_Pred", "__block", "__CUTS", "__rank", "__part", "__at", "__start", "Shard", "SLOT", "__hits", "__made", "PII_found",
         "__id", "__node", "__none", "__row", "__doc_id", "__text", "__doc_id_bad", "IDS", "bytes", "N_tokens", "n_bytes", "over_limit",
         "component_id", "kept", "rep", "count", "own", "digest", "seed"]


def documents(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def check(out, replaced=(), added=(), n=len(TEXTS)):
    """All own columns are there with their values; ``replaced`` are not."""
    gone = {r.lower() for r in replaced}
    assert [c for c in out.columns if c not in added] == [c for c in ["doc_id", "text", "lang", "source", "n_chars", *NAMES] if c.lower() not in gone]
    rows = out.collect()
    assert len(rows) == n and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES if c.lower() not in gone)


@pytest.mark.parametrize("name", ["bpe", "counts", "language", "shards", "without_benchmark", "pseudonyms"])
def test_rows_keep_their_columns(spark, name):
    docs = documents(spark)
    if name == "bpe":
        vocabulary, pattern = byte_bpe.Vocabulary([bytes([b]) for b in range(256)]), r"\S+|\s+"
        check(byte_bpe.decode(byte_bpe.encode(docs, vocabulary, pattern), vocabulary), ("ids", "bytes"), ("ids", "bytes"))
    elif name == "counts":
        made = ("n_bytes", "n_tokens", "over_limit")
        check(token_counts.count_tokens(docs, queries.model_file("piece_bpe_32k.model")), made, made)
    elif name == "language":
        check(langid.predict(docs, langid.train(docs)), ("score", "lang_pred"), ("score", "lang_pred"))
    elif name == "shards":
        check(sharding.shuffled_shards(docs, ["doc_id"], 3), ("shard", "slot"), ("shard", "slot"))
    elif name == "without_benchmark":
        check(dc.without_benchmark(docs, queries.table(spark, FOLDER, "benchmark")))
    else:
        check(pseudonyms.pseudonymised(docs, "key"), ("pii_found",), ("pii_found",))


def test_operators_that_read_named_columns_only(spark):
    docs = documents(spark)
    assert nd.near_duplicates(docs).where("not kept").count() == 1
    assert dc.overlaps(docs, docs.select("text", F.col("doc_id").alias("item_id"), "SCORE", "seed")).count() > 0
    vectors = docs.select("*", F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"))
    assert nv.near_vectors(vectors).where("kept").count() == 1


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_their_values(spark, stage):
    docs = documents(spark)
    out = cp.STAGES[stage][1](spark, docs, FOLDER)
    assert out.columns == docs.columns
    check(out, n={"language_id": 3, "near_dedup": 4}.get(cp.STAGES[stage][0], 5))


def test_last_stage(spark):
    assert all(r["decoded_equal"] for r in cp.token_ids(spark, documents(spark), FOLDER).collect())


@pytest.mark.parametrize("run", [nd.near_duplicates, lambda d: nv.near_vectors(d, vec="doc_id", vector="v"), lambda d: cp.near_dedup(d.sparkSession, d, FOLDER)])
def test_a_failing_run_leaves_no_tables(spark, run):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    bad = F.when(F.col("doc_id") == 2, F.raise_error(F.lit("unreadable")).cast("string"))
    docs = documents(spark).withColumn("text", F.coalesce(bad, F.col("text"))).withColumn("v", F.array(F.col("text").try_cast("double"))).withColumn("label", F.lit(1))
    with pytest.raises(PySparkException, match="unreadable"):
        run(docs).collect()
    assert not {f for f in os.listdir(folder) if f.startswith("work-")} - before if os.path.isdir(folder) else True


def test_pivots_are_those_of_smallest_hash(spark):
    rows = spark.range(20_000).select(F.array(*[F.rand(k) - 0.5 for k in range(6)]).alias("unit")).cache()
    index = nv.PivotIndex(least_pivots=8, apart=2.0, tried=2)
    found = nv.choose_pivots(rows, index)[6]
    want = [r["unit"] for r in rows.withColumn("h", F.xxhash64("unit")).orderBy("h", "unit").limit(len(found)).collect()]
    assert len(found) == 141 and [list(map(float, f)) for f in found] == want
