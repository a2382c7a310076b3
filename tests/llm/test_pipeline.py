from __future__ import annotations

import corpus_pipeline as cp
import pytest
from check_oracles import compare, database
from surveykit.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.ORACLES[name]) is None


def test_stages_keep_columns_and_clean_documents(spark):
    docs = queries.table(spark, FOLDER, "documents")
    columns, count = docs.columns, docs.count()
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = cp.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert all(r["decoded_equal"] for r in out) and 0.7 * count < len(out) <= count
    assert {r["doc_id"] for r in cp.run(spark, FOLDER).collect()} == {r["doc_id"] for r in out}


def test_stages_with_nulls_repeats_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "some words of a text", "en", None, 20),
            (2, "some words of a text", "en", None, 20), (3, "some words of a text", None, "s", None), (None, "free words here", "en", "s", 15)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, kind)
        for _, stage in cp.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        assert sorted(r["doc_id"] or -1 for r in docs.collect()) == ([-1, 2] if given else [])


def test_near_dedup_by_text_where_ids_repeat_or_miss(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    a, b, c, d = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    rows = [(1, a), (2, a), (2, b), (2, b), (None, c), (None, c), (None, d), (9, d), (None, ""), (3, None), (7, c), (7, "y z"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)], kind)
    out = {(r["doc_id"], r["text"], r["source"]) for r in cp.near_dedup(spark, docs.repartition(5), FOLDER).collect()}
    assert out == {(1, a, "s0"), (2, b, "s2"), (9, d, "s7"), (None, "", "s8"), (3, None, "s9"), (7, c, "s10"), (7, "y z", "s11"), (7, None, "s12")}
    plain = cp.near_dedup(spark, docs.where("doc_id in (1, 9, 3)"), FOLDER)
    assert plain.columns == docs.columns and plain.count() == 3


def test_kept_documents_fill_few_partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    given = {k: spark.conf.get(k) for k in names}
    docs = spark.createDataFrame([(i, f"text number {i} of some words {i * i}", "en", "s", 1) for i in range(200)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(40)
    try:
        for k, v in zip(names, ("40", "false")):
            spark.conf.set(k, v)
        for stage in (cp.near_dedup, cp.benchmark_free):
            kept = stage(spark, docs, FOLDER)
            assert kept.rdd.getNumPartitions() == 1 and kept.count() == 200
    finally:
        for k, v in given.items():
            spark.conf.set(k, v)
