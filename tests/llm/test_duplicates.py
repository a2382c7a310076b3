from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from surveykit.llm import near_duplicates as nd, near_vectors as nv
from surveykit.llm.components import components
from surveykit.llm.shingles import sets
from surveykit.storage import Scratch

import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def roots(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(texts, size, percent=80):
    found = {i: plain_set(t, size) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(found, 2) if found[a] and found[b]
             and 100 * len(found[a] & found[b]) >= percent * len(found[a] | found[b])]
    return {i: (len(found[i]), r, r == i) for i, r in roots(links, found).items()}


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(300)]
    base = rng.choices(words, k=120)
    texts = [None, "", " \n\t", "One", "one", "One two", "one  TWO", "É one", "é one", " ".join(base), " ".join(base).upper()]
    for _ in range(60):  # near copies of one text, many of which are too far from each other
        copy = list(base)
        for _ in range(rng.choice([1, 3, 5, 7, 9])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(words, k=rng.choice([1, 4, 30, 2000]))) for _ in range(20)]
    texts.append("long " * 400_000)
    return dict(enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, component_id int")
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(docs, nd.Near(size=size)).collect()}
    assert out == expected(texts, size)


def test_rows_without_id_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "a b c d"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    out = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in nd.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(-1, None, True), (-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (3, 3, True)], key=str)
    assert [o for o in out if o[0] > 0] == [(3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert nd.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [8, 64, 1024, 4096])
def test_words_without_anything_in_common_are_not_linked(spark, length):
    """Thue-Morse words collide with their opposites in every power sum modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, "x y z"), (4, word.upper())], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 1}


def test_hashes_of_words_depend_on_each_byte_alone():
    texts = ["abcdefgh", "abcdefgi", "abcdefghi", "xabcdefgh", "a" * 64, "a" * 65, "a" * 66, "A" * 65, "é" * 33, "é" * 32, "q", "a\0", "a"]
    found = [int(values[bounds[i]]) for _, _, values, bounds in sets(pa.array(texts), 1) for i in range(len(texts))]
    alone = [int(values[0]) for t in texts for _, _, values, _ in sets(pa.array(["zz", t, "yy"]).slice(1, 1), 1)]
    assert found == alone and len(set(found)) == len(texts) - 1 and found[5] == found[7]


def test_rows_of_one_id_are_in_one_group(spark):
    first, second, third, fourth = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    rows = [(5, first), (5, second), (3, second), (4, third), (2, fourth), (7, third), (7, fourth), (6, ""), (6, first), (8, None), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(docs).collect())
    assert out == sorted((i, c, i == c) for i, c in [(5, 3), (5, 3), (3, 3), (4, 2), (2, 2), (7, 2), (7, 2), (6, 3), (6, 3), (8, 8), (8, 8)])


def test_shingle_sets_of_words_across_pieces():
    texts = ["a b a b a", None, "", "one", "x " * 700_000, "y" * 3_000_000 + " z"]
    got = {}
    for start, stop, values, bounds in sets(pa.array(texts, pa.string()), 2):
        for i in range(start, stop):
            got[i] = len(values[bounds[i - start]:bounds[i - start + 1]])
    assert got == {0: 2, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    values = np.concatenate([np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))])
    signs = nd.superminhash(values, np.array([0, 800, 1600]), 400)
    assert abs((signs[0] == signs[1]).mean() - 0.6) < 0.08
    one = nd.superminhash(values[:1], np.array([0, 0, 1]), 50)
    assert (one[0] == nd._EMPTY).all() and sorted(int(v >> np.uint64(48)) for v in one[1]) == list(range(50))


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(400)], [(0, i) for i in range(1, 300)], [(2 * i, 2 * i + 1) for i in range(90)], []])
def test_components(spark, links):
    nodes = {x for link in links for x in link}
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(links, "a long, b long").repartition(6)
        assert {r["node"]: r["component"] for r in components(df, scratch).collect()} == roots(links, nodes)


@pytest.fixture
def many_partitions(spark):
    given = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in given.items():
        spark.conf.set(k, v)


def test_small_tables_go_to_few_files(many_partitions, monkeypatch):
    spark, written, keep = many_partitions, [], Scratch.keep

    def counted(self, df, name="table", *args, **more):
        kept = keep(self, df, name, *args, **more)
        written.append((name, len(kept.inputFiles())))
        return kept

    monkeypatch.setattr(Scratch, "keep", counted)
    texts = {i: " ".join(f"w{i % 60}x{k}" for k in range(12)) + (" more" if i % 7 else "") for i in range(240)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect()}
    assert got == expected(texts, 5)
    assert {"classes", "members", "pairs", "sets", "links", "edges", "moves", "labels", "result"} <= {name for name, _ in written}
    assert max(n for _, n in written) == 1


def test_files_grow_with_the_rows(many_partitions):
    spark = many_partitions
    with Scratch(spark) as scratch:
        rows = spark.range(1000).repartition(40, "id")
        assert [len(scratch.keep(rows, size=size).inputFiles()) for size in (None, 0, 5 << 20, 1 << 40)] == [40, 1, 3, 40]
        links = spark.range(1000).selectExpr("id a", "id + 1 b").repartition(40, "a")
        assert components(links, scratch, 1000).where("component = 0").count() == 1001


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * (0.0 if i % 7 == 0 else 0.05)).tolist(), i % 3) for i in range(240)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [None] * 16, 0), (303, [float("nan")] * 16, 0), (304, [float("inf")] * 16, 0),
             (305, rows[0][1], None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [1e200, 2e200], 0), (309, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fine = {i: (np.array(v) / np.max(np.abs(v)), lab) for i, v, lab in rows if i < 300 or 305 < i < 309}
    links = []
    for (a, (x, p)), (b, (y, q)) in itertools.combinations(fine.items(), 2):
        if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
            links.append((a, b))
    groups = roots(links, [r[0] for r in rows])
    out = {r["vec_id"]: r for r in nv.near_vectors(df).collect()}
    found = sum(r["n_links"] for r in out.values())
    assert len(out) == len(rows) and found <= 2 * len(links) and found >= 0.9 * 2 * len(links)
    for i in (300, 301, 302, 303, 304, 305, 309):
        assert (out[i]["n_links"], out[i]["component_id"], out[i]["kept"]) == (0, i, True)
    assert all(out[i]["n_links"] == 2 for i in (306, 307, 308))
    if found == 2 * len(links):
        assert {i: r["component_id"] for i, r in out.items()} == groups
    assert nv.near_vectors(df.limit(0)).count() == 0


def test_links_of_a_dense_group_are_found(spark):
    rng = np.random.default_rng(6)
    center = rng.normal(size=64)
    group = center / np.linalg.norm(center) + rng.normal(size=(2400, 64)) * np.sqrt(0.015 / 0.985 / 64)
    vectors = np.concatenate([group, rng.normal(size=(17_600, 64))])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit[:2400] @ unit.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r["n_links"] for r in nv.near_vectors(df).collect()}
    assert len(found) == 20_000 and sum(found[i] for i in range(2400)) >= 0.999 * links.sum()
    assert all(found[i] <= links[i] for i in range(2400))


def test_vector_rows_without_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (6, [1.0, 0.01], 1)],
                               "vec_id long, embedding array<float>, label int")
    out = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in nv.near_vectors(df).collect())
    assert out == [(-1, 0, None, True), (4, 2, 4, True), (4, 2, 4, True), (6, 2, 4, False)]


def test_no_scratch_table_is_left_but_the_result(spark):
    scratch = Scratch(spark)
    kept, other = scratch.keep(spark.range(3)), scratch.keep(spark.range(4))
    scratch.leave(kept)
    scratch.close()
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(other._scratch_path)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
