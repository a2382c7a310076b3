from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from surveykit.llm import class_ngrams as cn, conversation_repair as cr, lexical as lx
from surveykit.storage import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ranks(docs, items, best):
    words = [(d, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    total, many = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, own in words:
            tf, m = Counter(own), 100 - 25 + 25 * len(own) * total // many
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if tf[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def lexical_tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 3 else f"{i}x" for i in range(120)]
    docs = [(i if i % 40 else None, " ".join(rng.choices(vocabulary[:rng.choice([10, 60, 120])], k=rng.choice([3, 40, 200])))) for i in range(500)]
    docs += [(7, docs[8][1]), (7, docs[8][1]), (3, None), (4, ""), (5, " .,! "), (900, "W1é-w1é_W2É 0X")]
    docs += [(1000 + i, "w1é w2é") for i in range(60)]  # ties beyond the rows asked for
    docs += [(2000, "w4é " * 600_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 30])))) for i in range(30)]
    items += [(2, "w1é w1é w2é"), (2, "w1é w1é w2é"), (50, None), (51, "..."), (52, "absent"), (None, "w5é")]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_ranks_equal_brute_force(spark, block):
    docs, items = lexical_tables()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, score string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    out = lx.ranked(df, asked, lx.DualTree(block=block, cells=4000))
    assert sorted(map(tuple, out.collect()), key=str) == plain_ranks(docs, items, 20)


def test_pairs_of_nodes_are_pruned():
    rng = np.random.default_rng(3)
    held = [np.sort(rng.choice(np.arange(g * 50, g * 50 + 50), 8, replace=False)) for g in range(4) for _ in range(10)]
    root = lx.item_tree(held, [np.full(8, 100) for _ in held], 4)
    search = lx.Search(root, 40, 3, np.zeros(40, np.int64))
    own = [np.sort(rng.choice(np.arange(g * 50, g * 50 + 50), 12, replace=False)) for g in range(4) for _ in range(200)]
    values = np.zeros((800, 200), np.int64)
    for i, terms in enumerate(own):
        values[i, terms] = rng.integers(1, 1000, 12)
    bounds = np.arange(801) * 12
    search.batch(np.arange(800), np.zeros(800, bool), values, lx.tree(bounds, np.concatenate(own), 8))
    assert search.scored < 0.5 * 40 * 800
    for i, h in enumerate(held):
        assert search.scores[i].tolist() == sorted((values[:, h].sum(axis=1) * 100).tolist())[:-4:-1]


def test_search_in_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert lx.ranked(docs, items).count() == 0 and lx.ranked(items.toDF("doc_id", "text"), items.limit(0)).count() == 0


def plain_repair(rows):
    """All least-cost edits by search over (row, state), with audits as whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] if r[1] is not None else " ", r[2] if r[2] is not None else " "))
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    counts, seen, kinds = Counter(), set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "fine"
        seen.add((role, text))
        kinds.append(kind)
        counts[kind] += 1
    best = {("", 0): (0, "", ())}
    reached = defaultdict(list, {0: [("", (0, "", ()))]})

    def closed(states):
        out = dict(states)
        for _ in range(3):
            for s, (c, a, said) in list(out.items()):
                t, name = ("a", "assistant:") if s == "u" else ("u", "user:")
                offer = (c + 2, a + "I", said + (name,))
                if t not in out or offer < out[t]:
                    out[t] = offer
        return out

    states = {"": (0, "", ())}
    for (_, role, text), kind in zip(rows, kinds):
        following = {}

        def offer(t, o):
            if t not in following or o < following[t]:
                following[t] = o

        for s, (c, a, said) in closed(states).items():
            offer(s, (c + 3, a + "D", said))
            if kind in ("blank", "duplicate"):
                continue
            more, first, wanted = kind == "truncated", role[:1], "a" if s == "u" else "u"
            if first == wanted or (first == "s" and s == ""):
                offer(first, (c + more, a + "K", said + (f"{role}:{text}",)))
            offer(wanted, (c + more + 2, a + "R", said + (f"{'assistant' if wanted == 'a' else 'user'}:{text}",)))
        states = following
    cost, audit, said = min(v for s, v in closed(states).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversations():
    rng = random.Random(8)
    out = {}
    for conv in range(60):
        rows = []
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["yes.", "no!", "cut off", "", " \n", None, "ok? \t", f"t{turn}.", "é."])
            rows += [(None if rng.random() < 0.05 else turn + rng.choice([0, 0, 3]), role, text)] * rng.choice([1, 1, 1, 2])
        out[conv if conv else None] = rows
    out[900] = [(0, "user", "same.")] * 40 + [(1, "assistant", "end.")]
    out[901] = [(i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(41)]
    out[902] = [(0, "user", "long " * 200_000)]
    return out


@pytest.mark.parametrize("size", [1 << 13, 3, 1])
def test_repair_equals_brute_force(spark, size):
    given = conversations()
    rows = [(c, t, r, x, "y") for c, own in given.items() for t, r, x in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(4)
    done = cr.repair(df, cr.Segments(rows=size))
    out = {r["conv_id"]: tuple(r)[1:] for r in done.summary.collect()}
    assert set(out) == set(given)
    for conv, own in given.items():
        assert out[conv] == plain_repair(own), conv
    said = defaultdict(list)
    for r in done.turns().orderBy("part", "seg", "at").collect():
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv in given:
        assert hashlib.sha256("\n".join(said[conv]).encode()).hexdigest() == out[conv][-1]


def test_ranks_order_nodes_by_their_least_audit():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 9, 40)
    costs = cr.to_come(symbols, cr._END)
    found = cr.ranked(symbols, costs)
    audits = ["".join(cr._LETTERS[found.letters[n]] for n in cr.path(found, node)) for node in range(164)]
    order = sorted(set(audits))
    places = [order.index(a) for a in audits]
    assert all((places[a] < places[b]) == (found.ranks[a] < found.ranks[b]) for a in range(164) for b in range(164))


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(df).summary.count() == 0


def training_rows():
    rng = random.Random(3)
    left, right = [f"a{i}x" for i in range(30)], [f"b{i}y" for i in range(30)]
    texts = [" ".join(rng.choice(left if j % 2 else right).upper() if rng.random() < 0.1 else rng.choice(left if j % 2 else right)
                      for j in range(rng.choice([1, 20, 90]))) for _ in range(200)]
    rows = [(i, t, i % 7 == 2) for i, t in enumerate(texts)]
    rows += [(500, None, False), (501, "", True), (502, " \n", True), (None, "new words here a1x", True), (3, "repeated id a1x", True), (504, "long " * 300_000, True)]
    return rows


def test_base_scores_equal_brute_force_and_classes_help(spark):
    rows = training_rows()
    df = spark.createDataFrame([(i, t, h, 1.0) for i, t, h in rows], "doc_id long, text string, held_out boolean, score double").repartition(4)
    small = cn.Classes(unit_bits=7, lookup_bits=4, endings=16, classes=6)
    out = cn.score_texts(df, df.where("not held_out"), small).collect()
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    counts = Counter(w for _, t, h in rows if not h for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), h, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, h in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    known = [r for r in out if r["n_known"] == r["n_tokens"] > 10]
    assert sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in out)


def test_probabilities_of_all_continuations_add_up(spark):
    rows = training_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    with Scratch(spark) as scratch:
        model, counts = cn.train(df.where("not held_out"), cn.Classes(unit_bits=7, lookup_bits=4, endings=16, classes=6), scratch)
        known = {bytes(r["word"]): r["n"] for r in counts.collect()}
        units = model.units()
        for before in range(6):
            total = 10 ** model.transitions[before, 0]
            for c in range(1, 6):
                own = np.array([n for w, n in known.items() if w and model.classes[units[w]] == c] + [0])
                total += 10 ** model.transitions[before, c] * (10 ** model.emission(own, np.full(len(own), c))).sum()
            assert total == pytest.approx(1)


def test_exchange_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(2)
    units, k = rng.integers(0, 9, (12, 12)).astype(float), 4
    classes = rng.integers(0, k, 12)

    def pairs(of):
        out = np.zeros((k, k))
        np.add.at(out, (of[:, None], of[None, :]), units)
        return out

    for u in range(12):
        others = np.arange(12) != u
        right = np.bincount(classes[others], units[u, others], k)
        left = np.bincount(classes[others], units[others, u], k)
        gains = cn.exchange_gains(pairs(classes), classes[u], right, left, units[u, u])
        for c in range(k):
            moved = classes.copy()
            moved[u] = c
            assert gains[c] == pytest.approx(cn.likelihood(pairs(moved)) - cn.likelihood(pairs(classes)))


def test_scores_without_anything_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    out = {r["doc_id"]: r for r in cn.score_texts(df, df.where("not held_out")).collect()}
    assert [(out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"], out[i]["base_score"]) for i in (1, 2)] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in out.values())
    assert cn.score_texts(df.limit(0), df).count() == 0
