"""Benchmark passages in documents, found through spaced seeds.

A mask looks at some positions of a stretch of words and ignores the others. Two masks of six words are such that
every pair of 13-word windows that differ in at most two words agrees under one of them, whatever the two places.
Masked hashes of all document positions are joined with those of the benchmark; around each hit the aligned words are
compared, and a hit counts if a window of 13 around it has at least 11 equal words (so substitutions are tolerated).
Items of fewer than 11 words must occur whole and unchanged.

Words are runs of letters and digits, lower-cased. All work is done by built-in functions. Before the join a bit
table of fixed size drops positions whose hash no benchmark position has; its false alarms only cost time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import free

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, EQUAL = 13, 11
_BEFORE = WINDOW - 8
_AROUND = _BEFORE + WINDOW
_BITS = 22


def word_codes(text: Column) -> Column:
    """A hash of each word; null and wordless texts give an empty array."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.hash(w))


def _seed(codes: Column, at: Column, mask: int, offsets: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(codes, at + o) for o in offsets])


def _places(codes: Column, span: int) -> Column:
    last = F.size(codes) - span
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hits(codes: Column, masks: list[tuple[int, ...]], wanted) -> Column:
    """``struct(seed, mask, at, around)`` for the positions whose seed is ``wanted``."""
    def of_mask(number: int, offsets: tuple[int, ...]) -> Column:
        places = F.filter(_places(codes, offsets[-1] + 1), lambda i: wanted(_seed(codes, i, number, offsets)))
        return F.transform(places, lambda i: F.struct(
            _seed(codes, i, number, offsets).alias("seed"), F.lit(number).alias("mask"), i.alias("at"),
            F.transform(F.sequence(F.lit(-_BEFORE), F.lit(WINDOW - 1)), lambda k: F.when(
                i + k >= 0, F.get(codes, F.greatest(i + k, F.lit(0))))).alias("around")))

    return F.concat(*[of_mask(n, m) for n, m in enumerate(masks)])


def _bit_table(seeds: DataFrame) -> Column:
    """2^22 bits as an array literal of words of 32 bits; the same size for every benchmark."""
    low = F.col("seed").bitwiseAND(F.lit((1 << _BITS) - 1))
    words = seeds.select(F.shiftright(low, 5).alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(31)).cast("int")).alias("bit"))
    table = [0] * (1 << _BITS - 5)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        table[row["word"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).alias("item_id"), word_codes(F.col(text)).alias("codes")).where(F.size("codes") > 0)


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text",
             item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``*keys, item_id, first_word, equal_words, n_seeds``, one row per document and item that overlap.

    ``first_word`` is the first position (in words) of a verified seed in the document, ``equal_words`` the most equal
    words in a window, ``n_seeds`` the verified seeds. Null, empty and wordless texts overlap with nothing; rows with
    the same keys are one document, a null key is a value like others, and equal items each get their rows. Only the
    named columns are read.
    """
    items = _items(benchmark, item, item_text)
    short = sorted(r[0] for r in items.select(F.size("codes").alias("n")).where(F.col("n") < EQUAL).distinct().collect())
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    least = F.array(*[F.lit(EQUAL)] * len(MASKS), *[F.lit(n) for n in short])
    found = items.select("item_id", F.size("codes").alias("n"), F.explode(_hits(
        F.col("codes"), masks, lambda seed: F.lit(True))).alias("s"))
    whole = (F.col("s.mask") < len(MASKS)) & (F.col("n") >= EQUAL) | (F.col("s.mask") >= len(MASKS)) & (
        F.col("n") == F.get(least, F.col("s.mask")))
    # runs of one word give the same stretch again and again: each is compared once, with its number on either side
    seeds = found.where(whole).groupBy("item_id", F.col("s.seed").alias("seed"), F.col("s.around").alias("item_around")).agg(
        F.count("*").alias("item_times"))
    table = _bit_table(seeds)

    def wanted(seed: Column) -> Column:
        low = seed.bitwiseAND(F.lit((1 << _BITS) - 1))
        word = F.get(table, F.shiftright(low, 5).cast("int"))
        return F.getbit(word, low.bitwiseAND(F.lit(31)).cast("int")) == 1

    coded = docs.select(*keys, word_codes(F.col(text)).alias("codes"))
    hits = coded.select(*keys, F.explode(_hits(F.col("codes"), masks, wanted)).alias("s")).select(
        *keys, F.col("s.seed").alias("seed"), F.col("s.mask").alias("mask"), F.col("s.at").alias("at"), F.col("s.around").alias("around")).groupBy(
        *keys, "seed", "mask", "around").agg(F.min("at").alias("at"), F.count("*").alias("times"))
    met = hits.join(seeds, "seed")
    same = F.zip_with("around", "item_around", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    counts = F.transform(F.sequence(F.lit(1), F.lit(_BEFORE + 1)), lambda s: F.aggregate(
        F.slice(same, s, F.lit(WINDOW)), F.lit(0), lambda total, x: total + x))
    equal = F.when(F.col("mask") < len(MASKS), F.array_max(counts)).otherwise(F.get(least, F.col("mask")))
    verified = met.select(*keys, "item_id", "at", "mask", (F.col("times") * F.col("item_times")).alias("times"), equal.alias("equal")).where(F.col("equal") >= F.get(least, F.col("mask")))
    return verified.groupBy(*keys, "item_id").agg(
        F.min("at").alias("first_word"), F.max("equal").alias("equal_words"), F.sum("times").alias("n_seeds"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns."""
    own = {name: F.xxhash64(F.col(c)) for name, c in zip(free(docs, f"__{doc}", f"__{text}"), (doc, text))}
    marked = docs.withColumns(own)
    bad = overlaps(marked, benchmark, tuple(own), text).select(*[F.col(c).alias(f"{c}_bad") for c in own]).distinct()
    return marked.join(bad, [marked[c] == bad[f"{c}_bad"] for c in own], "left_anti").drop(*own)
