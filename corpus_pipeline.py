"""A corpus from raw documents to token ids, in stages that each call one operator.

Each stage takes the session, the documents that the stage before it kept and the folder of the tables, and returns
the documents (all columns) that it keeps; the last one returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm import byte_bpe, decontamination, langid, near_duplicates, pseudonyms
from surveykit.llm.columns import free, others
from surveykit.llm.queries import PSEUDONYM_KEY, bpe_vocabulary, table
from surveykit.storage import Scratch, files

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents without a text or letter, or whose language is less likely than ``LEAST_SCORE``.

    Where no document has a language to learn from, nothing is known of any document, and only those without a
    letter go (a model of one made-up language decides that).
    """
    model = langid.train(docs)
    if not model.languages:
        model = langid.train(docs.select("text", F.lit("any").alias("lang")))
    plain = others(docs, "lang_pred", "score")
    aside = {c: free(docs, f"__{c}")[0] for c in docs.columns if c not in plain}
    judged = langid.predict(docs.withColumnsRenamed(aside), model)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(
        *[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def _gathered(kept: DataFrame, size: int) -> DataFrame:
    """The rows in no more partitions than ``size`` bytes of text fill, however many a shuffle has left."""
    return kept.coalesce(files(size))


def _text_bytes():
    return F.coalesce(F.sum(F.octet_length("text")), F.lit(0))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (five words, similarity 0.8), by its own text.

    Of rows that agree in id and text one stays, the first in the order of the other columns. Rows that share an id, or have
    none, but differ in text are documents of their own; a missing id counts as the largest, then the text's digest decides.
    """
    id_, node_, none_, row_ = free(docs, "__id", "__node", "__none", "__row")
    wide = docs.withColumn(id_, F.col("doc_id").cast("long"))
    often = wide.where(F.col(id_).isNotNull()).groupBy(id_).count().where("count > 1").select(id_)
    plain = wide.where(F.col(id_).isNotNull()).join(often, id_, "left_anti").withColumn(node_, F.col(id_))
    shared = wide.join(often, id_, "left_semi").unionByName(wide.where(F.col(id_).isNull()))
    rest = others(docs, "doc_id", "text")
    one = shared.groupBy("doc_id", id_, "text").agg(F.min(F.struct(F.lit(0).alias(none_), *rest)).alias(row_))
    # numbers outside the range of ids
    least, most, size = wide.agg(F.min(id_), F.max(id_), _text_bytes()).first()
    number = F.monotonically_increasing_id()
    unused = F.lit(min(least or 0, 0) - 1) - number if (least or 0) >= -(1 << 62) else F.lit(most + 1) + number
    with Scratch(spark) as scratch:
        one = scratch.leave(scratch.keep(one.select("doc_id", id_, "text", *[F.col(f"{row_}.{c}").alias(c) for c in rest]).withColumn(
            node_, unused.cast("long")), "shared"))
    texts = plain.select(node_, "text").unionByName(one.select(node_, "text"))
    found = near_duplicates.near_duplicates(_gathered(texts, size), doc=node_).select(F.col("doc_id").alias(node_), "component_id", "kept")
    if one.isEmpty():
        return _gathered(plain.join(found.where("kept").select(node_), node_, "left_semi").select(*docs.columns), size)
    known = found.join(one.select(node_, F.lit(True).alias("own"), id_, F.sha2("text", 256).alias("digest")), node_, "left")
    place = F.struct((F.col("own").isNotNull() & F.col(id_).isNull()).alias("last"), F.coalesce(
        id_, F.when(F.col("own").isNull(), F.col(node_))).alias("id"), "digest", node_)
    kept = known.groupBy("component_id").agg(F.min(place).alias("first")).select(f"first.{node_}")
    return _gathered(plain.join(kept, node_, "left_semi").select(*docs.columns).unionByName(
        one.join(kept, node_, "left_semi").select(*docs.columns)), size)


def benchmark_free(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    size, = docs.agg(_text_bytes()).first()
    return _gathered(decontamination.without_benchmark(docs, table(spark, folder, "benchmark")).select(*docs.columns), size)


def private_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replaces personal data by pseudonyms; ``n_chars`` follows the new text."""
    found, = free(docs, "pii_found")
    done = pseudonyms.pseudonymised(docs, PSEUDONYM_KEY, found=found)
    size = F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", size).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Encodes each text, decodes the ids and says whether the text came back."""
    vocabulary, pattern = bpe_vocabulary()
    encoded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, pattern)
    back = byte_bpe.decode(encoded, vocabulary)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (
        F.col("bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("decoded_equal"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("benchmark_free", benchmark_free),
          ("private_data", private_data), ("token_ids", token_ids)]

#: groups, pseudonyms and ids are beyond SQL; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The result of all stages over the table of documents; each stage reads what the one before it has written."""
    with Scratch(spark) as scratch:
        docs = table(spark, folder, "documents")
        for name, stage in STAGES[:-1]:
            written = scratch.keep(stage(spark, docs, folder), name)
            if docs.columns == written.columns and hasattr(docs, "_scratch_path"):
                scratch.drop(docs)
            docs = written
        scratch.leave(docs)
        return STAGES[-1][1](spark, docs, folder)
