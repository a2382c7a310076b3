from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from surveykit.llm import byte_bpe, langid, token_counts
from surveykit.llm.queries import bpe_vocabulary, model_file

TEXTS = [None, "", " ", "a", "The  theme's  end\n\n", "größer là-bas ☃ 漢字 \U0001F9FF", "x" * 5000, "ab " * 9000, "<|endoftext|> <s>", "a", "a"]


def frame(spark, texts, extra="n_tokens long"):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def bpe():
    vocabulary, pattern = bpe_vocabulary()
    return vocabulary, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(spark, bpe):
    vocabulary, pattern, library = bpe
    docs = frame(spark, TEXTS, "ids long")  # the clashing column is replaced
    out = byte_bpe.decode(byte_bpe.encode(docs, vocabulary, pattern), vocabulary).collect()
    assert len(out) == len(TEXTS)
    for row in out:
        text = TEXTS[row["doc_id"]] or ""
        assert list(row["ids"]) == library.encode_ordinary(text)
        assert bytes(row["bytes"]) == text.encode()
    assert byte_bpe.encode(docs.limit(0), vocabulary, pattern).count() == 0
    ids = spark.createDataFrame([([],), (None,), ([0, 1],)], "ids array<int>")
    assert [r["bytes"] for r in byte_bpe.decode(ids, vocabulary).collect()] == [
        b"", None, vocabulary.tokens[0] + vocabulary.tokens[1]]
    for wrong in (-1, len(vocabulary.tokens), None):
        with pytest.raises(Exception, match="outside the vocabulary"):
            byte_bpe.decode(spark.createDataFrame([([0, wrong],)], "ids array<int>"), vocabulary).collect()


def test_prefix_table_holds_every_prefix(bpe):
    vocabulary, _, library = bpe
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choices(b"aabcdeinrst \xc3\xa9", k=rng.choice([1, 2, 9, 40])))
        table = vocabulary.last_tokens(data)
        for n in range(1, len(data) + 1):
            assert vocabulary.read_back(table, n) == library._core_bpe.encode_single_piece(data[:n])


def test_edits_encode_only_near_them(bpe):
    vocabulary, pattern, library = bpe
    text = byte_bpe.EditableText(vocabulary, pattern, "that tion of the erons " * 400)
    before = text.encoded_bytes
    text.append("ing ")
    text.replace(4000, 4003, "zz é")
    text.replace(0, 0, "  \n")
    assert text.ids() == library.encode_ordinary(text.text)
    assert text.encoded_bytes - before < 120


def test_ranks_must_have_no_gaps(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(path))


def test_counts_equal_library(spark):
    model = model_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = token_counts.count_tokens(frame(spark, TEXTS), model, limit=5, chunk=300, overlap=16).collect()
    assert len(out) == len(TEXTS)
    for row in out:
        text = TEXTS[row["doc_id"]] or ""
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        assert row["over_limit"] == (row["n_tokens"] > 5)


def test_chunks_splice_to_the_whole_encoding():
    model = model_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    for chunk, overlap in ((20, 4), (60, 8)):
        counter = token_counts.Counter(model, chunk, overlap)
        for _ in range(300):
            text = "".join(rng.choices("ab  \n▁é漢☃\U0001F9FFthe ing", k=rng.choice([50, 300])))
            if rng.random() < 0.3:
                text = text.replace(" ", "")
            assert counter.ids(text) == library.encode(text)


def test_language_of_held_out_texts(spark):
    words = {"en": "the of and that this with from was".split(), "fr": "le les des une dans avec était".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    model = langid.train(spark.createDataFrame([*rows, (90, None, "en"), (91, "x", None)], "id long, text string, lang string"))
    assert model.languages == ("en", "fr")
    asked = [("Was THAT from this", "en"), ("dans une était", "fr"), (None, "und"), ("", "und"), ("123 !!", "und"),
             ("the " * 300_000, "en"), ("漢字", None)]
    out = langid.predict(spark.createDataFrame([(t, 1, 0.5) for t, _ in asked], "text string, score int, lang_pred double"), model).collect()
    for (text, lang), row in zip(asked, out):
        assert row["lang_pred"] == lang or lang is None
        assert 0 <= row["score"] <= 1 and (lang != "und" or row["score"] == 0)


def test_without_languages_all_is_undetermined(spark):
    docs = spark.createDataFrame([("some text", None)], "text string, lang string")
    assert [r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect()] == ["und"]
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_pieces_of_a_long_text_count_like_the_whole():
    import numpy as np

    text = "there is éa  x9 " * 80_000
    parts = list(langid._stretches([text, "b c"]))
    assert len(parts) > 1
    split = sum(np.bincount(langid._grams(c, o, 1024)[0][langid._grams(c, o, 1024)[1] == 0], minlength=1024) for c, o in parts)
    once = np.bincount(langid._grams(*next(iter(langid._stretches(["there is éa  x9 "]))), 1024)[0], minlength=1024)
    assert (split == once * 80_000).all()


def test_hash_file_is_where_the_parameter_says():
    assert hashlib.sha256(model_file("piece_bpe_32k.model")).hexdigest()
    assert public_tokenizers.path("piece_bpe_32k.model").endswith(".model")
