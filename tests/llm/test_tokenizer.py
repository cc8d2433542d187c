"""Long words and bounds of the encoder."""

import random

import pytest

from graphweave.llm import tokenizer


@pytest.fixture(scope="module")
def library():
    found = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer.DEFAULT_VOCABULARY)
    found.encode_special_tokens = True
    return found


def test_long_words(spark, library):
    draw = random.Random(2)
    syllables = ["the", "in", "ing", "er", "an", "re", "on", "at", "en", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st"]
    texts = [
        "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "".join(draw.choice(syllables) for _ in range(40_000)),
        "a" * 100_000, "=" * 50_001 + "-", "日本語中文字" * 5_000, "".join(draw.choice(syllables) for _ in range(430_000))[:1_000_000], "ab" * 3 + "a" * 7 + "b", " " * 999,
    ]
    texts += ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.ids for r in tokenizer.encode_documents(df).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_bounds_change_nothing(spark, library, monkeypatch):
    texts = ["one two three four five six seven", "one two", "a" * 50, "three one"] * 3
    monkeypatch.setattr(tokenizer, "WORDS_A_QUERY", 3)
    monkeypatch.setattr(tokenizer, "BYTES_A_QUERY", 9)
    monkeypatch.setattr(tokenizer, "WORDS_KEPT", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.ids for r in tokenizer.encode_documents(df).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_merges_before_their_parts(spark):
    """Without the order of parts only the lowest pairs are contracted, which is right for any table."""
    merges = tokenizer.Merges.load()
    turned = tokenizer.Merges(merges.symbols, merges.pairs[:, [0, 1, 2, 3]] * [1, 1, -1, 1] + [0, 0, 60_000, 0])
    assert set(turned.side_ranks(0)["rank"].to_pylist()) == {-1} != set(merges.side_ranks(0)["rank"].to_pylist())
