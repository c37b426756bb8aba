import base64
import random

import pytest

from sargam.llm.bpe import DEFAULT_RANKS, WORD_PATTERN, BytePairEncoder, decode_corpus, encode_corpus

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(DEFAULT_RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_library_on_random_strings(reference):
    rng = random.Random(2)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1d\x85    　​﻿abs'tdLl12.,!?<|endoftext|>কখি়্é😢\x01"
    encoder = BytePairEncoder.load(DEFAULT_RANKS)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text


def test_long_word_and_memo_restart(reference, monkeypatch):
    encoder = BytePairEncoder(BytePairEncoder.load(DEFAULT_RANKS).ranks)
    long = "ab" * 20_000 + "ঝীথ" * 5_000
    assert encoder.encode(long) == reference.encode_ordinary(long)
    monkeypatch.setattr("sargam.llm.bpe.MEMO_ENTRIES", 3)
    for text in ("one two three four", "five six", "one two"):
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_corpus(spark, reference, root):
    rows = [(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> it's", "x"), (3, "again", "x"), (None, " \n\n a", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"] or 0, list(r["ids"])) for r in encode_corpus(df, "doc_id", "text").collect()))
    assert got == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    docs = spark.read.parquet(f"{root}/documents.parquet")
    back = decode_corpus(encode_corpus(docs, "doc_id", "text"), "doc_id")
    joined = docs.select("doc_id", "text").join(back.withColumnRenamed("text", "decoded"), "doc_id")
    assert joined.where("coalesce(text, '') <> decoded").count() == 0
    assert joined.count() == docs.count()
