from __future__ import annotations

import random
from itertools import chain

import pytest
import regex

from tidewell.llm import tokenizer as T


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encode():
    words, pattern = T._words(open(T.VOCABULARY, "rb").read()), regex.compile(T.PATTERN)
    return lambda text: list(chain.from_iterable(map(words.__getitem__, pattern.findall(text))))


PIECES = [" ", "\n", "\t", "\r", "a", "b", "e", "the", "ing", " ", " ", "\x1c", "\x85", "é", "ß", "я", "中", "😀", "​", "1", "23", "٠", "²", "Ⅷ", "!", "..", "---", "'s", "'ll",
          "<|endoftext|>", "\U000e0001", "aaaaaaaa", "́", "ﬁ", "﻿", "\x00", "€"]


def test_mixed_strings_like_the_library(encode, library):
    random.seed(8)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(1, 40))) for _ in range(3000)]
    assert [encode(t) for t in texts] == library(texts)


def test_very_long_words_like_the_library(encode, library):
    texts = ["a" * 50_000, "ab" * 20_000, " " * 9999, "\n" * 5000 + "x", "=" * 7777, "0123456789" * 3000, "é" * 4000]
    assert [encode(t) for t in texts] == library(texts)


def test_documents_like_the_library_and_empty_and_null(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r.ids for r in T.encode_texts(docs, "text", ["doc_id"]).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    assert [got[r.doc_id] for r in rows] == library([r.text or "" for r in rows])
    assert all(got[r.doc_id] == [] for r in rows if not r.text)


def test_counts_repeated_rows_other_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (None, "", "y")], "k int, text string, ids string")
    got = sorted(((r.k, r.ids, r.n_tokens) for r in T.encode_texts(df, "text", ["k", "ids"], count_only=True).collect()), key=repr)
    assert got == sorted([(1, "x", 3), (1, "x", 3), (2, None, 0), (None, "y", 0)], key=repr)
    assert T.encode_texts(df.limit(0), "text", ["k"]).collect() == []


def test_round_trip(encode):
    ranks = T.read_ranks(open(T.VOCABULARY, "rb").read())
    text = "Mixed: naïve café – 中文 \U0001f600\n\n  indented\tand 12345."
    assert b"".join(ranks[i] for i in encode(text)).decode() == text
