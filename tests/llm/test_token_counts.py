"""Counts equal the library's: over random texts in chunks of any size, over the table, and for rows at the edges."""

import random

import pytest
import sentencepiece

from postflow.llm import token_counts
from postflow.llm.queries import op7_token_counts, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("piece_bpe_32k.model")
ALPHABETS = [
    "abcdefgh  ", "the in ing tion  er", "ab \t\n\r\x0b\x0c 　", "éüñß😀👩‍👩‍👧日本語한국어 ", "0123456789.,-+ ", "▁ <s></s><unk><0x0A>", "aaaaaaaaaa ",
    "\x00\x01\x7f​﻿ x",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load_sentencepiece(PATH)


def random_texts(n, seed=0):
    pick = random.Random(seed)
    for _ in range(n):
        alphabet = "".join(pick.sample(ALPHABETS, pick.randint(1, 3)))
        yield "".join(pick.choice(alphabet) for _ in range(pick.randint(0, 80)))


def test_random_texts_in_chunks(library, vocabulary):
    transducer = token_counts.compiled(vocabulary)
    for text in random_texts(1500):
        expected = len(library.encode(text))
        for chunk in (1, 2, 3, 7, token_counts.CHUNK):
            assert transducer.count(text, chunk) == expected, (text, chunk)


def test_maps_compose_in_any_order(vocabulary):
    transducer = token_counts.compiled(vocabulary)
    pick = random.Random(5)
    for text in random_texts(200, 9):
        maps = [transducer.chunk_map(text[i : i + 5]) for i in range(0, len(text), 5)]
        if len(maps) < 3:
            continue
        k = pick.randrange(1, len(maps) - 1)
        one, other = transducer.scan(maps), transducer.compose(transducer.scan(maps[:k]), transducer.scan(maps[k:]))
        assert transducer.walk(transducer.START, one.head)[1] + (one.count or 0) == transducer.walk(transducer.START, other.head)[1] + (other.count or 0)


def test_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op7_token_counts(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_edge_rows(spark, library, vocabulary):
    long = "The quick brown fox, jumps over 13 lazy dogs. " * 4000
    big = 9007199254740993
    rows = [(big, None, 1, True), (big, None, 1, True), (None, "", 2, None), (1, " ", 3, None), (2, long, 4, None), (3, "x" * 50_000, 5, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, n_tokens INT, `a.b` BOOLEAN")
    found = token_counts.with_token_counts(docs, vocabulary)
    assert found.columns == ["doc_id", "a.b", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    expected = [(i or 0, len(t or ""), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _, _ in rows]
    assert got == sorted(expected)
    assert token_counts.with_token_counts(docs.where("false"), vocabulary).collect() == []
