"""Packing against the library's ids, piece by piece."""

import random
import zlib
from functools import partial
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postflow.llm import packing, queries
from postflow.llm.common import read

MODEL = public_tokenizers.path("word_bpe_49k.json")


def pack(docs, **options):
    model = Path(MODEL).read_text(encoding="utf-8")
    return packing.pack(docs, partial(packing.word_encoder, model), end=2, **options).collect()


def check(rows, texts, longest=4096):
    """Every id in exactly one piece with the right checksum, windows gapless. Returns the share of padding."""
    tokenizer = Tokenizer.from_file(MODEL)
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for window in windows.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= longest
        total += at
        padding += 0 if at & (at - 1) == 0 else longest - at
    return padding / max(1, total)


def test_words_are_encoded_like_whole_texts():
    encode = packing.word_encoder(Path(MODEL).read_text(encoding="utf-8"))
    tokenizer = Tokenizer.from_file(MODEL)
    random.seed(3)
    parts = ["The", "don't", "É", "é", "́", " ", "  ", "\n", "\t", "\x1c", "\xa0", "İ", "ß", "12", "a.b", "<|endoftext|>", "日本", "🙂", "\x85", "Σ"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    for text, data in zip(texts, encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "one two", 4: "word " * 9000, 5: "word " * 4095, 6: "same", 7: "same"}
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id BIGINT, text STRING, length STRING")
    check(pack(docs), texts)
    assert pack(docs.where("false")) == []
    assert [r.doc_id for r in pack(docs.where("doc_id = 3").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text"))] == [None]


def test_repeated_rows_are_packed_apart(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 3, "doc_id BIGINT, text STRING")
    rows = pack(docs)
    assert sorted((r.start, r.length) for r in rows) == [(0, 4)] * 3


def test_documents_against_the_library(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = queries.op6_packing(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(rows, texts) < 0.01
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 20_000)
    many = pack(docs.repartition(16, "doc_id"))
    assert check(many, texts) < 0.01


@pytest.mark.parametrize("seed", range(5))
def test_packer_closes_full_windows(seed):
    random.seed(seed)
    packer = packing.Packer((64, 32, 16, 8))
    for k in range(200):
        packer.add(packing.Piece(k, 0, bytes(4 * random.choice([1, 3, 7, 8, 20, 33, 63, 64, 65, 200])), 0))
    left = packer.pack()
    sizes = [sum(p.length for p in w) for w in packer.full]
    assert set(sizes) <= {64, 32, 16, 8} and sum(p.length for p in left) < 64
    assert sum(sizes) + sum(p.length for p in left) == packer.tokens
    packer.close(left)
    assert sum(s not in (64, 32, 16, 8) for s in map(lambda w: sum(p.length for p in w), packer.full)) <= 1


def test_pieces_have_the_ids_of_the_library(monkeypatch):
    """Letters, digits and signs apart, in plain Latin texts and in others; each distinct piece is encoded once."""
    model = Path(queries.tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")
    tokenizer = Tokenizer.from_str(model)
    plain = list("abcXYZ'strevmld \t\n\r\x0b\x0c0123!?#$%&*|<>_-.,\"ÀÉéñßÿø÷×")
    others = [*plain, "Σ", "ς", "你", "²", "\x85", "\xa0", "\x1c", "é", "<|endoftext|>", "İ", "µ", "ª"]
    random.seed(6)
    texts = ["".join(random.choice(plain if k % 2 else others) for _ in range(random.randint(0, 60))) for k in range(4000)]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    packing.word_encoder.cache_clear()
    assert packing.word_encoder(model)(texts) == want
    encoded = []
    tokenize = packing._PieceIds.__missing__
    monkeypatch.setattr(packing._PieceIds, "__missing__", lambda self, piece: encoded.append(piece) or tokenize(self, piece))
    packing.word_encoder.cache_clear()
    packing.word_encoder(model)(["Word, word. (WORD) word", "word!"])
    assert sorted(encoded) == sorted(["word", ",", ".", "(", ")", "!"])
