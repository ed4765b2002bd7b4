"""Each fence rejects, follows its language and source, and rows at the edges have a defined verdict."""

import random

import pytest

from postflow.llm import quality_rules

SHORT = ["ab", "cde", "fgh", "ij", "klm", "nop", "qrs", "tu", "vwx", "yza"]
LONG = [w * 3 for w in SHORT]


def text(words, n, seed):
    """A text of n words without repeated windows."""
    pick = random.Random(seed)
    return " ".join(pick.choice(words) + chr(97 + i % 26) + "xyz"[i // 26 % 3] for i in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Two languages of 300 plain documents each; the words of the second are three times as long."""
    return [(1000 * k + i, text(words, 60, i), lang, "a") for k, (lang, words) in enumerate([("xx", SHORT), ("yy", LONG)]) for i in range(300)]


SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING"


def verdicts(spark, rows):
    return {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_every_fence_fires_and_plain_documents_stay(spark, corpus):
    plain = text(SHORT, 60, 999)
    odd = [
        (5001, text(LONG, 60, 7), "xx", "a"),  # words too long for its language, usual in the other one
        (5002, text(SHORT, 60, 8), "yy", "a"),  # too short
        (5003, " # $ ".join(plain.split()), "xx", "a"),
        (5004, plain.upper(), "xx", "a"),
        (5005, "\n".join([*plain.split()[:40], *["same line"] * 40]), "xx", "a"),
        (5006, plain, "xx", "a"),
        (5007, text(LONG, 60, 9), "yy", "new source"),  # too small a group: the language decides
        (5008, text(SHORT, 60, 10), "yy", "new source"),
    ]
    kept = verdicts(spark, corpus + odd)
    assert all(kept[r[0]] for r in corpus)
    assert {i: kept[i] for i in range(5001, 5009)} == {
        5001: False, 5002: False, 5003: False, 5004: False, 5005: False, 5006: True, 5007: True, 5008: False,
    }


def test_a_source_full_of_symbols_keeps_them(spark, corpus):
    symbols = [(7000 + i, " #$ ".join(text(SHORT, 60, i).split()[: 20 + i % 40]), "xx", "code") for i in range(300)]
    kept = verdicts(spark, corpus + symbols)
    assert all(kept[r[0]] for r in symbols)


def test_edge_rows(spark):
    plain = text(SHORT, 60, 3)
    rows = [
        (1, plain, None, None, 7, 1), (1, plain, None, None, 7, 1), (None, plain, "xx", None, 8, 2), (2, None, "xx", "a", 9, 3),
        (3, "", "xx", "a", 9, 3), (4, " \t\n", "xx", "a", 9, 3), (5, plain * 3000, "xx", "a", 9, 3), (6, "é" * 100_000, None, "a", 9, 3),
    ]
    docs = spark.createDataFrame(rows, SCHEMA + ", _words INT, `low_word_length` INT")
    found = quality_rules.judge(docs)
    assert {c: found.schema[c].dataType.simpleString() for c in ("_words", "low_word_length", "kept")} == {
        "_words": "int", "low_word_length": "int", "kept": "boolean",
    }
    got = sorted(((r.doc_id or 0, r._words, r.n_words, r.base_failed, r.kept) for r in found.collect()))
    assert got == [
        (0, 8, 60, False, True), (1, 7, 60, False, True), (1, 7, 60, False, True), (2, 9, 0, True, False), (3, 9, 0, True, False),
        (4, 9, 0, True, False), (5, 9, 3000 * 59 + 1, True, False), (6, 9, 1, True, False),
    ]
    kept = quality_rules.keep_good(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted((r.doc_id or 0, r.text, r._words) for r in kept.collect()) == [(0, plain, 8), (1, plain, 7), (1, plain, 7)]
    assert quality_rules.judge(docs.where("false")).collect() == []
    assert quality_rules.keep_good(docs.where("false")).collect() == []
