"""Ids beyond 2^53 beside null ids, and columns named like those that operators use inside."""

from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postflow.llm import decontaminate, license_scan, line_dedup, ngram_join, packing, pii_surrogates, quality_rules, queries, substring_dedup

LARGE = (2**53 + 1, 2**53 + 3)
WORDS = " ".join(f"w{i}" for i in range(60))


def docs(spark, text=WORDS):
    rows = [(LARGE[0], text), (None, text), (LARGE[1], text), (None, "another text"), (7, None)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)


def test_decontaminate(spark):
    item = spark.createDataFrame([(2**53 + 5, WORDS)], "item_id BIGINT, text STRING")
    found = decontaminate.leaks(docs(spark), item).select("doc_id", "item_id").distinct().collect()
    assert sorted(map(tuple, found), key=str) == sorted([(i, 2**53 + 5) for i in (None, *LARGE)], key=str)


def test_ngram_join(spark):
    found = sorted((tuple(r) for r in ngram_join.join(docs(spark)).select("doc_id", "component_id").collect()), key=str)
    assert found == sorted([(i, LARGE[0]) for i in (*LARGE, None)] + [(None, None), (7, 7)], key=str)
    kept = ngram_join.one_of_each(docs(spark)).select("doc_id").collect()
    assert LARGE[0] in {r.doc_id for r in kept} and LARGE[1] not in {r.doc_id for r in kept}


def test_packing(spark):
    model = Path(queries.tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")
    found = packing.pack(docs(spark), partial(packing.word_encoder, model), end=2).select("doc_id").collect()
    assert {r.doc_id for r in found} == {None, 7, *LARGE}


def test_substring_dedup(spark):
    found = sorted((tuple(r) for r in substring_dedup.dedup(docs(spark)).select("doc_id", "n_removed").collect()), key=str)
    assert found == sorted([(LARGE[0], 0), (LARGE[1], 60), (None, 60), (None, 0), (7, 0)], key=str)


OPERATORS = {
    "quality": (quality_rules.judge, "_words _lines _caps _hashes _windows _pairs low_word_length high_symbol_rate _lang _source"),
    "keep_good": (quality_rules.keep_good, "_words _lines _caps low_word_length n_words kept _in0"),
    "pii": (partial(pii_surrogates.replace, secret="k"), "_new _doc_id _found d kind value new"),
    "licenses": (license_scan.scan, "_ids _all _left _in1"),
    "lines": (line_dedup.dedup, "_doc _removed _lines _order _kept _hashes line at"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_private_names_of_the_input_stay(spark, name):
    operator, names = OPERATORS[name]
    text = "Mr John Smith wrote this first line, which is long.\nLicensed under the MIT License.\n" + WORDS
    frame = spark.createDataFrame([(1, text), (2, text + " and more")], "doc_id BIGINT, text STRING").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    plain = operator(frame)
    marked = operator(frame.withColumns({n: F.lit(f"mine {i}") for i, n in enumerate(names.split())}))
    assert {r.doc_id for r in plain.collect()} == {1, 2}
    same = [c for c in plain.columns if c not in names.split()]
    assert sorted(map(str, marked.select(same).collect())) == sorted(map(str, plain.select(same).collect()))
    for i, n in enumerate(names.split()):
        if n not in plain.columns:
            assert {r[0] for r in marked.select(f"`{n}`").collect()} == {f"mine {i}"}, n
