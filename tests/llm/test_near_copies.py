"""The similarity join at the values of the pipeline's stage, against brute force."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_ngram_join import got, near_copies

from postflow.llm import ngram_join
from postflow.llm.common import read
from postflow.llm.ngram_join import NEAR_COPIES


def brute_force(docs):
    """Components of 5-word shingles with a Jaccard similarity of 0.8, by comparing all pairs that share one."""
    sets = {}
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having, seen = {}, set()
    for d, s in sets.items():
        for g in s:
            for e in having.setdefault(g, []):
                if (e, d) not in seen:
                    seen.add((e, d))
                    if 10 * len(s & sets[e]) >= 8 * len(s | sets[e]):
                        a, b = sorted((find(d), find(e)))
                        parent[b] = a
            having[g].append(d)
    return sorted((d, len(s), find(d)) for d, s in sets.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    docs = near_copies(seed, 250) + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "a b c d"), (905, "b a c d")]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    assert got(ngram_join.join(frame, cell_bytes=20_000, like=NEAR_COPIES)) == brute_force(docs)


def test_stage_over_the_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()])
    kept = [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(kept) == sorted(d for d, n, c in want if n == 0 or d == c)


def test_prefixes(spark):
    rows = spark.range(1, 400).select("id", ngram_join._least_common(F.col("id"), NEAR_COPIES).alias("l")).collect()
    assert [r.l for r in rows] == [ngram_join.least_common(r.id, NEAR_COPIES) for r in rows]
    assert all(ngram_join.prefix_length(n, NEAR_COPIES) == n - -(-8 * n // 10) + 1 for n in range(1, 300))
