"""Removal of repeated passages against all windows of a small corpus in one dictionary."""

import hashlib
import random
import re

import numpy as np
import pytest

from postflow.llm import queries, substring_dedup
from postflow.llm.common import read


def brute_force(docs):
    """Rows of (doc_id, text) without repeated ids."""
    first, words = {}, {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        words[doc_id] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for i in range(len(words[doc_id]) - 19):
            first.setdefault(tuple(words[doc_id][i : i + 20]), (doc_id, i))
    rows = []
    for doc_id, ws in words.items():
        gone = set()
        for i in range(len(ws) - 19):
            if first[tuple(ws[i : i + 20])] != (doc_id, i):
                gone.update(range(i, i + 20))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        rows.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(rows)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rolling_hash_is_that_of_the_run():
    words = np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64)
    for length in (1, 2, 3, 8, 13, 20, 50):
        rolled = substring_dedup.rolled(words, length, 0x9E3779B97F4A7C15)
        assert len(rolled) == 50 - length + 1
        for i in (0, 50 - length):
            assert rolled[i] == substring_dedup.rolled(words[i : i + length], length, 0x9E3779B97F4A7C15)[0]
    assert len(substring_dedup.rolled(words[:5], 20, 3)) == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    random.seed(seed)
    passages = [[random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.choice([10, 19, 20, 21, 33, 60]))] for _ in range(12)]
    docs = []
    for doc_id in range(120):
        words = []
        for _ in range(random.randint(0, 5)):
            words += random.choice(passages) if random.random() < 0.6 else [str(random.random()) for _ in range(random.randint(1, 30))]
        docs.append((doc_id, random.choice([" ", "\n", "  "]).join(words)))
    docs += [(1000 + k, docs[5][1]) for k in range(30)] + [(2000, None), (2001, " "), (2002, "x " * 200)]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    assert rows_of(substring_dedup.dedup(frame, cell_bytes=2000)) == sorted(brute_force(docs), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = sorted(brute_force(docs), key=str)
    assert sum(r[2] for r in want) > 1000
    assert rows_of(queries.op10_substring_dedup(spark, "/root/testdata/sf0.01")) == want
    frame = read(spark, "/root/testdata/sf0.01", "documents")
    assert rows_of(substring_dedup.dedup(frame, cell_bytes=100_000)) == want


def test_repeated_rows_and_ids(spark):
    text = " ".join(map(str, range(25)))
    docs = [(1, text, 0), (1, text, 0), (1, text + " x", 0), (None, text, 0), (None, None, 0)]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, cell INT")
    got = rows_of(substring_dedup.dedup(frame))
    assert sorted(((r[0], r[1], r[2]) for r in got if r[0] is None), key=str) == [(None, 0, 0), (None, 25, 25)]
    ones = sorted((r[1], r[2]) for r in got if r[0] == 1)
    # one of the two texts with id 1 comes first
    assert ones in ([(25, 0), (25, 0), (26, 25)], [(25, 25), (25, 25), (26, 0)])
    assert substring_dedup.dedup(frame.where("false")).collect() == []
