import random
import re

import numpy as np
import pyarrow as pa
import pytest

from postflow.llm import circulant_minhash as op
from postflow.llm import ngram_join, queries
from postflow.llm.common import read
from postflow.llm.ngram_join import shingles


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, size=3):
    words = words_of(text)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_force(docs, percent=85, size=3):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text), by all pairs that share a shingle."""
    sets = [shingle_set(t, size) for _, t in docs]
    distinct = list(dict.fromkeys(s for s in sets if s))
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = {}
    for k, s in enumerate(distinct):
        common = {}
        for x in s:
            for other in having.get(x, ()):
                common[other] = common.get(other, 0) + 1
            having.setdefault(x, []).append(k)
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(distinct[other]) - n):
                parent[find(k)] = find(other)
    number = {s: k for k, s in enumerate(distinct)}
    least = {}
    for (doc_id, _), s in zip(docs, sets):
        if s and doc_id is not None:
            at = find(number[s])
            least[at] = min(least.get(at, doc_id), doc_id)
    rows = []
    for (doc_id, _), s in zip(docs, sets):
        component = least.get(find(number[s])) if s else doc_id
        rows.append((doc_id, len(s), component, doc_id == component))
    return sorted(rows, key=str)


def got(df):
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_permutations_hit_every_place_once():
    for which in (0, 1):
        assert len(np.unique(op.permuted(np.arange(op.RING), which))) == op.RING


def test_coordinates_are_the_shifted_permutation():
    hashes = shingles("a b c d e f g h i j k l", 3)
    places = op.permuted(hashes & np.uint64(op.RING - 1), 0)
    for k in (0, 1, 77, op.BANDS * op.ROWS - 1):
        assert op.signature(hashes)[k] == op.permuted((places + np.uint64(k)) & np.uint64(op.RING - 1), 1).min()


def test_agreement_estimates_the_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.85):
        agreeing = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            common = int(400 * share)
            rest = (400 - common) // 2
            one, two = pool[: common + rest], np.concatenate([pool[:common], pool[common + rest :]])
            agreeing.append((op.signature(one) == op.signature(two)).mean())
        assert abs(np.mean(agreeing) - share) < 0.02


def test_edge_rows_equal_brute_force(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [
        (1, "a b c"), (2, "A  B\tC"), (3, "a b"), (4, "a"), (5, "A"), (6, ""), (7, None), (8, " \n\t"), (9, " "), (10, "É a b"), (11, "é a b"), (12, "a\xa0b c"),
        (None, "a b c"), (None, None), (None, "only here it is"), (None, "only here it is"), (13, "a b c a b c a b c"), (2**53 + 1, "z z z z"), (2**53 + 3, "z z z z z"),
        (14, " ".join(base)), (14, "another text with the id of one"), (14, " ".join(base)), (15, "lang " * 300_000),
    ]
    rows += [(100 + k, " ".join(edited(rng, base, k % 7))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(5)
    want = brute_force(rows)
    assert got(op.near_duplicates(df)) == want
    # one round and small blocks: what is left is verified in blocks
    assert got(op.near_duplicates(df, turns=1, block=3)) == want


@pytest.mark.parametrize("block", [4, 512])
def test_large_group_around_the_threshold(spark, block):
    """Near copies of one text, of which many pairs are just below the threshold."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(140)]
    rows = [(k, " ".join(edited(rng, base, 1 + k % 9))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = brute_force(rows)
    assert len({r[2] for r in want}) > 10
    assert got(op.near_duplicates(df, turns=1, block=block)) == want


def test_other_likeness_empty_table_and_columns(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    rows = [(k, " ".join(edited(rng, base, k % 5))) for k in range(30)]
    names = ["node", "n", "bands", "key", "hashes", "component", "component_id", "kept", "a", "b"]
    df = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], "doc_id BIGINT, text STRING, " + ", ".join(f"{n} INT" for n in names))
    assert got(op.near_duplicates(df, words=5, percent=80)) == brute_force(rows, 80, 5)
    assert got(op.near_duplicates(df.where("false"))) == []


def test_a_worker_keeps_the_hashes_of_some_words_only(monkeypatch):
    """Workers are used again: what they keep must not grow with all the words they have seen."""
    monkeypatch.setattr(ngram_join, "MAX_WORDS", 50)
    texts = [" ".join(f"w{i * 40 + k}" for k in range(40)) for i in range(5)] + [" ".join(f"v{k}" for k in range(300)) + " " + "x" * 5000]
    ngram_join._hashes.clear()
    sets = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    for step in (op._signed(3), op._hashed(3)):
        list(step(iter([sets])))
        assert len(ngram_join._hashes) <= 50 and max(map(len, ngram_join._hashes)) <= 64


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [(r["doc_id"], r["text"]) for r in read(spark, path, "documents").collect()]
    assert got(queries.QUERIES["op12_circulant_minhash"](spark, path)) == brute_force(docs)
