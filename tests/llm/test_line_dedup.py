import random

import pytest

from postflow.llm import line_dedup, queries
from postflow.llm.common import read, written

SPACE = " \t\n\x0b\x0c\r"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (c != d))
    return row[-1]


def within(a, b, edits):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return max(len(a), len(b)) <= 1 if edits == 1 else levenshtein(a, b) <= edits


def brute_force(docs, edits, near=True):
    """(doc_id, n_lines, n_removed, text); documents have different ids."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0]))
    distinct = {line.strip(SPACE) for _, text in docs for line in (text or "").split("\n")}
    distinct = sorted((line for line in distinct if line), key=len)
    parent = {line: line for line in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct if near else []):
        for b in distinct[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            if len(a) >= 30 and find(a) != find(b) and within(a, b, edits):
                parent[find(a)] = find(b)
    seen, rows = set(), []
    for doc_id, text in docs:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            core = line.strip(SPACE)
            if core:
                if find(core) in seen:
                    continue
                seen.add(find(core))
            kept.append(line)
        rows.append((doc_id, len(lines) if text else 0, len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(rows, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in df.collect()), key=str)


def changed(line, n):
    for _ in range(n):
        k = random.randrange(len(line) + 1)
        line = random.choice([line[:k] + "é" + line[k:], line[: max(0, k - 1)] + line[k:], line[: max(0, k - 1)] + "x" + line[k:]])
    return line


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_distance(spark, edits):
    random.seed(edits)
    rows = []
    for _ in range(400):
        a = "".join(random.choice("abé") for _ in range(random.choice([0, 1, 2, 5, 40, 90])))
        b = changed(a, random.randint(0, edits + 2)) if random.random() < 0.8 else "".join(random.choice("abé") for _ in range(random.randint(0, 12)))
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a STRING, b STRING").withColumn("d", line_dedup.distance("a", "b", edits))
    for r in frame.collect():
        want = levenshtein(r.a, r.b)
        assert r.d == want if want <= edits else r.d > edits, (r.a, r.b, r.d, want)
    numbered = [(k, a, b) for k, (a, b) in enumerate(rows)]
    near = line_dedup.within(spark.createDataFrame(numbered, "k INT, a STRING, b STRING"), edits)
    assert sorted(r.k for r in near.collect()) == [k for k, a, b in numbered if levenshtein(a, b) <= edits]


@pytest.mark.parametrize("edits", [1, 2])
def test_random_lines(spark, edits):
    random.seed(10 + edits)
    base = ["".join(random.choice("abc de") for _ in range(random.choice([10, 19, 20, 29, 30, 31, 45, 80]))) for _ in range(25)]
    docs = []
    for doc_id in range(80):
        lines = [changed(random.choice(base), random.choice([0, 0, 1, 1, 2, 3])) for _ in range(random.randint(0, 6))]
        docs.append((doc_id, "\n".join(random.choice(["", "  "]) + line for line in lines)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, base[-1] * 2)]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    assert got(line_dedup.dedup(frame, edits)) == brute_force(docs, edits)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in read(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = brute_force(docs, 1)
    assert sum(r[2] for r in want) > 50
    assert got(queries.op5_line_dedup(spark, "/root/testdata/sf0.01")) == want


def test_edge_rows(spark):
    line = "a line that is long enough to be compared"
    docs = spark.createDataFrame([(1, f"{line}\n{line}\nx\nx", 1), (1, line, 2), (2, f"{line}!\ny", 3)], "doc_id BIGINT, text STRING, n_lines INT")
    rows = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup(docs).collect())
    assert rows == [(1, 1, 0, line), (1, 4, 2, f"{line}\nx"), (2, 2, 1, "y")]
    assert line_dedup.dedup(docs.where("false")).collect() == []


def test_filters_stay_small(spark, monkeypatch):
    """What is computed for the distance is not put into the filters behind it."""
    seen = []

    def kept(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(line_dedup, "written", kept)
    pairs = spark.createDataFrame([(1, "a" * 60, "a" * 60 + "b")], "k INT, a STRING, b STRING")
    result = line_dedup.within(pairs, 1)
    assert [r.k for r in result.collect()] == [1]
    seen.append(result._jdf.queryExecution().optimizedPlan().toString())
    filters = [line for plan in seen for line in plan.split("\n") if "Filter" in line.split("(")[0]]
    assert filters and max(map(len, filters)) < 500
