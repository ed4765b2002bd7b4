import re
from fractions import Fraction
from itertools import permutations

import duckdb
import pytest

from postflow.llm import filter_audit, oracles, queries
from postflow.llm.common import read

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(docs):
    """Each document's letters, by the plain rules; docs are (doc_id, text, lang)."""
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs),
        }
        rows.append((lang or "", doc_id, {f for f, failed in fails.items() if failed}))
    return rows


def brute_force(docs, labels):
    rows, found, total = failures(docs), {}, {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                redundant = sum(f in r[2] for r in here) - len(gone)
                left = [r for r in left if f not in r[2]]
                alone = sum(r[2] == {f} for r in here)
                lost = [sum(r[1] in marked for r in gone) for marked in (good, toxic)]
                found[part, "".join(order), step] = [len(left), len(gone), redundant, alone, *lost]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in found.items())


def got(spark, docs, labels):
    df = filter_audit.audit(
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING"), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")
    )
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


LONG = " ".join(f"w{i}" for i in range(250))


def test_edge_rows_equal_brute_force(spark):
    docs = [
        (1, LONG, "en"), (2, LONG, "en"), (3, LONG + " #", "en"), (3, LONG, "de"), (4, LONG.upper(), "en"), (5, None, None), (6, "", ""),
        (7, " \t\n ", None), (None, "", "de"), (None, LONG, "en"), (8, "a " * 300, "de"), (9, "a " * 300, "de"), (9, "a " * 300, "de"),
        (10, "É" * 40 + " ABC", "fr"), (11, "x\xa0y " * 200, "fr"), (12, "wort " * 200_000, "fr"), (-5, LONG, "it"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (4, 1, None), (9, None, 1), (None, 1, 1), (77, 1, 1), (8, 0, 0), (3, 1, 0), (10, 1, 1)]
    assert got(spark, docs, labels) == brute_force(docs, labels)


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    assert got(spark, [(1, "a", "en")], []) == brute_force([(1, "a", "en")], [])


def test_other_columns_do_not_matter(spark):
    names = ["part", "bits", "digest", "n", "good", "toxic", "s", "least", "first", "filter_order", "removed", "c"]
    docs = [(1, LONG, "en"), (2, LONG, "en"), (3, "#", "de")]
    frame = spark.createDataFrame([(*d, *[7] * len(names)) for d in docs], "doc_id BIGINT, text STRING, lang STRING, " + ", ".join(f"{n} INT" for n in names))
    labels = spark.createDataFrame([(2, 1, 1, 5, 5)], "doc_id BIGINT, quality INT, toxic INT, part INT, good INT")
    assert sorted(tuple(r) for r in filter_audit.audit(frame, labels).collect()) == brute_force(docs, [(2, 1, 1)])


def test_coefficients_are_those_of_all_orders():
    """The least squares solution is the mean over all orders of what each filter adds."""
    m = 5
    direct = [[Fraction(0)] * (1 << m) for _ in range(m)]
    orders = list(permutations(range(m)))
    for order in orders:
        before = 0
        for f in order:
            direct[f][before | 1 << f] += Fraction(1, len(orders))
            direct[f][before] -= Fraction(1, len(orders))
            before |= 1 << f
    assert filter_audit.shapley_coefficients(m) == direct


@pytest.mark.parametrize("m", [2, 3, 4])
def test_shares_add_up(m):
    rows = filter_audit.shapley_coefficients(m)
    total = [sum(column) for column in zip(*rows)]
    assert total == [Fraction(-1)] + [Fraction(0)] * ((1 << m) - 2) + [Fraction(1)]


def test_registered_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(tuple(r) for r in queries.QUERIES["op11_filter_audit"](spark, sf).collect())
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    columns = ", ".join(COLUMNS)
    assert rows == sorted(con.execute(f"SELECT {columns} FROM ({oracles.FILTER_AUDIT_SQL})").fetchall())
    docs = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in read(spark, sf, "labels").select("doc_id", "quality", "toxic").collect()]
    assert rows == brute_force(docs, labels)
