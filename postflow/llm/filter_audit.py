"""How quality filters overlap: what each removes at its place in every order, and its Shapley share of all removals.

**Coalitions.** A document's failures are five bits. What any set of filters removes together is the number of documents
with a bit of the set, so the 32 coalitions of a part (a language) follow from its counts by bits. Step ``k`` of an order
removes the difference of two coalitions: the filters up to it, and those before it.

**Shapley values** are the solution of a constrained least squares problem: additive shares that fit what the coalitions
remove, weighted by the Shapley kernel ``(m - 1) / (C(m, s) s (m - s))``, and whose sum is what all filters remove. The
normal equations do not depend on the data: they are solved once in rationals, with the coalitions as unknown right-hand
sides, and give exact coefficients. These are applied to each part as columns.

**Distribution.** Texts are read once and never shuffled: a row of bits, digest, language and labels stands for each
document. Equal texts are found by their SHA-256; groups of them are counts by language and label with the smallest id,
combined before the shuffle, so a text that a third of all documents have is a few rows. Everything behind the counts by
part and bits is 32 numbers a part.

**Defined cases.** A null text is empty. Null and empty languages are one part, ''. A document with a null id fails no
comparison of ids and has no labels; rows with equal ids are documents of their own, none smaller than the other. A
document is good (toxic) if any row of ``labels`` with its id says so. An empty table gives no rows. Other columns of the
inputs, whatever their names, are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import text_of, words_of, written

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Least share of different words, and largest share of the letters A-Z, in percent.
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
SIGNS = "#$%&*|"

_COALITIONS = 1 << len(FILTERS)


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D, which a text alone decides."""
    signs = F.lit(False)
    for sign in SIGNS:
        signs = signs | F.contains(text, F.lit(sign))

    def bits(counted: Column) -> Column:
        fails = [
            counted["words"] < MIN_WORDS,
            100 * counted["different"] < DISTINCT_PERCENT * counted["words"],
            100 * counted["capitals"] > CAPITALS_PERCENT * counted["chars"],
            counted["signs"],
        ]
        total = F.lit(0)
        for k, fail in enumerate(fails):
            total = total + F.when(fail, F.lit(1 << k)).otherwise(0)
        return total

    # arrays of one element, because what occurs several times in an expression is computed as often
    counted = F.transform(
        F.array(words_of(text)),
        lambda words: F.struct(
            F.size(words).cast("long").alias("words"),
            F.size(F.array_distinct(words)).cast("long").alias("different"),
            F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("capitals"),
            F.char_length(text).cast("long").alias("chars"),
            signs.alias("signs"),
        ),
    )
    return F.get(F.transform(counted, bits), F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by ``part`` and failure ``bits``: ``n``, ``n_good``, ``n_toxic``."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.where("doc_id IS NOT NULL AND (good OR toxic)").groupBy("doc_id").agg(
        F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("text"))
    # written, so that the texts are read and measured once
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text")).alias("bits"))
    rows = written(rows, "filter-bits")
    rows = rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    alike = ["digest", "part", "bits", "good", "toxic"]
    by_id = rows.groupBy("doc_id", *alike).agg(F.count("*").alias("c"))
    known = F.col("doc_id").isNotNull()
    groups = by_id.groupBy(*alike).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(known, F.col("c")).otherwise(0)).alias("n_known"),
        # the rows of the smallest id
        F.min(F.when(known, F.struct("doc_id", "c"))).alias("first"),
    )
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    same = groups.join(least, "digest")
    # all but the rows of the smallest id of a text repeat it
    repeats = F.col("n_known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    split = same.select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("bits").alias("bits"), (F.col("n") - repeats).alias("n")),
                F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("bits"), repeats.alias("n")),
            )
        ).alias("s"),
    )
    of = lambda mark: F.sum(F.when(F.col(mark), F.col("s.n")).otherwise(0))
    return split.groupBy("part", F.col("s.bits").alias("bits")).agg(F.sum("s.n").alias("n"), of("good").alias("n_good"), of("toxic").alias("n_toxic"))


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """``matrix`` x = ``right`` in rationals, for several right-hand sides at once (rows of ``right`` are rows of x)."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right)]
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                factor = rows[i][k]
                rows[i] = [x - factor * y for x, y in zip(rows[i], rows[k])]
    return [row[n:] for row in rows]


def shapley_coefficients(m: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each of ``m`` filters the factors of the coalitions 0 .. 2^m - 1 in its Shapley value.

    The constrained problem's normal equations with a multiplier for the constraint: ``Z' W Z x + l 1 = Z' W v`` and
    ``1' x = v(all) - v(none)``, where the rows of ``Z`` are the coalitions but the empty and the full one.
    """
    full = (1 << m) - 1
    bit = lambda s, i: s >> i & 1
    weight = {}
    for s in range(1, full):
        k = s.bit_count()
        weight[s] = Fraction(m - 1, comb(m, k) * k * (m - k))
    matrix = [[sum((w for s, w in weight.items() if bit(s, i) and bit(s, j)), Fraction(0)) for j in range(m)] + [Fraction(1)] for i in range(m)]
    matrix.append([Fraction(1)] * m + [Fraction(0)])
    right = [[weight[s] * bit(s, i) if s in weight else Fraction(0) for s in range(full + 1)] for i in range(m)]
    # the shares explain what a coalition removes beyond the empty one
    for row in right:
        row[0] = -sum(row[1:], Fraction(0))
    right.append([Fraction(s == full) - Fraction(s == 0) for s in range(full + 1)])
    return solved(matrix, right)[:m]


def coalitions(counts: DataFrame) -> DataFrame:
    """One row per part: what each of the 32 coalitions removes (arrays by coalition), the documents, and per filter
    (arrays by filter) how many fail it, how many fail it alone, and the Shapley values times the number of orders."""
    removes = lambda s: F.col("bits").bitwiseAND(F.lit(s)) != 0
    sums = lambda col: F.array(*[F.sum(F.when(removes(s), F.col(col)).otherwise(0)) for s in range(_COALITIONS)])
    alone = F.array(*[F.sum(F.when(F.col("bits") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))])
    by_part = counts.groupBy("part").agg(
        F.sum("n").alias("n"), sums("n").alias("removed"), sums("n_good").alias("good"), sums("n_toxic").alias("toxic"), alone.alias("alone")
    )
    orders = factorial(len(FILTERS))
    shares = []
    for row in shapley_coefficients():
        scaled = [orders * c for c in row]
        assert all(c.denominator == 1 for c in scaled)
        terms = [F.get("removed", F.lit(s)) * int(c) for s, c in enumerate(scaled) if c]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        shares.append(total)
    return by_part.withColumn("shapley", F.array(*shares))


def steps() -> Column:
    """All steps of all orders, as an array: the order, the step, the filter's place, and the coalitions
    of it by itself, before and after the step."""
    made = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            after = before | 1 << f
            name = "".join(FILTERS[i] for i in order)
            made.append(f"struct('{name}' AS filter_order, {k + 1} AS step, {f} AS f, {1 << f} AS by_itself, {before} AS before, {after} AS after)")
            before = after
    return F.expr(f"array({', '.join(made)})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module for the columns."""
    rows = coalitions(failure_counts(docs, labels)).withColumn("s", F.explode(steps()))
    at = lambda col, place: F.get(F.col(col), F.col(f"s.{place}"))
    gained = lambda col: at(col, "after") - at(col, "before")
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        (F.col("n") - at("removed", "after")).alias("kept"),
        gained("removed").alias("removed"),
        (at("removed", "by_itself") - gained("removed")).alias("redundant"),
        at("alone", "f").alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        at("shapley", "f").alias("shapley"),
    )
