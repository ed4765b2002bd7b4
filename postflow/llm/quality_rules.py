"""Quality rules with thresholds that follow the corpus.

Every document gets a few measures. Documents that pass fixed base rules feed a quantile sketch of each measure for
each language and source; a document is rejected when a measure lies outside the fences that its own language and
source give. Everything is column expressions, one narrow pass for the measures and small aggregates for the sketches.

**Sketch.** A log-linear histogram: a value keeps its six leading bits, so a bucket is at most 1/32 of its value wide
and a sketch has at most some hundred buckets. Two sketches merge by adding counts. That makes it exact in its merges
(the result doesn't depend on partitions or order) and lets Spark combine it before the shuffle, so a language or
source with a third of the rows sends as little as any other. Sketches of small groups are merged upwards: a group
with fewer than ``min_rows`` rows takes the fences of its language, and a small language those of all rows.

**Defined cases.** A null text counts as empty: no words, base rules failed. Null languages and sources are groups of
their own. Rows are judged one by one, so repeated rows and ids stay. An empty table gives an empty table. Columns of
the input are kept by :func:`judge`, except those that have the name of a measure, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.llm.common import SPACE_CHARS, aside, small, text_of, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Rows a group needs for fences of its own.
MIN_ROWS = 200
#: A fence is this many spreads beyond the quartile.
SPREADS = 3
#: Measures and the least spread each is given: a measure that is constant in a clean source must not reject noise.
#: Symbols per 1000 words, capitals in runs of three per 1000 characters, repeated lines per
#: 1000 lines, hundredths of a character per word.
SPREAD = {"symbol_rate": 60, "caps_rate": 100, "dup_line_rate": 150, "word_length": 1}
#: A spread is also at least the lower quartile divided by this, so that what a language's words are long by counts.
SHARE = 8
#: Measures that can also be too small.
TWO_SIDED = ("word_length",)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _same_hash(rows: str, i: Column, j: Column) -> Column:
    return F.coalesce(F.get(F.col(rows), i)["h"] == F.get(F.col(rows), j)["h"], F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of :data:`COUNTS`, ``n_lines``, the rates of :data:`SPREAD` and ``base_failed``.

    Windows of words are compared by 64-bit hashes within one document. Windows are sorted only in documents in which
    some hash occurs twice; a document of n words costs n log n at most.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {*COUNTS, *SPREAD, "n_lines", "base_failed"}]
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: F.octet_length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    step = docs.select(
        *kept,
        words_of(text).alias("_words"),
        lines.alias("_lines"),
        (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (3 * F.regexp_count(text, F.lit(r"\p{Lu}{3}"))).cast("long").alias("_caps"),
    )
    counts = ["word_chars", "n_symbols", "_caps"]
    step = step.select(
        *kept,
        *counts,
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_hashes"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    window = F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + k) for k in range(WINDOW)]),
    )
    step = step.select(*kept, *counts, F.when(F.col("n_words") >= WINDOW, window).alias("_windows"))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    step = step.select(*kept, *counts, F.when(repeats, pairs).alias("_pairs"))
    twice = F.filter(
        F.sequence(F.lit(0), F.size("_pairs") - 1),
        lambda i: _same_hash("_pairs", i, i - 1) | _same_hash("_pairs", i, i + 1),
    )
    starts = F.sort_array(F.transform(twice, lambda i: F.get(F.col("_pairs"), i)["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda so_far, i: F.struct(
            i.alias("last"), (so_far["n"] + F.least(F.lit(WINDOW), i - so_far["last"])).cast("long").alias("n")
        ),
        lambda so_far: so_far["n"],
    )
    step = step.select(*kept, *counts, F.when(F.col("_pairs").isNotNull(), covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"))

    def rate(count: str, factor: int, of: str) -> Column:
        return F.when(F.col(of) > 0, F.expr(f"{factor} * {count} div {of}")).otherwise(F.lit(0).cast("long"))

    return step.select(
        *kept,
        *COUNTS,
        "n_lines",
        rate("n_symbols", 1000, "n_words").alias("symbol_rate"),
        rate("_caps", 1000, "word_chars").alias("caps_rate"),
        rate("n_dup_lines", 1000, "n_lines").alias("dup_line_rate"),
        rate("word_chars", 100, "n_words").alias("word_length"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def sketch(rows: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts by ``keys``, measure and bucket over the rows that passed the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in SPREAD])).alias("m")
    bucket = F.expr("shiftleft(shiftright(value, greatest(length(bin(value)) - 6, 0)), greatest(length(bin(value)) - 6, 0))")
    return (
        rows.where(~F.col("base_failed"))
        .select(*keys, values)
        .select(*keys, "m.*")
        .groupBy(*keys, "measure", bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sketches with fewer keys: counts of the same bucket add up."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """For each group of ``keys`` its rows ``n_rows`` and, for each measure m, ``low_m`` and ``high_m``."""
    quantile = F.expr("(total + 3) div 4"), F.expr("(3 * total + 3) div 4")
    cumulated = sketches.selectExpr(
        *keys,
        "measure",
        "bucket",
        f"sum(n) OVER (PARTITION BY {', '.join([*keys, 'measure'])} ORDER BY bucket) AS upto",
        f"sum(n) OVER (PARTITION BY {', '.join([*keys, 'measure'])}) AS total",
    )
    quartiles = cumulated.groupBy(*keys, "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") >= quantile[0], F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") >= quantile[1], F.col("bucket"))).alias("q3"),
    )
    least = F.element_at(F.create_map(*[x for m, s in SPREAD.items() for x in (F.lit(m), F.lit(s).cast("long"))]), F.col("measure"))
    spread = SPREADS * F.greatest(F.col("q3") - F.col("q1"), least, F.expr(f"q1 div {SHARE}"))
    ends = quartiles.select(*keys, "measure", "total", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    return ends.groupBy(*keys).agg(
        F.max("total").alias("n_rows"),
        *[F.max(F.when(F.col("measure") == m, F.col("low"))).alias(f"low_{m}") for m in TWO_SIDED],
        *[F.max(F.when(F.col("measure") == m, F.col("high"))).alias(f"high_{m}") for m in SPREAD],
    )


def thresholds(sketches: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The fences that hold for each language and source: its own, its language's or those of all rows."""
    values = [*[f"low_{m}" for m in TWO_SIDED], *[f"high_{m}" for m in SPREAD]]
    own = fences(sketches, ("lang", "source")).alias("own")
    lang = fences(merged(sketches, ("lang",)), ("lang",)).alias("by_lang")
    whole = fences(merged(sketches, ()).withColumn("every", F.lit(1)), ("every",)).alias("whole")
    chosen = [
        F.when(F.col("own.n_rows") >= min_rows, F.col(f"own.{v}"))
        .when(F.col("by_lang.n_rows") >= min_rows, F.col(f"by_lang.{v}"))
        .otherwise(F.col(f"whole.{v}"))
        .alias(v)
        for v in values
    ]
    joined = own.join(lang, F.col("own.lang").eqNullSafe(F.col("by_lang.lang")))
    # `whole` is one row
    return joined.join(F.broadcast(whole), F.lit(1) == F.col("whole.every")).select(
        F.col("own.lang").alias("_lang"), F.col("own.source").alias("_source"), *chosen
    )


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured` with ``kept``, by the limits of each row's language and source."""
    inside = [F.col(m) <= F.col(f"high_{m}") for m in SPREAD] + [F.col(m) >= F.col(f"low_{m}") for m in TWO_SIDED]
    good = ~F.col("base_failed")
    for condition in inside:
        good = good & condition
    same = rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"])
    # a group without a limit has no row that passed the base rules
    return rows.join(limits, same, "left").select(*[rows[f"`{c}`"] for c in rows.columns], F.coalesce(good, F.lit(False)).alias("kept"))


def _limits(docs: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """The measures, written without the texts, and the limits that follow from them.

    Measures have to be written before they are filtered: Spark moves a filter in front of what computes its columns,
    and would compute them for every element of the arrays they are made of.
    """
    rows = written(measured(docs).drop("text"), "quality-measures")
    return rows, small(written(thresholds(sketch(rows), min_rows), "quality-limits"))


def judge(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per document: the columns but its text, the counts and rates, ``base_failed`` and ``kept``.

    The measures are computed once and written, without the texts; sketches and verdicts read them.
    """
    docs, named = aside(docs, "text", "lang", "source")
    rows = judged(*_limits(docs, min_rows))
    new = [c for c in rows.columns if c not in docs.columns]
    return rows.select(*[column for c, column in named.items() if c != "text" and c not in new], *new)


def keep_good(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The documents whose verdict is ``kept``, with their columns unchanged.

    The texts are never shuffled: the measures are computed a second time beside them, against limits small enough to
    be sent to every executor (checked; a larger table of limits is joined by a shuffle).
    """
    _, limits = _limits(docs.select("text", "lang", "source"), min_rows)
    # columns of the input that are named like a measure are put aside
    docs, named = aside(docs, "text", "lang", "source")
    return judged(measured(docs), limits).where("kept").select(*named.values())
