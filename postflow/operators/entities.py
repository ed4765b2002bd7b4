"""Dictionary entities from a table of terms, of any size and constant plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.text import tokens
from postflow.operators.skew import small_lookup

#: Most words of a term. Runs of so many words of every text are looked up.
LONGEST = 8
SCORE = 0.95


def dictionary_terms(dictionary: DataFrame) -> DataFrame:
    """``(term, type)`` rows as ``phrase`` (the term's words with one blank between), ``n`` words and ``type``.

    Terms that are the same phrase are one, of the first type by name; terms without a word are none.
    """
    phrase = F.array_join("_words", " ")
    rows = dictionary.select("type", tokens(F.col("term")).alias("_words")).where(F.size("_words") > 0)
    return rows.select(phrase.alias("phrase"), F.size("_words").alias("n"), "type").groupBy("phrase", "n").agg(F.min("type").alias("type"))


def _runs(words: Column, n: int) -> Column:
    """All runs of ``n`` words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return words if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def dictionary_entities(texts: DataFrame, dictionary: DataFrame, key: str = "cache_key", text: str = "normalized_text") -> DataFrame:
    """``key`` and ``entities`` (each term once, in order of its phrase) of the texts that hold a term as whole words.

    ``texts`` has one row per key. Runs of words meet the terms in a join: a dictionary that is short (it is counted)
    goes to the texts, a longer one is met by shuffle with frequent phrases spread. Only the lengths that terms have are
    looked up, and only hits are grouped.
    """
    terms = dictionary_terms(dictionary)
    # at most LONGEST numbers
    lengths = sorted(r["n"] for r in terms.select(F.least("n", F.lit(LONGEST + 1)).alias("n")).distinct().collect())
    if lengths and lengths[-1] > LONGEST:
        raise ValueError(f"a term has more than {LONGEST} words")
    words = texts.select(key, tokens(F.col(text)).alias("_words"))
    runs = F.concat(*[_runs(F.col("_words"), n) for n in lengths]) if lengths else F.array().cast("array<string>")
    found = words.select(key, F.explode(F.array_distinct(runs)).alias("phrase"))
    hits = small_lookup(found, terms.select("phrase", "type"), "phrase", "inner", spread=[F.col(key)])
    entity = F.struct(F.col("phrase").alias("text"), F.col("type"), F.lit(SCORE).alias("score"))
    return hits.groupBy(key).agg(F.sort_array(F.collect_list(entity)).alias("entities"))
