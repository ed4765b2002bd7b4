"""Full-text match: on the fly, or against an inverted table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow.functions.text import tokens
from postflow.operators.query import _top, searchable
from postflow.operators.skew import small_lookup

INDEX_BUCKETS = 64


def field_tokens(df: DataFrame, field: str, dictionary: Iterable[str] = (), stop_words: Iterable[str] = ()) -> Column:
    """Distinct tokens of a text field, or of all values of a multi-valued one."""
    col = F.col(searchable(field))
    if isinstance(df.select(col).schema[0].dataType, T.ArrayType):
        col = F.array_join(col, "\n")
    return F.array_distinct(tokens(col, dictionary, stop_words))


def canonical_terms(rows: DataFrame, synonyms: DataFrame, token: str = "token") -> DataFrame:
    """Replaces ``token`` by the first term of its synonym group; unknown tokens stay.

    ``synonyms`` has ``(term, canonical)`` with one row per term.
    """
    mapping = synonyms.select(F.col("term").alias(token), "canonical")
    joined = small_lookup(rows, mapping, token, "left")
    return joined.withColumn(token, F.coalesce("canonical", token)).select(*rows.columns)


def query_terms(query: str | Sequence[str], dictionary: Iterable[str] = (), stop_words: Iterable[str] = ()) -> Column:
    """Distinct terms of a query, analysed as documents are; of a list each item is analysed."""
    text = query if isinstance(query, str) else "\n".join(query)
    return F.array_distinct(tokens(F.lit(text), dictionary, stop_words))


def match(
    df: DataFrame,
    field: str,
    query: str | Sequence[str],
    op: str = "any",
    dictionary: Iterable[str] = (),
    stop_words: Iterable[str] = (),
) -> DataFrame:
    """Documents whose field has any (or all) of the query's terms; a query without terms matches none. No shuffle."""
    dictionary, stop_words = list(dictionary), list(stop_words)
    wanted = query_terms(query, dictionary, stop_words)
    found = field_tokens(df, field, dictionary, stop_words)
    if op == "any":
        condition = F.arrays_overlap(found, wanted)
    elif op == "all":
        condition = (F.size(wanted) > 0) & (F.size(F.array_intersect(found, wanted)) == F.size(wanted))
    else:
        raise ValueError(f"unknown operator {op!r}")
    return df.where(F.coalesce(condition, F.lit(False)))


def build_inverted_index(
    df: DataFrame,
    field: str,
    dictionary: Iterable[str] = (),
    stop_words: Iterable[str] = (),
    synonyms: DataFrame | None = None,
    buckets: int = INDEX_BUCKETS,
) -> DataFrame:
    """``(token_bucket, token, id)``, one row per document and distinct token; postings stay rows, never arrays.

    Write it with :func:`write_index`; a search then reads only the buckets and row groups of its terms.
    """
    rows = df.select("id", F.explode(field_tokens(df, field, dictionary, stop_words)).alias("token"))
    if synonyms is not None:
        rows = canonical_terms(rows, synonyms).distinct()
    return rows.select(_bucket(F.col("token"), buckets).alias("token_bucket"), "token", "id")


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(index: DataFrame, path: str) -> None:
    """Buckets become partitions; oversized ones (frequent tokens) are split over several tasks and files."""
    balanced = index.hint("rebalance", "token_bucket").sortWithinPartitions("token_bucket", "token")
    balanced.write.mode("overwrite").partitionBy("token_bucket").parquet(path)


def search_index(
    index: DataFrame,
    query: str | Sequence[str],
    op: str = "any",
    synonyms: dict[str, str] | None = None,
    buckets: int = INDEX_BUCKETS,
    dictionary: Iterable[str] = (),
    stop_words: Iterable[str] = (),
) -> DataFrame:
    """Ids of the documents with any (or all) of the terms; a query without terms finds none.

    ``synonyms``, ``dictionary`` and ``stop_words`` are those the index was built with.
    """
    # the terms of one query are known before the index is read, so that only their buckets are
    terms = index.sparkSession.range(1).select(query_terms(query, dictionary, stop_words)).first()[0]
    wanted = list(dict.fromkeys((synonyms or {}).get(t, t) for t in terms))
    in_buckets = F.array(*[_bucket(F.lit(w), buckets) for w in wanted]).cast("array<int>")
    rows = index.where(F.array_contains(in_buckets, F.col("token_bucket").cast("int")) & F.col("token").isin(wanted))
    if op == "any":
        return rows.select("id").distinct()
    if op == "all":
        counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
        return counts.where(F.col("_n") == len(wanted)).select("id")
    raise ValueError(f"unknown operator {op!r}")


def token_freq(df: DataFrame, field: str, n: int | None = 10, dictionary: Iterable[str] = ()) -> DataFrame:
    """Terms by number of documents that have them."""
    return _top(df.select(F.explode(field_tokens(df, field, dictionary)).alias("key")), n)
