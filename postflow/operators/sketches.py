"""Mergeable sketches per day and key: distinct counts and quantiles of any range of days without reading its rows.

Sketches of fixed size are made once, when the rows are there; a query unions them. Its cost is the number of days and
keys, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct-count sketch, and the relative error that one estimate in 700 exceeds:
#: three times 1.04 / sqrt(2^14).
HLL_LOG = 14
HLL_ERROR = 0.025
#: Size of a quantile sketch, and the rank error (a share of all rows) that one query in a hundred exceeds for a single
#: quantile. Twice that is allowed for where several are asked for together.
KLL_SIZE = 400
KLL_ERROR = 0.0068


def daily(df: DataFrame, time: str, distinct: Column, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``day``, ``keys``, ``n``, ``distinct_sketch`` and ``value_sketch`` (a whole number) of the rows with a time.

    Partial sketches are made before the shuffle, so a day or key with a third of all rows moves as one row a task.
    """
    rows = df.where(F.col(time).isNotNull()).select(F.to_date(time).alias("day"), *keys, distinct.alias("_d"), value.cast("bigint").alias("_v"))
    return rows.groupBy("day", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_d", HLL_LOG).alias("distinct_sketch"), F.kll_sketch_agg_bigint("_v", KLL_SIZE).alias("value_sketch")
    )


def united(sketches: DataFrame, by: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """Sketches of the days from ``start`` to before ``end``, united by ``by`` (some of their keys)."""
    if start is not None:
        sketches = sketches.where(F.col("day") >= F.lit(start).cast("date"))
    if end is not None:
        sketches = sketches.where(F.col("day") < F.lit(end).cast("date"))
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_bigint("value_sketch").alias("value_sketch")
    )


def estimated(sketches: DataFrame, percentiles: Sequence[float] = ()) -> DataFrame:
    """``distinct_count`` and the ``percentiles`` (columns ``p50`` and so on) in place of the sketches."""
    kept = [c for c in sketches.columns if not c.endswith("_sketch")]
    quantile = [
        F.kll_sketch_get_quantile_bigint("value_sketch", F.lit(p)).alias(f"p{format(p * 100, 'g').replace('.', '_')}") for p in percentiles
    ]
    return sketches.select(*kept, F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), *quantile)
