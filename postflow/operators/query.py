"""Dashboard queries over documents: filters, facets, histograms, statistics, geo."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow.functions.keys import month_key

NOT_FILTERABLE = K.NOT_FILTERABLE
SENTIMENTS = ("POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED")
#: Parts of a group, one of which is sorted for a percentile.
PARTS = 64


def _type_of(df: DataFrame, field: str) -> T.DataType:
    return df.select(F.col(field)).schema[0].dataType


def searchable(field: str) -> str:
    if field in NOT_FILTERABLE:
        raise ValueError(f"{field} is stored for retrieval only")
    return field


def term_filter(df: DataFrame, field: str, value) -> DataFrame:
    """Exact value; of a multi-valued field any value may match."""
    col = F.col(searchable(field))
    if isinstance(_type_of(df, field), T.ArrayType):
        return df.where(F.coalesce(F.array_contains(col, value), F.lit(False)))
    return df.where(col == value)


def in_range(df: DataFrame, start: str, end: str, time: str = "created_at", month: str = "month") -> DataFrame:
    """``start <= time < end``, with the matching condition on the partition column so that other months are skipped."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = df.where((F.col(time) >= first) & (F.col(time) < last))
    if month in df.columns:
        rows = rows.where(F.col(month).between(month_key(first), month_key(last)))
    return rows


def _top(keys: DataFrame, n: int | None) -> DataFrame:
    counts = keys.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
    ordered = counts.orderBy(F.desc("doc_count"), F.asc("key"))
    return ordered if n is None else ordered.limit(n)


def terms(df: DataFrame, field: str, n: int | None = 10) -> DataFrame:
    """Most frequent values: ``key``, ``doc_count``."""
    return _top(df.select(F.col(searchable(field)).alias("key")), n)


def terms_multi(df: DataFrame, field: str, n: int | None = 10) -> DataFrame:
    """Most frequent values of a multi-valued field; a document counts once per distinct value."""
    return _top(df.select(F.explode(F.array_distinct(F.col(searchable(field)))).alias("key")), n)


def date_histogram(
    df: DataFrame, interval: str = "day", by: str | None = None, time: str = "created_at"
) -> DataFrame:
    """Documents per hour, day or month (``bucket``), optionally split by a keyword."""
    if interval not in ("hour", "day", "month"):
        raise ValueError(f"unknown interval {interval!r}")
    keys = [F.date_trunc(interval, F.col(time)).alias("bucket")]
    if by:
        keys.append(F.col(searchable(by)).alias("key"))
    return df.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"))


def metric_stats(
    df: DataFrame,
    field: str,
    by: str | None = None,
    percentiles: Sequence[float] = (0.5, 0.95),
    accuracy: int = 10_000,
) -> DataFrame:
    """Count, sum, average, minimum, maximum and percentiles of a number.

    Percentiles are exact: the smallest value with at least that share of the group's values up to it. Mergeable summaries
    of at most ``accuracy`` cut each group into parts, whose counts say which part holds the percentile; only the values
    of that part are sorted, so one large group stays small. The cuts decide the size of the parts, not the result.
    """
    rows = df.select((F.col(searchable(by)) if by else F.lit(True)).alias("key"), F.col(field).alias("_x"))
    grouped = rows.groupBy("key") if by else rows.groupBy()
    stats = grouped.agg(
        F.count("_x").alias("value_count"),
        F.sum("_x").alias("value_sum"),
        F.avg("_x").alias("value_avg"),
        F.min("_x").alias("value_min"),
        F.max("_x").alias("value_max"),
    )
    if percentiles:
        found = _percentiles(rows, percentiles, accuracy).withColumnRenamed("key", "_key")
        stats = stats.join(found, F.col("key").eqNullSafe(F.col("_key")) if by else F.lit(True), "left").drop("_key")
    return stats


def _percentiles(rows: DataFrame, percentiles: Sequence[float], accuracy: int) -> DataFrame:
    """One row per ``key`` with a column for each percentile of ``_x``."""
    names = {p: f"p{format(p * 100, 'g').replace('.', '_')}" for p in percentiles}
    known = rows.where(F.col("_x").isNotNull())
    cuts = known.groupBy(F.col("key").alias("_key")).agg(
        F.percentile_approx("_x", [i / PARTS for i in range(1, PARTS)], accuracy).alias("_cuts"), F.count("_x").alias("_n")
    )
    values = known.groupBy("key", "_x").agg(F.count("_x").alias("_rows"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    values = values.join(cuts, F.col("key").eqNullSafe(F.col("_key"))).select("key", "_x", "_rows", "_n", part.alias("_part"))

    parts = values.groupBy("key", "_part").agg(F.sum("_rows").alias("_rows"), F.first("_n").alias("_n"))
    before = F.sum("_rows").over(Window.partitionBy("key").orderBy("_part")) - F.col("_rows")
    rank = lambda p: F.greatest(F.ceil(F.lit(Decimal(str(p))) * F.col("_n")).cast("bigint"), F.lit(1).cast("bigint"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(p).alias("rank")) for p, name in names.items()]))
    ranked = parts.withColumn("_before", before).withColumn("_p", wanted)
    holds = (F.col("_before") < F.col("_p.rank")) & (F.col("_p.rank") <= F.col("_before") + F.col("_rows"))
    holding = ranked.where(holds).select(
        F.col("key").alias("_key"), F.col("_part").alias("_in"), F.col("_p.name").alias("_name"), (F.col("_p.rank") - F.col("_before")).alias("_rank")
    )
    inside = values.join(holding, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")))
    upto = F.sum("_rows").over(Window.partitionBy("key", "_name").orderBy("_x"))
    at = inside.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_rank"))
    return at.groupBy("key").agg(*[F.min(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in names.values()])


def cardinality(df: DataFrame, field: str, exact: bool = False, rsd: float = 0.02) -> DataFrame:
    """Number of distinct values; approximate by a fixed-size sketch unless ``exact``."""
    col = F.col(searchable(field))
    return df.agg((F.count_distinct(col) if exact else F.approx_count_distinct(col, rsd)).alias("value"))


def sentiment_over_time(df: DataFrame, interval: str = "day", time: str = "created_at") -> DataFrame:
    """Per bucket: documents per sentiment and the mean positive and negative score."""
    sentiment, score = F.col("comprehend.sentiment"), F.col("comprehend.sentiment_score")
    counts = [F.count_if(sentiment == s).alias(s.lower()) for s in SENTIMENTS]
    means = [F.avg(score[n]).alias(f"mean_{n}") for n in ("positive", "negative")]
    rows = df.where(F.col(time).isNotNull() & sentiment.isNotNull())
    return rows.groupBy(F.date_trunc(interval, F.col(time)).alias("bucket")).agg(*counts, *means)


def _point(field: str) -> tuple[Column, Column]:
    point = F.col(field)
    return F.get(point, F.lit(0)), F.get(point, F.lit(1))


def geo_box(
    df: DataFrame,
    west: float,
    south: float,
    east: float,
    north: float,
    field: str = "geo.coordinates.coordinates",
) -> DataFrame:
    """Points inside the box; ``west > east`` means a box across the date line."""
    lon, lat = _point(field)
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return df.where(inside & lat.between(south, north))


def geo_distance(
    df: DataFrame, lon: float, lat: float, km: float, field: str = "geo.coordinates.coordinates"
) -> DataFrame:
    """Points within ``km`` of a place (great circle on a sphere); a latitude band is cut first."""
    plon, plat = _point(field)
    radius = 6371.0088
    half = F.sin(F.radians(plat - lat) / 2)
    half_lon = F.sin(F.radians(plon - lon) / 2)
    a = half * half + F.cos(F.radians(plat)) * F.cos(F.radians(F.lit(lat))) * half_lon * half_lon
    distance = 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
    band = km / 111.0
    # the least of nothing and one would be one, and half of a point at the other end of the world
    known = a.isNotNull() & ~F.isnan(a)
    return df.where(plat.between(lat - band, lat + band) & known & (distance <= km))
