"""Counters that ride along with a job, and rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation | None]:
    """``df`` that counts its rows (``incoming``) and the rows for which each condition in ``counters`` holds.

    The numbers cost no extra pass: read ``observation.get`` after the action. On a stream they appear in the
    progress events under ``name``, and the second value is ``None``.
    """
    expressions = [F.count(F.lit(1)).alias("incoming")]
    expressions += [F.count_if(condition).alias(key) for key, condition in counters.items()]
    if df.isStreaming:
        return df.observe(name, *expressions), None
    observation = Observation(name)
    return df.observe(observation, *expressions), observation


def write_stats(df: DataFrame, failed: Column) -> dict[str, Column]:
    """Counters of a document writer: total, successful and failed documents."""
    return {"total": F.lit(True), "failed": failed, "successful": ~failed}


def filtered_rate(df: DataFrame, keep: Column) -> DataFrame:
    """Percentage of rows that ``keep`` drops; null for no rows."""
    dropped = F.when(F.coalesce(keep, F.lit(False)), 0.0).otherwise(1.0)
    return df.agg((F.avg(dropped) * 100).alias("filtered_rate"))


def summary(counters: Mapping[str, int]) -> str:
    """One log line."""
    return " ".join(f"{key}={value}" for key, value in sorted(counters.items()))
