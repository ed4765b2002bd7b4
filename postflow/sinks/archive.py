"""Bronze: the daily archive of raw envelopes, and its error branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow import schemas
from postflow.functions.keys import day_parts, seconds_part

DAY = ("year", "month", "day")


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes with a usable partition key, and the rest with its ``error_type``."""
    valid = seconds_part(F.col("data.created_at")).isNotNull()
    errors = events.where(~valid).withColumn("error_type", F.lit("metadata-extraction-failed"))
    return events.where(valid), errors


def archive_rows(events: DataFrame) -> DataFrame:
    """Envelope columns plus ``year``, ``month``, ``day`` from the post's own time."""
    envelope = [F.col(c) for c in schemas.ENVELOPE.names if c in events.columns]
    parts = day_parts(F.col("data.created_at"))
    return events.select(*envelope, *[c.alias(n) for n, c in parts.items()])


def write_bronze(events: DataFrame, path: str, batch: str, error_path: str | None = None, fmt: str = "json") -> None:
    """Appends one batch: gzip JSON lines (or Parquet) under ``year=/month=/day=/batch=``.

    Writing the same ``batch`` again replaces it. A day with a large share of the rows is split over tasks.
    """
    valid, errors = split_valid(events)
    _write(archive_rows(valid), path, batch, DAY, fmt)
    if error_path:
        envelope = [c for c in schemas.ENVELOPE.names if c in errors.columns]
        _write(errors.select(*envelope, "error_type"), error_path, batch, ("error_type",), fmt)


def _write(df: DataFrame, path: str, batch: str, partitions: tuple[str, ...], fmt: str) -> None:
    writer = (
        df.hint("rebalance", *partitions)
        .withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip" if fmt == "json" else "zstd")
        .partitionBy(*partitions, "batch")
    )
    writer.format(fmt).save(path)
