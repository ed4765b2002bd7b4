"""Events out: bus records, re-publishing, fail-over."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow import constants as K
from postflow import schemas

log = logging.getLogger(__name__)


def _envelope_json(df: DataFrame):
    return F.to_json(F.struct(*[F.col(c) for c in schemas.ENVELOPE.names if c in df.columns]))


def emit(events: DataFrame, detail_type: str) -> DataFrame:
    """Bus records: ``source``, ``detail_type``, ``time`` and the envelope as JSON in ``detail``."""
    return events.select(
        F.lit(K.BUS_SOURCE).alias("source"),
        F.lit(detail_type).alias("detail_type"),
        F.col("event_time").alias("time"),
        _envelope_json(events).alias("detail"),
    )


def republish(envelopes: DataFrame) -> DataFrame:
    """``(key, value)`` records keyed by post id, the form a Kafka sink takes.

    The sink partitions by key, so nothing is shuffled here and no post can become a hot partition of ours.
    """
    return envelopes.select(F.col("data.id").alias("key"), _envelope_json(envelopes).alias("value"))


def start_republish(
    envelopes: DataFrame, path: str, checkpoint: str, interval: str = "1 second", available_now: bool = False
):
    """Re-publishes a stream as files, one for each task of a micro-batch.

    The pace is bytes or files per trigger (set at the source) times trigger interval, and so is the size of the files.
    """
    writer = (
        republish(envelopes)
        .writeStream.format("json")
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(path)


def write_with_failover(batch: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]]) -> str:
    """Tries the sinks in order of name and returns the name of the first that takes the batch.

    Failures are logged. If all fail the last error is raised, so that a stream retries rather than loses the batch.
    """
    error: Exception | None = None
    for name in sorted(sinks):
        try:
            sinks[name](batch)
            return name
        except Exception as failure:
            log.error("sink %s failed: %s", name, failure)
            error = failure
    raise RuntimeError("no sink accepted the batch") from error
