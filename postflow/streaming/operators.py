"""Stream operators that keep state, and the plain file sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postflow import constants as K
from postflow import schemas
from postflow.operators.state import merge_metrics
from postflow.sinks.archive import DAY, archive_rows, split_valid
from postflow.sinks.tables import STATE_BUCKETS, KeyedTable, id_bucket
from postflow.sources.envelopes import stamp_arrival


def _first_of_batch(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows < 2:
                yield batch
                continue
            rows = pa.table({"k": batch.column(batch.schema.get_field_index(key)), "i": range(batch.num_rows)})
            first = rows.group_by("k").aggregate([("i", "min")])["i_min"]
            yield batch.take(pc.take(first, pc.sort_indices(first)).combine_chunks())

    return run


def dedupe_stream(
    df: DataFrame, key: str = "id", window: str = "5 days", time: str = "event_time", local_first: bool = True
) -> DataFrame:
    """One delivery per key within ``window`` of event time; rows without a time cannot be placed (see :func:`untimed`).

    ``local_first`` removes repeats inside each Arrow batch before rows move, so that a key delivered very
    often does not fill one task; the result is the same either way.
    """
    timed = df.where(F.col(time).isNotNull())
    if local_first:
        timed = timed.mapInArrow(_first_of_batch(key), df.schema)
    return timed.withWatermark(time, window).dropDuplicatesWithinWatermark([key])


def untimed(df: DataFrame, time: str = "event_time") -> DataFrame:
    """The rows that :func:`dedupe_stream` leaves out."""
    return df.where(F.col(time).isNull())


def histogram_stream(
    df: DataFrame, interval: str = "1 day", by: str | None = None, time: str = "created_at", delay: str = "1 day"
) -> DataFrame:
    """Documents per window, kept open for ``delay``; counts combine before the shuffle."""
    keys = [F.window(time, interval)]
    if by:
        keys.append(F.col(by).alias("key"))
    counts = df.withWatermark(time, delay).groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"))
    rest = ["key"] if by else []
    return counts.select(F.col("window.start").alias("bucket"), *rest, "doc_count")


def run_batches(
    df: DataFrame,
    handler: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Starts ``handler`` on every micro-batch; without ``interval`` what is there now is worked off, then it stops."""
    writer = df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def merge_stream(
    updates: DataFrame,
    table: KeyedTable,
    checkpoint: str,
    name: str = "merge",
    interval: str | None = None,
    buckets: int = STATE_BUCKETS,
) -> StreamingQuery:
    """Latest-wins metric merge of a stream into a state table.

    ``updates`` has ``id``, ``public_metrics`` and ``updated_at``; the table is partitioned by bucket of the id.
    A batch that is retried merges with the state as it was before, so its outcome is the same.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, tag = batch.sparkSession, f"{name}.{epoch}"
        if table.version_of(spark, tag) is not None or batch.isEmpty():
            return
        bucketed = batch.withColumn(table.partition, id_bucket(F.col("id"), buckets))
        stored = table.touched(table.read(spark, before=tag), bucketed)
        merged, _ = merge_metrics(stored.drop(table.partition), stamp_arrival(batch))
        table.write(merged.withColumn(table.partition, id_bucket(F.col("id"), buckets)), tag)

    return run_batches(updates, merge, checkpoint, interval)


def archive_stream(
    events: DataFrame, path: str, error_path: str, checkpoint: str, interval: str | None = K.ARCHIVE_TRIGGER
) -> tuple[StreamingQuery, StreamingQuery]:
    """Bronze as plain file sinks: gzip JSON lines by day, one flush per trigger; records without a usable day go to
    ``error_path`` by type of error. The two queries together have every record."""
    valid, errors = split_valid(events)
    envelope = [c for c in schemas.ENVELOPE.names if c in errors.columns]
    branches = ((archive_rows(valid), DAY, path, "valid"), (errors.select(*envelope, "error_type"), ("error_type",), error_path, "errors"))
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return tuple(
        rows.writeStream.format("json")
        .option("compression", "gzip")
        .option("checkpointLocation", f"{checkpoint}/{name}")
        .partitionBy(*parts)
        .trigger(**trigger)
        .start(out)
        for rows, parts, out, name in branches
    )
