"""Live ingest and the batch jobs over history. All are compositions of the operators."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postflow import constants as K
from postflow import schemas
from postflow.functions.keys import month_key, to_time
from postflow.operators import filters
from postflow.operators.analysis import LexiconScorer, PandasScorer, analyze
from postflow.operators.document import to_document, upsert_documents
from postflow.operators.fanout import distinct_ids, fanout, hydrate
from postflow.operators.metrics import counted, filtered_rate, summary, write_stats
from postflow.operators.skew import keep_matching, lookup_join
from postflow.operators.state import (
    attach_analysis,
    join_state,
    last_row,
    latest_by_version,
    to_state_row,
    update_applies,
)
from postflow.sinks.archive import write_bronze
from postflow.sinks.listing import LISTING, in_listed_buckets, is_complete, listing_rows, rebuild
from postflow.sinks.publish import republish, start_republish
from postflow.sinks.tables import STATE_BUCKETS, BatchLog, KeyedTable, id_bucket
from postflow.sources.envelopes import CORRUPT, read_archive, read_legacy_ids, split_readable, stamp_arrival, stream_errors, to_bus_events, unreadable
from postflow.sources.lists import scan_state_by_year
from postflow.streaming.operators import dedupe_stream, run_batches
from postflow.streaming.post_state import EXPIRED, keyed_events, state_changes

log = logging.getLogger(__name__)

_TEXT = T.StringType()
_STATE_FIELDS = [*schemas.STATE.fields, T.StructField("bucket", _TEXT)]
_CHANGE_FIELDS = [*_STATE_FIELDS, T.StructField("event_name", _TEXT)]
_SCORED = T.StructType(
    [
        T.StructField("cache_key", _TEXT),
        T.StructField("result", schemas.ANALYSIS),
        T.StructField("ok", T.BooleanType()),
        T.StructField("posts", T.LongType()),
    ]
)


COUNTERS = T.StructType([T.StructField("step", _TEXT), T.StructField("counter", _TEXT), T.StructField("value", T.LongType())])
UNREADABLE = T.StructType(
    [
        T.StructField("place", _TEXT),
        T.StructField("position", T.LongType()),
        T.StructField("line", T.LongType()),
        T.StructField("reason", _TEXT),
        T.StructField("record", _TEXT),
    ]
)


@dataclass(frozen=True)
class Warehouse:
    """The tables of one deployment below a shared ``root``."""

    root: str
    buckets: int = STATE_BUCKETS

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def bronze_errors(self) -> str:
        return f"{self.root}/bronze-errors"

    @property
    def state(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/state", T.StructType(_STATE_FIELDS), "bucket", ("created_at", "id"))

    @property
    def times(self) -> BatchLog:
        """When the posts of the state table were created, and in which bucket they are."""
        return BatchLog(f"{self.root}/times", LISTING)

    @property
    def gold(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/gold", schemas.DOCUMENT, "month")

    @property
    def cache(self) -> BatchLog:
        return BatchLog(f"{self.root}/cache", schemas.CACHE)

    @property
    def changes(self) -> BatchLog:
        """Change feed: the new image of every row a batch wrote."""
        return BatchLog(f"{self.root}/changes", T.StructType(_CHANGE_FIELDS))

    @property
    def touched(self) -> BatchLog:
        """Rows of a batch before analysis."""
        flags = [T.StructField("fresh", T.BooleanType())]
        return BatchLog(f"{self.root}/touched", T.StructType([*_CHANGE_FIELDS, *flags]))

    @property
    def unreadable(self) -> BatchLog:
        """Lines and files that could not be read, by the batch that met them."""
        return BatchLog(f"{self.root}/unreadable", UNREADABLE)

    @property
    def stream_errors(self) -> BatchLog:
        """What the stream itself reported as errors."""
        return BatchLog(f"{self.root}/stream-errors", T.StructType([T.StructField("id", _TEXT), *schemas.ERRORS.elementType.fields]))

    @property
    def counters(self) -> BatchLog:
        """Counters of every batch, by the step that counted."""
        return BatchLog(f"{self.root}/counters", COUNTERS)

    @property
    def scored(self) -> BatchLog:
        return BatchLog(f"{self.root}/scored", _SCORED)

    @property
    def dropped(self) -> BatchLog:
        """Change records that became no document, with the reason."""
        return BatchLog(f"{self.root}/dropped", T.StructType([T.StructField(n, _TEXT) for n in ("id", "created_at", "reason")]))


@dataclass(frozen=True)
class IngestConfig:
    warehouse: Warehouse
    scorer: LexiconScorer | PandasScorer
    denied_domains: Sequence[str] = K.DENIED_CONTEXT_DOMAINS
    deny_mode: str = "none"
    cache_days: int = K.CACHE_DAYS
    archive: bool = True
    now: Column | None = field(default=None)


# --- live ingest -------------------------------------------------------------------------------


def touched_rows(events: DataFrame, state: DataFrame, config: IngestConfig) -> DataFrame:
    """New images of the rows that ``events`` (with ``arrival``) change, one per id, before analysis.

    ``fresh`` marks rows replaced as a whole: new posts, and included posts seen with their text for the first time.
    Of ``state`` only the buckets of this batch are read, and of those only the rows with its ids go further.
    """
    table, buckets = config.warehouse.state, config.warehouse.buckets
    main = filters.new_posts(events, config.denied_domains, config.deny_mode)
    puts = last_row(to_state_row(main, config.now, keep=["arrival"]))
    included = filters.included_posts(fanout(main), config.denied_domains, config.deny_mode)
    updates = to_state_row(included, config.now, keep=["arrival"])
    # an update that arrived before the last put of its post leaves no trace
    put_times = puts.select("id", F.col("arrival").alias("_put"))
    later = lookup_join(updates, put_times, "id", "left", spread=[F.col("arrival")])
    later = later.where(F.col("_put").isNull() | (F.col("arrival") > F.col("_put"))).drop("_put")
    best = latest_by_version(later)

    ids = main.select(F.col("data.id").alias("id")).union(included.select("data.id")).distinct()
    near = table.touched(state, ids.select(id_bucket(F.col("id"), buckets).alias(table.partition)))
    state = keep_matching(near, ids, "id")

    columns = schemas.STATE.names
    row = F.struct(*[F.col(c) for c in columns])
    pairs = puts.select("id", row.alias("put")).join(best.select("id", row.alias("upd")), "id", "full_outer")
    joined = join_state(pairs, state.select(*columns))

    put, upd, stored = F.col("put"), F.col("upd"), F.col("stored")
    base = F.coalesce(put, stored)
    applies = upd.isNotNull() & update_applies(base["updated_at"], base.isNotNull(), upd["updated_at"])
    promoted = applies & base["text"].isNull()
    image = (
        F.when(promoted, upd)
        .when(
            applies,
            base.withField("public_metrics", upd["public_metrics"]).withField("updated_at", upd["updated_at"]),
        )
        .otherwise(put)
    )
    event_name = F.when(stored.isNull(), "INSERT").otherwise("MODIFY")
    rows = joined.select(
        image.alias("image"), event_name.alias("event_name"), (put.isNotNull() | promoted).alias("fresh")
    ).where(F.col("image").isNotNull())
    bucket = id_bucket(F.col("image.id"), buckets)
    return rows.select("image.*", bucket.alias("bucket"), "event_name", "fresh")


def ingest_batch(events: DataFrame, tag: str, config: IngestConfig) -> None:
    """Takes one batch of bus events through archive, analysis, state and index.

    Every step writes under ``tag`` and reads state as it was before ``tag``: a batch repeated after a crash
    ends in the same tables.
    """
    spark, house = events.sparkSession, config.warehouse
    if house.gold.version_of(spark, tag) is not None:
        return
    events = stamp_arrival(events).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if events.isEmpty():  # a stream with state also runs batches without data
            return
        if config.archive:
            write_bronze(filters.archivable(events), house.bronze, tag, house.bronze_errors)
        set_aside(events, house, tag)
        events = events.where(F.col("data.id").isNotNull())
        before = house.state.read(spark, before=tag)
        touched = house.touched.save(touched_rows(events, before, config), tag)
    finally:
        events.unpersist()

    changes = analysed_changes(touched, tag, config)
    kept = house.state.touched(before, changes).join(changes.select("id"), "id", "left_anti")
    house.state.write(kept.unionByName(changes.drop("event_name")), tag)
    # updates of a stored post leave its time as it is
    house.times.write(listing_rows(touched.where(F.col("fresh") | (F.col("event_name") == "INSERT"))), tag)
    index_changes(changes, house, tag)


def set_aside(events: DataFrame, house: Warehouse, tag: str) -> None:
    """Lines that are no envelope to the log of unreadable ones, errors that the stream reported to theirs."""
    if CORRUPT in events.columns:
        house.unreadable.write(split_readable(events)[1], tag)
    house.stream_errors.write(stream_errors(events), tag)


def analysed_changes(touched: DataFrame, tag: str, config: IngestConfig) -> DataFrame:
    """The touched rows with the analysis of those that are fresh, saved as the batch's part of the change log."""
    spark, house = touched.sparkSession, config.warehouse
    now = F.current_timestamp() if config.now is None else config.now
    cache = house.cache.read(spark, without=tag)
    text = F.when(F.col("fresh"), F.col("text"))
    analysed, cache_rows = analyze(
        touched.withColumn("_text", text),
        cache,
        config.scorer,
        now,
        config.cache_days,
        text="_text",
        save=lambda scored: house.scored.save(scored, tag),
    )
    house.cache.write(cache_rows, tag)
    fresh = F.col("fresh")
    images = analysed.withColumns(
        {
            "comprehend": F.when(fresh, F.col("analysis")).otherwise(F.col("comprehend")),
            "normalized_text": F.when(fresh, F.col("analysis.normalized_text")).otherwise(F.col("normalized_text")),
        }
    )
    kind = F.col("event_name")
    counted_images, seen = counted(
        images, f"changes-{tag}", inserted=kind == "INSERT", modified=kind == "MODIFY", fresh=F.col("fresh"), analysed=F.col("fresh") & F.col("comprehend.sentiment").isNotNull()
    )
    changes = house.changes.save(counted_images, tag)
    _write_counters(house, spark, tag, "changes", seen)
    return changes


def _write_counters(house: Warehouse, spark: SparkSession, tag: str, step: str, seen: Observation) -> None:
    """What a step counted while it wrote, as a few rows of the counter log; written again if the batch is repeated."""
    rows = [(step, name, int(value)) for name, value in sorted(seen.get.items())]
    log.info("%s %s: %s", tag, step, summary(seen.get))
    house.counters.write(spark.createDataFrame(rows, COUNTERS).coalesce(1), f"{tag}.{step}")


def index_changes(changes: DataFrame, house: Warehouse, tag: str) -> None:
    """Change records to documents to the months they belong to; records without a month go to the log of dropped ones."""
    spark = changes.sparkSession
    changes, seen = counted(filters.change_filter(changes), f"documents-{tag}", **write_stats(changes, month_key(to_time(F.col("created_at"))).isNull()))
    undated = changes.where(month_key(to_time(F.col("created_at"))).isNull())
    house.dropped.write(undated.withColumn("reason", F.lit("created_at")), tag)
    docs = to_document(changes).withColumn("version", F.lit(1).cast("bigint"))
    docs = docs.where(F.col("month").isNotNull())
    stored = house.gold.touched(house.gold.read(spark, before=tag), docs)
    house.gold.write(upsert_documents(stored, docs), tag)
    # counted by the first of these writes, which reads all changes
    _write_counters(house, spark, tag, "documents", seen)


def ingest(
    envelopes: DataFrame,
    config: IngestConfig,
    checkpoint: str,
    name: str = "ingest",
    interval: str | None = None,
    dedupe_window: str | None = "5 days",
) -> StreamingQuery:
    """Live ingest of an envelope stream; ``name`` identifies the checkpoint's batches in the tables.

    Without ``interval`` it works off what is there and stops. Envelopes read with ``arrival`` are merged in the order of
    their source, others in that of the read; with ``corrupt`` lines that cannot be read are set aside.
    """
    events = _delivered_once(to_bus_events(envelopes), dedupe_window)
    return run_batches(events, lambda batch, epoch: ingest_batch(batch, f"{name}.{epoch}", config), checkpoint, interval)


def _delivered_once(events: DataFrame, window: str | None) -> DataFrame:
    """Repeated deliveries of a post dropped; lines without a post are told apart by where they stand."""
    if not window:
        return events
    key = F.col("data.id")
    if "arrival" in events.columns:
        key = F.coalesce(key, F.concat_ws("|", "arrival.place", "arrival.position", "arrival.line"))
    # repeats are recognised by arrival time: history replayed late must not count as late data
    keyed = events.withColumns({"_id": key, "_arrived": F.current_timestamp()})
    return dedupe_stream(keyed, "_id", window, "_arrived").drop("_id", "_arrived")


def ingest_keyed(
    envelopes: DataFrame,
    config: IngestConfig,
    checkpoint: str,
    name: str = "keyed",
    interval: str | None = None,
    idle_ms: int | None = None,
) -> StreamingQuery:
    """Live ingest with the state of each post in the state store: no stored row is read or rewritten for a batch.

    ``envelopes`` is a stream with ``arrival``. A repeated delivery changes nothing that is newer, so repeats need no
    state of their own. The changes go through analysis and index and into the change log; :func:`compact_state` makes
    a table of that. The archive is a stream of its own: :func:`postflow.streaming.operators.archive_stream`.
    """
    if "arrival" not in envelopes.columns:
        raise ValueError("keyed ingest merges in the order of the source: read the envelopes with arrival")
    if idle_ms is not None and interval is None:
        raise ValueError("timers need a query that goes on: give an interval")
    events = to_bus_events(envelopes)
    main = filters.new_posts(events, config.denied_domains, config.deny_mode)
    included = filters.included_posts(fanout(main), config.denied_domains, config.deny_mode)
    puts, updates = (to_state_row(df, config.now, keep=["arrival"]) for df in (main, included))
    changes = state_changes(keyed_events(puts, updates), idle_ms)
    buckets = config.warehouse.buckets

    def take(batch: DataFrame, epoch: int) -> None:
        spark, house, tag = batch.sparkSession, config.warehouse, f"{name}.{epoch}"
        if house.gold.version_of(spark, tag) is not None:
            return
        touched = house.touched.save(batch.withColumn("bucket", id_bucket(F.col("id"), buckets)), tag)
        index_changes(analysed_changes(touched, tag, config), house, tag)

    return run_batches(changes, take, checkpoint, interval)


def compact_state(spark: SparkSession, house: Warehouse, name: str, tag: str) -> None:
    """The change log of :func:`ingest_keyed` (its ``name``) as the state table: of each post the last change, with the
    analysis of its last fresh row. One shuffle of the log, whatever its number of batches."""
    log = house.changes.read_tagged(spark).where(F.col("batch").startswith(f"{name}."))
    epoch = F.substring_index("batch", ".", -1).cast("bigint")
    analysis = ("normalized_text", "comprehend")
    rest = [n for n in house.state.schema.names if n not in ("id", *analysis)]
    last = log.groupBy("id").agg(
        F.max_by(F.struct(*rest, "event_name"), epoch).alias("r"),
        F.max_by(F.struct(*analysis), F.when(F.col("comprehend").isNotNull(), epoch)).alias("a"),
    )
    kept = last.where(F.col("r.event_name") != EXPIRED).select("id", "r.*", "a.*").select(*house.state.schema.names)
    house.state.write(kept, tag)
    rebuild(spark, house.times, house.state)


# --- history -----------------------------------------------------------------------------------


def reindex_year(house: Warehouse, spark: SparkSession, year: str, tag: str) -> None:
    """State of one year to documents: one parallel job in place of a paging loop.

    Only buckets that the time listing names are read; a state table whose listing lacks a batch is read as a whole.
    """
    rows = house.state.read(spark)
    if is_complete(spark, house.times, house.state):
        rows = in_listed_buckets(rows, house.times.read(spark), f"{year}-", f"{int(year) + 1:04d}-")
    else:
        rows = scan_state_by_year(rows, year)
    index_changes(rows.withColumn("event_name", F.lit("MODIFY")), house, tag)


def reindex_archive(
    spark: SparkSession, path: str | Sequence[str], house: Warehouse, scorer: LexiconScorer | PandasScorer, tag: str
) -> None:
    """Archived envelopes to documents, analysis from the cache where it is there; what cannot be read goes to its log."""
    house.unreadable.write(unreadable(spark, path), tag)
    events = to_bus_events(read_archive(spark, path, arrival=True))
    rows = last_row(to_state_row(events, keep=["arrival"])).drop("arrival")
    analysed, cache_rows = analyze(
        rows, house.cache.read(spark, without=tag), scorer, save=lambda scored: house.scored.save(scored, tag)
    )
    house.cache.write(cache_rows, tag)
    images = analysed.withColumn("comprehend", F.col("analysis")).drop("analysis")
    index_changes(images.withColumn("event_name", F.lit("MODIFY")), house, tag)


def reingest(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Archived envelopes as ``(key, value)`` records for a stream sink."""
    return republish(read_archive(spark, path))


def reingest_files(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    bytes_per_trigger: int = 1 << 30,
    interval: str | None = None,
    clean_source: str | None = None,
    archive_dir: str | None = None,
) -> StreamingQuery:
    """Re-ingest as a job with admission control: archived envelopes to files of ``(key, value)`` records.

    At most ``bytes_per_trigger`` of input (one file at least) is taken in a micro-batch, and with ``interval`` one
    micro-batch in that time; without it the job works off what is there and stops. Each file is taken once, whatever
    stops the job in between, and with ``clean_source`` it is deleted or moved to ``archive_dir`` after that.
    """
    envelopes = read_archive(
        spark, path, streaming=True, max_bytes_per_trigger=bytes_per_trigger, clean_source=clean_source, archive_dir=archive_dir
    )
    return start_republish(envelopes, out, checkpoint, interval or "1 second", available_now=interval is None)


def reingest_legacy_stream(
    spark: SparkSession,
    path: str,
    posts: DataFrame,
    house: Warehouse,
    out: str,
    checkpoint: str,
    name: str = "legacy",
    bytes_per_trigger: int = 256 << 20,
    interval: str | None = None,
    clean_source: str | None = None,
    **options,
) -> StreamingQuery:
    """Files of posts in the old format, taken batch by batch: their full posts as ``(key, value)`` records, and how many
    of them were found and dropped by the deny lists to the counter log. A repeated batch writes the same files again."""
    reader = spark.readStream.schema("id_str STRING").option("ignoreCorruptFiles", "true").option("maxBytesPerTrigger", bytes_per_trigger)
    if clean_source:
        reader = reader.option("cleanSource", clean_source)
    ids = reader.json(path).where(F.col("id_str").isNotNull())

    def take(batch: DataFrame, epoch: int) -> None:
        tag = f"{name}.{epoch}"
        wanted = distinct_ids(batch)
        records, seen = counted(republish(hydrate(wanted, posts, **options)), f"legacy-{tag}")
        records.write.mode("overwrite").json(f"{out}/batch={tag}")
        _write_counters(house, spark, tag, "legacy", seen)

    return run_batches(ids, take, checkpoint, interval)


def reingest_legacy(
    ids: DataFrame,
    posts: DataFrame,
    users: DataFrame | None = None,
    labels: Sequence[str] = (),
    domains: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Old-format ids to full envelopes; also the percentage of found posts that the deny lists drop."""
    wanted = distinct_ids(ids)
    envelopes = hydrate(wanted, posts, users, labels, domains)
    found = posts.join(wanted, "id", "left_semi")
    keep = filters.source_allowed(F.col("source"), labels) & filters.domain_allowed(F.col("context_annotations"), domains)
    return envelopes, filtered_rate(found, keep)


def reingest_legacy_files(spark: SparkSession, path: str | Sequence[str], posts: DataFrame, **options):
    return reingest_legacy(read_legacy_ids(spark, path), posts, **options)


def backfill(
    changes: DataFrame,
    state: DataFrame,
    cache: DataFrame | None,
    scorer: LexiconScorer | PandasScorer,
    now: Column | None = None,
    save: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Analyses changed rows that lack it and attaches the result to their state rows; also new cache rows.

    ``changes`` may hold several records of a post, the one with the newest ``updated_at`` counts.
    """
    todo = filters.needs_enrichment(changes).select("id", "text", "lang", "updated_at")
    rest = todo.groupBy("id").agg(F.max_by(F.struct("text", "lang"), "updated_at").alias("_row"))
    analysed, cache_rows = analyze(rest.select("id", "_row.*"), cache, scorer, now, save=save)
    results = analysed.select(
        "id", F.col("analysis.normalized_text").alias("normalized_text"), F.col("analysis").alias("comprehend")
    )
    return attach_analysis(state, results), cache_rows
