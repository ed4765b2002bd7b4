"""Streaming forms: the tables replayed through file streams, results read back from the tables they end in."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import schemas
from postflow.operators.fanout import assemble_includes
from postflow.operators.state import last_row
from postflow.plans import bindings as B
from postflow.plans.jobs import IngestConfig, Warehouse, compact_state, ingest, ingest_keyed, reindex_archive, reingest, reingest_files, reingest_legacy_stream
from postflow.plans.queries.enrich import SCORER
from postflow.plans.queries.registry import POST, lexicon, norm, query
from postflow.session import new_shared_path
from postflow.sinks.archive import write_bronze
from postflow.sinks.publish import start_republish
from postflow.sinks.tables import KeyedTable
from postflow.sources.envelopes import audit_files, read_archive, read_archive_days, read_envelopes, split_readable, to_bus_events
from postflow.streaming import operators as O
from postflow.streaming.post_state import keyed_events, state_changes

MICROS = "CAST(epoch_us(ts) AS BIGINT)"


def _finish(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


@query("SELECT event_id, ts FROM events")
def stream_dedupe(spark, d):
    """Two readers deliver every event; one copy gets through."""
    events = B.stream(spark, d, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    twice = events.unionByName(B.stream(spark, d, "events").withColumn("event_time", F.col("ts").cast("timestamp")))
    rows = O.dedupe_stream(twice, "event_id", "40 days").select("event_id", "ts")
    out, checkpoint = new_shared_path(spark, "dedupe"), new_shared_path(spark, "checkpoint")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    _finish(writer.trigger(availableNow=True).start(out))
    return spark.read.schema(rows.schema).parquet(out)


@query(
    f"""WITH v AS (SELECT user_id || '-' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS id, {MICROS} AS updated_at,
  CAST(floor(value) AS BIGINT) AS likes FROM events)
SELECT id, max(updated_at) AS updated_at, arg_max(likes, updated_at) AS likes FROM v GROUP BY 1"""
)
def stream_merge(spark, d):
    """Latest-wins metrics of a stream."""
    zero = F.lit(0).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    updates = B.stream(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 20).cast("string")).alias("id"),
        F.struct(
            zero.alias("retweet_count"), zero.alias("reply_count"), F.floor("value").alias("like_count"), zero.alias("quote_count")
        ).alias("public_metrics"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"),
    )
    schema = spark.createDataFrame(
        [], updates.schema.add("text", "string").add("bucket", "string")
    ).schema
    table = KeyedTable(new_shared_path(spark, "state"), schema, "bucket")
    _finish(O.merge_stream(updates, table, new_shared_path(spark, "checkpoint"), buckets=16))
    return table.read(spark).select("id", "updated_at", F.col("public_metrics.like_count").alias("likes"))


def _archived(spark, d):
    events = B.bus_events(spark, d, B.stream(spark, d, "events"))
    out, errors = new_shared_path(spark, "bronze"), new_shared_path(spark, "bronze-errors")
    for stream in O.archive_stream(events, out, errors, new_shared_path(spark, "checkpoint"), interval=None):
        _finish(stream)
    return out, errors


@query(f"{POST} SELECT id, text, strftime(t, '%Y') AS year, strftime(t, '%m') AS month, strftime(t, '%d') AS day FROM post WHERE t IS NOT NULL")
def stream_archive(spark, d):
    """Events to gzip JSON by day, read back from the archive."""
    out, _ = _archived(spark, d)
    rows = read_archive_days(spark, out, "0000-01-01", "9999-12-31")
    return rows.select(F.col("data.id").alias("id"), F.col("data.text").alias("text"), "year", "month", "day")


@query(f"{POST} SELECT id, text, 'metadata-extraction-failed' AS error_type FROM post WHERE t IS NULL")
def stream_archive_errors(spark, d):
    """The records that have no day, from the error branch of the archive stream."""
    _, errors = _archived(spark, d)
    schema = T.StructType([*schemas.ENVELOPE.fields, T.StructField("error_type", T.StringType())])
    rows = spark.read.schema(schema).json(errors)
    return rows.select(F.col("data.id").alias("id"), F.col("data.text").alias("text"), "error_type")


@query("SELECT event_id FROM events")
def dedupe_null_time(spark, d):
    """Every event is delivered without a time and then with one; the second delivery gets through."""
    events = B.stream(spark, d, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    both = F.array(F.lit(None).cast("timestamp"), F.col("event_time"))
    twice = events.withColumn("event_time", F.explode(both))
    rows = O.dedupe_stream(twice, "event_id", "40 days").select("event_id")
    out, checkpoint = new_shared_path(spark, "dedupe"), new_shared_path(spark, "checkpoint")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    _finish(writer.trigger(availableNow=True).start(out))
    return spark.read.schema(rows.schema).parquet(out)


@query(f"{POST} SELECT id, CAST(t IS NULL AS INT) AS failed FROM post")
def batch_archive(spark, d):
    """One batch to the archive and its error branch, written twice as after a retry."""
    out, errors = new_shared_path(spark, "bronze"), new_shared_path(spark, "errors")
    # each branch and the retry read the batch from its source; its rows are not joined again
    batch, source = B.bus_events(spark, d), new_shared_path(spark, "batch")
    batch.write.parquet(source)
    events = spark.read.schema(batch.schema).parquet(source)
    for _ in range(2):
        write_bronze(events, out, "b0", errors)
    good = read_archive(spark, out).select(F.col("data.id").alias("id"), F.lit(0).alias("failed"))
    bad = read_archive(spark, errors).select(F.col("data.id").alias("id"), F.lit(1).alias("failed"))
    return good.unionByName(bad)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, event_type AS key, count(*) AS doc_count FROM events GROUP BY 1, 2")
def stream_histogram(spark, d):
    events = B.stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), "event_type")
    counts = O.histogram_stream(events, "1 day", by="event_type")
    out = new_shared_path(spark, "histogram")

    def replace(batch, _epoch):
        batch.write.mode("overwrite").parquet(out)

    writer = counts.writeStream.outputMode("complete").foreachBatch(replace)
    writer = writer.option("checkpointLocation", new_shared_path(spark, "checkpoint"))
    _finish(writer.trigger(availableNow=True).start())
    rows = spark.read.schema(counts.schema).parquet(out)
    return rows.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _thread_envelopes(spark, d, posts=None):
    """Envelopes of all conversation turns as JSON files."""
    envelopes = assemble_includes(B.thread_posts(spark, d) if posts is None else posts, users=B.thread_users(spark, d))
    rule = F.array(F.struct(F.lit("r1").alias("id"), F.lit("t").alias("tag")))
    out = new_shared_path(spark, "envelopes")
    envelopes.withColumn("matching_rules", rule).write.option("compression", "gzip").json(out)
    return out


_TURNS = f"""WITH src AS (SELECT conv_id || '-' || turn AS id, {norm('text')} AS norm, 'en' AS code FROM conversations), {lexicon('', 'src')}
SELECT src.id, src.norm AS normalized_text, s.sentiment, '2024-02' AS month FROM src LEFT JOIN scored s ON s.cache_key = sha256(src.norm)"""


def _gold(house, spark):
    return house.gold.read(spark).select(
        "id", "normalized_text", F.col("comprehend.sentiment").alias("sentiment"), "month"
    )


@query(_TURNS)
def stream_ingest(spark, d):
    """The whole way: envelope files, de-duplication, archive, fan-out, analysis, state, documents."""
    house = Warehouse(new_shared_path(spark, "warehouse"), buckets=16)
    envelopes = read_envelopes(spark, _thread_envelopes(spark, d), streaming=True)
    config = IngestConfig(house, SCORER)
    _finish(ingest(envelopes, config, new_shared_path(spark, "checkpoint")))
    return _gold(house, spark)


@query("""SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'created_at' END AS reason FROM conversations""")
def dropped_documents(spark, d):
    """Every post is a document or in the log of dropped ones; every third turn has no readable time."""
    turn = F.substring_index("id", "-", -1).cast("int")
    created = F.when(turn % 3 == 0, "not a time").otherwise(F.col("created_at"))
    posts = B.thread_posts(spark, d).withColumn("created_at", created)
    house = Warehouse(new_shared_path(spark, "warehouse"), buckets=16)
    envelopes = read_envelopes(spark, _thread_envelopes(spark, d, posts), streaming=True)
    _finish(ingest(envelopes, IngestConfig(house, SCORER), new_shared_path(spark, "checkpoint")))
    indexed = house.gold.read(spark).select("id", F.lit(None).cast("string").alias("reason"))
    return indexed.unionByName(house.dropped.read(spark).select("id", "reason"))


@query(_TURNS)
def reindex_from_archive(spark, d):
    """Archived envelopes straight to documents."""
    house = Warehouse(new_shared_path(spark, "warehouse"), buckets=16)
    reindex_archive(spark, _thread_envelopes(spark, d), house, SCORER, "reindex.0")
    return _gold(house, spark)


@query("SELECT conv_id || '-' || turn AS key, CAST(conv_id AS VARCHAR) AS conv FROM conversations")
def reingest_from_archive(spark, d):
    records = reingest(spark, _thread_envelopes(spark, d))
    data = F.from_json("value", schemas.ENVELOPE)["data"]
    return records.select("key", data["conversation_id"].alias("conv"))


@query("SELECT conv_id || '-' || turn AS key FROM conversations")
def stream_republish(spark, d):
    """Archived envelopes re-published as key and value records."""
    envelopes = to_bus_events(read_envelopes(spark, _thread_envelopes(spark, d), streaming=True))
    out, checkpoint = new_shared_path(spark, "republished"), new_shared_path(spark, "checkpoint")
    _finish(start_republish(envelopes, out, checkpoint, available_now=True))
    return spark.read.schema("key STRING, value STRING").json(out).select("key")


def _delivered(spark, d):
    """Events as puts and updates of posts in files of several rounds: the puts, the updates in two parts, the older part
    last, and every update once more."""
    likes, k, none = F.floor("value"), F.get_json_object("props", "$.k").cast("bigint"), F.lit(None)
    zero = F.lit(0).cast("bigint")
    post_id = F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 20).cast("string"))
    put = F.col("event_type").isin("view", "signup")
    values = {
        "id": post_id,
        "text": F.when(put, F.col("event_type")).otherwise(F.concat(F.lit("inc-"), post_id)),
        "public_metrics": F.struct(
            zero.alias("retweet_count"), zero.alias("reply_count"), likes.alias("like_count"), zero.alias("quote_count")
        ),
        "updated_at": F.unix_micros(F.col("ts").cast("timestamp")),
    }
    columns = [values.get(f.name, none).cast(f.dataType).alias(f.name) for f in schemas.STATE.fields]
    arrival = F.struct(
        none.cast("timestamp").alias("time"), none.cast("string").alias("place"), F.col("event_id").alias("position"), none.cast("bigint").alias("line")
    )
    rows = B.table(spark, d, "events").select(put.alias("put"), arrival.alias("arrival"), *columns)
    out = new_shared_path(spark, "deliveries")
    half = rows.agg(F.percentile_approx("updated_at", 0.5)).first()[0]
    newer = F.col("updated_at") > half
    for part in (rows.where("put"), rows.where(~F.col("put") & newer), rows.where(~F.col("put") & ~newer), rows.where(~F.col("put"))):
        # the rows of a post in one file: what arrives in one micro-batch is merged by its place
        part.repartition(4, "id").write.mode("append").parquet(out)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(out)


@query(
    f"""WITH v AS (SELECT event_id, user_id || '-' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS id, {MICROS} AS updated_at,
  CAST(floor(value) AS BIGINT) AS likes, event_type FROM events),
s AS (SELECT id, arg_max(updated_at, event_id) AS updated_at, arg_max(likes, event_id) AS likes, arg_max(event_type, event_id) AS text
  FROM v WHERE event_type IN ('view', 'signup') GROUP BY 1),
n AS (SELECT id, arg_max(likes, {{'u': updated_at, 'a': -event_id}}) AS likes, max(updated_at) AS updated_at
  FROM v WHERE event_type NOT IN ('view', 'signup') GROUP BY 1)
SELECT id, CASE WHEN s.id IS NULL OR n.updated_at > s.updated_at THEN n.updated_at ELSE s.updated_at END AS updated_at,
  CASE WHEN s.id IS NULL OR n.updated_at > s.updated_at THEN n.likes ELSE s.likes END AS likes, coalesce(s.text, 'inc-' || id) AS text
FROM s FULL OUTER JOIN n USING (id)"""
)
def stream_keyed_state(spark, d):
    """Latest state per post from the state store, over micro-batches with late, repeated and promoted posts."""
    events = _delivered(spark, d)
    changes = state_changes(keyed_events(events.where("put"), events.where(~F.col("put"))))
    out = new_shared_path(spark, "changes")

    def take(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    _finish(O.run_batches(changes, take, new_shared_path(spark, "checkpoint")))
    rows = spark.read.schema(changes.schema.add("epoch", "long")).parquet(out)
    last = rows.groupBy("id").agg(F.max_by(F.struct("updated_at", F.col("public_metrics.like_count").alias("likes"), "text"), "epoch").alias("r"))
    return last.select("id", "r.*")


@query(_TURNS)
def ingest_keyed_state(spark, d):
    """The whole way with the state in the state store; the state table is made of the change log behind it."""
    house = Warehouse(new_shared_path(spark, "warehouse"), buckets=16)
    envelopes = read_envelopes(spark, _thread_envelopes(spark, d), streaming=True, arrival=True)
    _finish(ingest_keyed(envelopes, IngestConfig(house, SCORER), new_shared_path(spark, "checkpoint")))
    compact_state(spark, house, "keyed", "compact.0")
    state = house.state.read(spark).select("id", F.col("normalized_text").alias("in_state"))
    return _gold(house, spark).join(state, "id", "left").where(F.col("normalized_text").eqNullSafe(F.col("in_state"))).drop("in_state")


@query(
    """SELECT user_id AS id, coalesce(arg_max(event_id, event_id) FILTER (WHERE event_type NOT IN ('view', 'signup')), max(event_id)) AS last
FROM events GROUP BY 1"""
)
def last_row_over_files(spark, d):
    """The last row per key over files: the old rows lie in small files, the newer ones in larger files written later."""
    rows = B.table(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("last"), F.col("event_type").isin("view", "signup").alias("old")
    )
    out = new_shared_path(spark, "arrivals")
    for part, filler in ((rows.where("old"), 1), (rows.where(~F.col("old")), 50)):
        post = F.struct(F.col("id").cast("string").alias("id"), F.concat(F.col("last").cast("string"), F.repeat(F.lit(" "), F.lit(filler))).alias("text"))
        lines = part.repartition(4, "id").sortWithinPartitions("last").select(post.alias("data"))
        lines.write.mode("append").option("compression", "gzip").json(out)
    read = read_envelopes(spark, out, arrival=True).select(F.col("data.id").alias("id"), "data.text", "arrival")
    return last_row(read).select(F.col("id").cast("bigint").alias("id"), F.trim("text").cast("bigint").alias("last"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_type = 'signup' THEN 'no-id' ELSE 'ok' END AS outcome FROM events"""
)
def bad_lines(spark, d):
    """Every line of an archive is an envelope or in the error table, with what it was: some are cut off, some have no id."""
    kind = F.col("event_type")
    post = F.struct(F.when(kind != "signup", F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("text"))
    whole = F.to_json(F.struct(post.alias("data")))
    line = F.when(kind == "error", F.substring(whole, F.lit(1), F.char_length(whole) - 1)).otherwise(whole)
    out = new_shared_path(spark, "archive")
    B.table(spark, d, "events").select(line.alias("value")).write.option("compression", "gzip").text(out)
    good, bad = split_readable(read_envelopes(spark, out, arrival=True, corrupt=True))
    number = lambda c: F.regexp_extract(c, '"text":"n([0-9]+)', 1).cast("bigint")
    return good.select(F.col("data.id").cast("bigint").alias("event_id"), F.lit("ok").alias("outcome")).unionByName(
        bad.select(number(F.col("record")).alias("event_id"), F.col("reason").alias("outcome"))
    )


@query("SELECT event_type AS place, count(*) AS lines, NULL AS error FROM events GROUP BY 1")
def file_audit(spark, d):
    """Lines of every gzip file as the audit counts them; all of these files are whole."""
    out = new_shared_path(spark, "archive")
    rows = B.table(spark, d, "events").select("event_type", F.to_json(F.struct("event_id")).alias("value"))
    rows.repartition(4, "event_id").write.partitionBy("event_type").option("compression", "gzip").text(out)
    kind = F.regexp_extract("place", "event_type=([^/]+)/", 1)
    audited = audit_files(spark, out).groupBy(kind.alias("place"))
    return audited.agg(F.sum("lines").alias("lines"), F.max("error").alias("error"))


@query(
    """WITH t AS (SELECT turn % 3 = 0 AS undated FROM conversations)
SELECT 'changes' AS step, 'inserted' AS counter, count(*) AS value FROM t UNION ALL SELECT 'changes', 'fresh', count(*) FROM t
UNION ALL SELECT 'documents', 'total', count(*) FROM t UNION ALL SELECT 'documents', 'failed', count(*) FILTER (WHERE undated) FROM t
UNION ALL SELECT 'documents', 'successful', count(*) FILTER (WHERE NOT undated) FROM t"""
)
def ingest_run_counters(spark, d):
    """What the batches of an ingest run counted while they wrote: changes, and documents written and failed."""
    turn = F.substring_index("id", "-", -1).cast("int")
    posts = B.thread_posts(spark, d).withColumn("created_at", F.when(turn % 3 == 0, "not a time").otherwise(F.col("created_at")))
    house = Warehouse(new_shared_path(spark, "warehouse"), buckets=16)
    envelopes = read_envelopes(spark, _thread_envelopes(spark, d, posts), streaming=True)
    _finish(ingest(envelopes, IngestConfig(house, SCORER), new_shared_path(spark, "checkpoint")))
    counters = house.counters.read(spark).groupBy("step", "counter").agg(F.sum("value").alias("value"))
    return counters.where(F.col("counter").isin("inserted", "fresh", "total", "failed", "successful"))


@query("SELECT conv_id || '-' || turn AS key, CAST(conv_id AS VARCHAR) AS conv, true AS once FROM conversations")
def reingest_in_steps(spark, d):
    """Archived envelopes re-published in micro-batches of bounded bytes; the job is run twice and takes every file once."""
    path, out, checkpoint = _thread_envelopes(spark, d), new_shared_path(spark, "republished"), new_shared_path(spark, "checkpoint")
    for _ in range(2):
        _finish(reingest_files(spark, path, out, checkpoint, bytes_per_trigger=64 << 10))
    records = spark.read.schema("key STRING, value STRING").json(out)
    conv = F.from_json("value", schemas.ENVELOPE)["data"]["conversation_id"]
    return records.groupBy("key").agg(F.max(conv).alias("conv"), (F.count("*") == 1).alias("once"))


@query("SELECT conv_id || '-' || turn AS key, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS answered FROM conversations")
def reingest_legacy_in_steps(spark, d):
    """Ids of posts in the old format, each delivered twice, to full envelopes with the posts they refer to."""
    posts = B.thread_posts(spark, d)
    path = new_shared_path(spark, "legacy")
    ids = posts.select(F.col("id").alias("id_str"))
    ids.unionByName(ids).repartition(4, "id_str").write.json(path)
    house, out = Warehouse(new_shared_path(spark, "warehouse"), buckets=16), new_shared_path(spark, "republished")
    _finish(reingest_legacy_stream(spark, path, posts, house, out, new_shared_path(spark, "checkpoint")))
    envelope = F.from_json("value", schemas.ENVELOPE)
    rows = spark.read.schema("key STRING, value STRING").json(out).select("key", envelope["includes"]["tweets"]["id"].alias("ids"), envelope["data"]["referenced_tweets"].alias("refs"))
    answered = F.get(F.filter("refs", lambda r: r["type"] == "replied_to"), F.lit(0))["id"]
    return rows.select("key", F.when(F.array_contains("ids", answered), answered).alias("answered"))
