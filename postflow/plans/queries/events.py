"""Sources, routing, filters, fan-out, joins and the archive."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow import schemas
from postflow.functions.keys import day_parts, epoch_seconds, month_key as month_of, year_key
from postflow.operators import filters
from postflow.operators import fanout as O
from postflow.operators.metrics import filtered_rate as rate
from postflow.operators.state import to_state_row, to_state_row_v1
from postflow.plans import bindings as B
from postflow.plans.jobs import reingest_legacy
from postflow.plans.queries.registry import DENIED, NONE_DENIED, POST, THREAD, query, words
from postflow.sinks.archive import archive_rows, split_valid
from postflow.sinks.publish import emit, republish
from postflow.sources.envelopes import (
    decode_bodies,
    decode_payload,
    encode_payload,
    replay,
    to_bus_events,
    union_sources as union_all,
)
from postflow.sources.images import decode_images
from postflow.sources.lists import scan_state_by_year

SOURCES = words(B.DENIED_SOURCES)


def _ids(df, id_col="data.id"):
    return df.select(F.col(id_col).alias("id"))


# --- sources -----------------------------------------------------------------------------------


@query(f"{POST} SELECT id, detail_type, t AS event_time, CASE WHEN k % 10 = 0 THEN 'replay-1' END AS replay_name FROM post")
def bus_event_rows(spark, d):
    return B.bus_events(spark, d).select(
        F.col("data.id").alias("id"), "detail_type", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "replay_name"
    )


@query(f"{POST} SELECT id, text, t AS event_time, likes AS like_count FROM post")
def queue_decode(spark, d):
    """Envelopes through their JSON form and back, then stamped as bus events."""
    bodies = B.bus_events(spark, d).select(F.to_json(F.struct(*schemas.ENVELOPE.names)).alias("body"))
    return to_bus_events(decode_bodies(bodies)).select(
        F.col("data.id").alias("id"),
        F.col("data.text").alias("text"),
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        F.col("data.public_metrics.like_count").alias("like_count"),
    )


@query(f"{POST} SELECT id, text, likes AS like_count, dom1 AS first_domain FROM post")
def payload_roundtrip(spark, d):
    """Envelopes through Base64 records and back."""
    payload = encode_payload(B.bus_events(spark, d).select(*schemas.ENVELOPE.names))
    data = F.col("data")
    return decode_payload(payload).select(
        data["id"].alias("id"),
        data["text"].alias("text"),
        data["public_metrics"]["like_count"].alias("like_count"),
        F.get(data["context_annotations"], F.lit(0))["domain"]["name"].alias("first_domain"),
    )


@query(
    f"""{POST} SELECT id, 'MODIFY' AS event_name, likes AS like_count, event_type = 'error' AS possibly_sensitive,
  CASE WHEN ref_kind IS NOT NULL THEN CAST(event_id - 1 AS VARCHAR) END AS ref_id, round(value, 6) AS score FROM post"""
)
def typed_image_decode(spark, d):
    """Tagged JSON, with the tags some writers misspell, back to typed columns."""
    post = F.col("data")
    schema = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("public_metrics", schemas.POST_METRICS),
            T.StructField("possibly_sensitive", T.BooleanType()),
            T.StructField("referenced_tweets", schemas.REFERENCES),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def text(c):
        return F.struct(c.cast("string").alias("S"))

    def number(c):
        return F.struct(c.cast("string").alias("N"))

    metrics = post["public_metrics"]
    image = F.struct(
        text(post["id"]).alias("id"),
        F.struct(F.struct(*[number(metrics[n]).alias(n) for n in schemas.POST_METRICS.names]).alias("M")).alias("public_metrics"),
        F.struct(post["possibly_sensitive"].alias("Bool")).alias("possibly_sensitive"),
        F.when(
            post["referenced_tweets"].isNotNull(),
            F.struct(
                F.transform(
                    post["referenced_tweets"],
                    lambda r: F.struct(F.struct(text(r["type"]).alias("type"), text(r["id"]).alias("id")).alias("M")),
                ).alias("L")
            ),
        ).alias("referenced_tweets"),
        number(F.col("value")).alias("score"),
    )
    rows = B.raw_posts(spark, d).select(B.post_struct().alias("data"), "value")
    changes = rows.select(F.lit("MODIFY").alias("event_name"), F.to_json(image).alias("new_image"))
    decoded = decode_images(changes, schema)
    return decoded.select(
        "id",
        "event_name",
        F.col("public_metrics.like_count").alias("like_count"),
        "possibly_sensitive",
        F.get("referenced_tweets", F.lit(0))["id"].alias("ref_id"),
        F.round("score", 6).alias("score"),
    )


@query(f"{POST} SELECT detail_type, count(*) AS events FROM post GROUP BY 1")
def union_sources(spark, d):
    """Two enabled readers and one without credentials."""
    events = B.bus_events(spark, d)
    readers = [filters.route(events, K.DETAIL_POST), None, filters.route(events, K.DETAIL_INCLUDED)]
    return union_all(readers).groupBy("detail_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    f"""{POST} SELECT id, t AS event_time, 'again' AS replay_name FROM post
WHERE t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-20'"""
)
def replay_range(spark, d):
    bronze = B.bus_events(spark, d).select(*schemas.ENVELOPE.names)
    rows = replay(bronze, "2024-01-10", "2024-01-20", "again")
    return rows.select(F.col("data.id").alias("id"), F.col("event_time").cast("timestamp_ntz").alias("event_time"), "replay_name")


@query(f"{POST} SELECT id, created_at FROM post WHERE t >= TIMESTAMP '2019-01-01' AND t < TIMESTAMP '2020-01-01'")
def state_scan_year(spark, d):
    return scan_state_by_year(B.state(spark, d), "2019").select("id", "created_at")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents UNION SELECT CAST(doc_id AS VARCHAR) FROM labels")
def distinct_ids(spark, d):
    """Distinct ids over several id lists with repeats."""
    lists = [B.table(spark, d, n).select(F.col("doc_id").cast("string").alias("id_str")) for n in ("documents", "labels")]
    return O.distinct_ids(union_all(lists))


# --- filters and routes ------------------------------------------------------------------------


@query(f"{POST} SELECT id FROM post WHERE coalesce(label, '') NOT IN ({SOURCES})")
def deny_source(spark, d):
    return filters.deny_source(B.posts(spark, d), B.DENIED_SOURCES).select("id")


@query(f"{POST} SELECT id FROM post WHERE {NONE_DENIED}")
def deny_domain_none(spark, d):
    return filters.deny_domain(B.posts(spark, d)).select("id")


@query(f"{POST} SELECT id FROM post WHERE dom1 NOT IN ({DENIED}) OR dom2 NOT IN ({DENIED})")
def deny_domain_any(spark, d):
    return filters.deny_domain(B.posts(spark, d), mode="any").select("id")


@query(f"{POST} SELECT id FROM post WHERE {NONE_DENIED}")
def deny_domain_table(spark, d):
    """The deny list as a table."""
    deny = spark.createDataFrame([(n,) for n in K.DENIED_CONTEXT_DOMAINS], "domain STRING")
    return O.deny_join(B.posts(spark, d), deny).select("id")


@query(f"{POST} SELECT id FROM post WHERE t > TIMESTAMP '2019-12-01'")
def date_floor(spark, d):
    return filters.date_floor(B.posts(spark, d)).select("id")


@query(f"{POST} SELECT id FROM post WHERE starts_with(created_at, '202')")
def created_prefix(spark, d):
    return filters.created_prefix(B.posts(spark, d)).select("id")


@query(f"{POST} SELECT id FROM post WHERE k % 4 NOT IN (0, 1)")
def rule_exists(spark, d):
    return _ids(filters.rule_exists(B.bus_events(spark, d)))


@query(
    f"""{POST} SELECT 'archive' AS consumer, id FROM post WHERE detail_type = 'Tweet' AND k % 10 <> 0
UNION ALL SELECT 'new', id FROM post WHERE detail_type = 'Tweet' AND k % 4 NOT IN (0, 1) AND {NONE_DENIED}
UNION ALL SELECT 'included', id FROM post WHERE detail_type = 'IncludedTweet' AND starts_with(created_at, '202') AND {NONE_DENIED}"""
)
def route(spark, d):
    """One event to any number of consumers."""
    events = B.bus_events(spark, d)
    branches = {
        "archive": filters.archivable(events),
        "new": filters.new_posts(events),
        "included": filters.included_posts(events),
    }
    return union_all([_ids(df).withColumn("consumer", F.lit(name)) for name, df in branches.items()])


@query(f"{POST} SELECT id FROM post WHERE k % 10 <> 0")
def replay_excluded(spark, d):
    return _ids(filters.exclude_replayed(B.bus_events(spark, d)))


_EVENT_NAME = "CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type = 'error' THEN 'REMOVE' ELSE 'MODIFY' END"


def _changes(spark, d):
    kind = F.col("event_type")
    name = F.when(kind == "signup", "INSERT").when(kind == "error", "REMOVE").otherwise("MODIFY")
    return B.raw_posts(spark, d).select(B.post_struct().alias("data"), name.alias("event_name"), "ts", "k").select(
        "data.*", "event_name", "ts", "k"
    )


@query(f"{POST} SELECT id FROM post WHERE {_EVENT_NAME} IN ('INSERT', 'MODIFY') AND text IS NOT NULL AND created_at IS NOT NULL")
def change_filter(spark, d):
    return filters.change_filter(_changes(spark, d)).select("id")


@query(f"{POST} SELECT id FROM post WHERE {_EVENT_NAME} IN ('INSERT', 'MODIFY') AND text IS NOT NULL AND k % 3 <> 0")
def needs_enrichment(spark, d):
    analysed = F.when(F.col("k") % 3 == 0, F.struct(F.lit("NEUTRAL").alias("sentiment")))
    return filters.needs_enrichment(_changes(spark, d).withColumn("comprehend", analysed)).select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY")
def drop_stale(spark, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    rows = B.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return filters.drop_stale(rows, "ts", now=now).select("id")


# --- projections -------------------------------------------------------------------------------


@query(
    f"""{POST} SELECT id, CAST(floor(epoch(t)) AS BIGINT) AS updated_at, CASE WHEN k % 6 <> 0 THEN 'user' || user_id END AS author,
  'stub' AS stub, nullif(text, '') AS text FROM post WHERE t IS NOT NULL"""
)
def state_row(spark, d):
    events = B.bus_events(spark, d).where(F.col("event_time").isNotNull())
    rows = to_state_row(events)
    return rows.select("id", "updated_at", F.col("author.username").alias("author"), F.col("_all").alias("stub"), "text")


@query(
    f"""{THREAD}, kept AS (SELECT id FROM thread WHERE role <> 'system')
SELECT 'main' AS kind, id, id AS carrier, '2024' AS created_at_year FROM kept
UNION ALL SELECT 'included', f.id, f.carrier, '2024' FROM kept JOIN (SELECT DISTINCT carrier, id, role FROM found) f ON f.carrier = kept.id
WHERE f.role <> 'system'"""
)
def state_row_legacy(spark, d):
    """Main and included posts of the legacy path; one source is denied."""
    envelopes = O.assemble_includes(B.thread_posts(spark, d), users=B.thread_users(spark, d))
    rows = to_state_row_v1(envelopes.withColumn("carrier", F.col("data.id")), ["system"], keep=["carrier"])
    return rows.select("kind", "id", "carrier", "created_at_year")


@query(f"{POST} SELECT id, created_at, substr(created_at, 1, 4) AS year FROM post WHERE created_at LIKE '20%'")
def year_of_creation(spark, d):
    rows = B.posts(spark, d).where(F.col("created_at").startswith("20"))
    return rows.select("id", "created_at", year_key(F.col("created_at")).alias("year"))


@query(f"{POST} SELECT id, strftime(t, '%Y-%m') AS month, coalesce(CAST(floor(epoch(t)) AS BIGINT), 0) AS epoch FROM post")
def month_key(spark, d):
    time = F.try_to_timestamp("created_at")
    zero = F.lit("1970-01-01").cast("timestamp")
    return B.posts(spark, d).select("id", month_of(time).alias("month"), epoch_seconds(time, zero).alias("epoch"))


# --- joins and fan-out -------------------------------------------------------------------------


@query(f"{POST} SELECT id, c.c_name AS author, c.c_nationkey AS following FROM post LEFT JOIN customer c ON c.c_custkey = user_id")
def author_lookup(spark, d):
    rows = O.with_author(B.posts(spark, d).select("id", "author_id"), B.users(spark, d))
    following = F.col("author.public_metrics.following_count").cast("int")
    return rows.select("id", F.col("author.name").alias("author"), following.alias("following"))


@query(f"{POST} SELECT id, CASE WHEN k % 6 <> 0 THEN 'Name ' || user_id END AS author, CAST(k % 6 <> 0 AS INT) AS matches FROM post")
def author_in_envelope(spark, d):
    rows = O.author_list(O.with_author(B.bus_events(spark, d)))
    return rows.select(F.col("data.id").alias("id"), F.col("author.name").alias("author"), F.size("authors").alias("matches"))


@query(f"{THREAD} SELECT DISTINCT id FROM found")
def referenced_semi(spark, d):
    posts = B.thread_posts(spark, d)
    ids = F.transform("referenced_tweets", lambda r: r["id"])
    return O.referenced_semi(posts, posts, ids).select("id")


_INCLUDED = """SELECT t.id, coalesce(string_agg(f.id, ',' ORDER BY f.id), '') AS included, count(f.id) AS n
FROM thread t LEFT JOIN (SELECT DISTINCT carrier, id FROM found) f ON f.carrier = t.id GROUP BY 1"""


@query(f"{THREAD} {_INCLUDED}")
def assemble_includes(spark, d):
    envelopes = O.assemble_includes(B.thread_posts(spark, d), users=B.thread_users(spark, d))
    ids = F.array_sort(F.transform("includes.tweets", lambda t: t["id"]))
    return envelopes.select(F.col("data.id").alias("id"), F.array_join(ids, ",").alias("included"), F.size(ids).cast("bigint").alias("n"))


@query(f"{THREAD} SELECT t.id, count(DISTINCT f.id) AS n FROM thread t LEFT JOIN found f ON f.carrier = t.id AND f.pos = 0 GROUP BY 1")
def referenced_posts(spark, d):
    """Of the included posts only those the (trimmed) post still refers to."""
    envelopes = O.assemble_includes(B.thread_posts(spark, d))
    first_only = F.col("data").withField("referenced_tweets", F.slice("data.referenced_tweets", 1, 1))
    kept = O.referenced_posts(envelopes.withColumn("data", first_only))
    return kept.select(F.col("data.id").alias("id"), F.size("includes.tweets").cast("bigint").alias("n"))


@query(
    f"""{THREAD} SELECT carrier, id, text, 'IncludedTweet' AS detail_type, TIMESTAMP '2024-02-01' AS event_time, 0 AS rules
FROM (SELECT DISTINCT carrier, id, text FROM found)"""
)
def fanout_included(spark, d):
    """One event per included post, with its carrier's time."""
    envelopes = O.assemble_includes(B.thread_posts(spark, d)).withColumn(
        "matching_rules", F.lit(None).cast(schemas.RULES)
    )
    events = to_bus_events(envelopes).withColumn("carrier", F.col("data.id"))
    return O.fanout(events).select(
        "carrier",
        F.col("data.id").alias("id"),
        F.col("data.text").alias("text"),
        "detail_type",
        F.col("event_time").cast("timestamp_ntz").alias("event_time"),
        F.size("matching_rules").alias("rules"),
    )


_LEGACY = f"""{POST}, wanted AS (SELECT DISTINCT doc_id AS event_id FROM labels)
SELECT p.id, CAST(p.ref_kind IS NOT NULL AND p.event_id > 0 AS INT) AS included, c.c_name AS author, true AS backup
FROM post p JOIN wanted USING (event_id) LEFT JOIN customer c ON c.c_custkey = p.user_id
WHERE coalesce(label, '') NOT IN ({SOURCES}) AND {NONE_DENIED}"""


def _legacy(spark, d):
    ids = B.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id_str"))
    repeated = ids.unionByName(ids)
    return reingest_legacy(repeated, B.posts(spark, d), B.users(spark, d), B.DENIED_SOURCES, K.DENIED_CONTEXT_DOMAINS)


@query(_LEGACY)
def hydrate(spark, d):
    """Ids of the labelled documents to full envelopes."""
    envelopes, _ = _legacy(spark, d)
    return envelopes.select(
        F.col("data.id").alias("id"),
        F.size("includes.tweets").alias("included"),
        F.get("includes.users", F.lit(0))["name"].alias("author"),
        "backup",
    )


@query(
    f"""{POST}, wanted AS (SELECT DISTINCT doc_id AS event_id FROM labels)
SELECT round(avg(CASE WHEN coalesce(label, '') NOT IN ({SOURCES}) AND {NONE_DENIED} THEN 0.0 ELSE 1.0 END) * 100, 6) AS filtered_rate
FROM post JOIN wanted USING (event_id)"""
)
def filtered_rate_legacy(spark, d):
    _, dropped = _legacy(spark, d)
    return dropped.select(F.round("filtered_rate", 6).alias("filtered_rate"))


@query(
    f"""{POST} SELECT round(avg(CASE WHEN coalesce(label, '') NOT IN ({SOURCES}) THEN 0.0 ELSE 1.0 END) * 100, 6) AS filtered_rate FROM post"""
)
def filtered_rate(spark, d):
    keep = filters.source_allowed(F.col("source"), B.DENIED_SOURCES)
    return rate(B.posts(spark, d), keep).select(F.round("filtered_rate", 6).alias("filtered_rate"))


# --- archive and events out --------------------------------------------------------------------


@query(f"{POST} SELECT strftime(t, '%Y') AS year, strftime(t, '%m') AS month, strftime(t, '%d') AS day, count(*) AS events FROM post WHERE t IS NOT NULL GROUP BY ALL")
def archive_partitions(spark, d):
    valid, _ = split_valid(B.bus_events(spark, d))
    return archive_rows(valid).groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("events"))


@query(f"{POST} SELECT id, 'metadata-extraction-failed' AS error_type FROM post WHERE t IS NULL")
def archive_errors(spark, d):
    _, errors = split_valid(B.bus_events(spark, d))
    return errors.select(F.col("data.id").alias("id"), "error_type")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, strftime(o_orderdate, '%d') AS day FROM orders")
def day_parts_of_orders(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    parts = day_parts(iso)
    return B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), *[c.alias(n) for n, c in parts.items()])


@query(f"{POST} SELECT 'twitter.api.v2' AS source, 'Tweet' AS detail_type, t AS time, id, text FROM post")
def emit_events(spark, d):
    records = emit(B.bus_events(spark, d), K.DETAIL_POST)
    parsed = F.from_json("detail", schemas.ENVELOPE)
    return records.withColumn("e", parsed).select(
        "source", "detail_type", F.col("time").cast("timestamp_ntz").alias("time"), F.col("e.data.id").alias("id"), F.col("e.data.text").alias("text")
    )


@query(f"{POST} SELECT id AS key, id, conv FROM (SELECT id, CAST(event_id // 4 AS VARCHAR) AS conv FROM post)")
def republish_records(spark, d):
    records = republish(B.bus_events(spark, d))
    data = F.from_json("value", schemas.ENVELOPE)["data"]
    return records.select("key", data["id"].alias("id"), data["conversation_id"].alias("conv"))
