"""Keyed merges, partial documents and the document projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from postflow import schemas
from postflow.functions import flatten as X
from postflow.operators import state as S
from postflow.operators.document import to_document as document
from postflow.operators.document import upsert_documents as upsert
from postflow.operators.metrics import counted
from postflow.plans import bindings as B
from postflow.plans.queries.registry import POST, query

#: Versions of one keyed row: the key repeats over user and property, stored rows come from two event types.
VERSIONS = """WITH v AS (SELECT event_id, user_id || '-' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS id,
  CAST(floor(epoch(ts) / 86400) AS BIGINT) AS updated_at, CAST(floor(value) AS BIGINT) AS likes, event_type FROM events)"""
_STORED = """s AS (SELECT id, arg_max(updated_at, event_id) AS updated_at, arg_max(likes, event_id) AS likes,
  arg_max(event_type, event_id) AS text FROM v WHERE event_type IN ('view', 'signup') GROUP BY 1)"""
_NEW = """n AS (SELECT id, arg_max(likes, {'u': updated_at, 'a': -event_id}) AS likes, max(updated_at) AS updated_at
  FROM v WHERE event_type NOT IN ('view', 'signup') GROUP BY 1)"""


def _versions(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    likes = F.floor("value")
    zero = F.lit(0).cast("bigint")
    metrics = F.struct(
        zero.alias("retweet_count"), zero.alias("reply_count"), likes.alias("like_count"), zero.alias("quote_count")
    )
    return B.table(spark, d, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (k % 20).cast("string")).alias("id"),
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("updated_at"),
        metrics.alias("public_metrics"),
        F.col("event_type").alias("text"),
        F.col("event_id").alias("arrival"),
    )


def _stored_and_new(spark, d):
    rows = _versions(spark, d)
    stored = F.col("text").isin("view", "signup")
    return S.last_row(rows.where(stored)).drop("arrival"), rows.where(~stored)


@query(f"{VERSIONS} SELECT id, arg_max(updated_at, event_id) AS updated_at, arg_max(likes, event_id) AS likes FROM v GROUP BY 1")
def put_last(spark, d):
    """Every arrival replaces the row."""
    rows = _versions(spark, d)
    empty = spark.createDataFrame([], rows.drop("arrival").schema)
    rows = S.put_rows(empty, rows)
    return rows.select("id", "updated_at", F.col("public_metrics.like_count").alias("likes"))


@query(
    f"""{VERSIONS}, {_STORED}, p AS (SELECT id, arg_max(updated_at, event_id) AS updated_at, arg_max(likes, event_id) AS likes,
  arg_max(event_type, event_id) AS text FROM v WHERE event_type NOT IN ('view', 'signup') GROUP BY 1)
SELECT id, coalesce(p.updated_at, s.updated_at) AS updated_at, coalesce(p.likes, s.likes) AS likes, coalesce(p.text, s.text) AS text
FROM s FULL OUTER JOIN p USING (id)"""
)
def put_rows(spark, d):
    stored, new = _stored_and_new(spark, d)
    rows = S.put_rows(stored, new)
    return rows.select("id", "updated_at", F.col("public_metrics.like_count").alias("likes"), "text")


@query(
    f"{VERSIONS} SELECT id, max(updated_at) AS updated_at, arg_max(likes, {{'u': updated_at, 'a': -event_id}}) AS likes FROM v GROUP BY 1"
)
def latest_metrics(spark, d):
    rows = S.latest_metrics(_versions(spark, d))
    return rows.select("id", "updated_at", F.col("public_metrics.like_count").alias("likes"))


@query(
    f"""{VERSIONS}, {_STORED}, {_NEW}
SELECT id, CASE WHEN s.id IS NULL OR n.updated_at > s.updated_at THEN n.updated_at ELSE s.updated_at END AS updated_at,
  CASE WHEN s.id IS NULL OR n.updated_at > s.updated_at THEN n.likes ELSE s.likes END AS likes, s.text
FROM s FULL OUTER JOIN n USING (id)"""
)
def merge_metrics(spark, d):
    merged, _ = S.merge_metrics(*_stored_and_new(spark, d))
    return merged.select("id", "updated_at", F.col("public_metrics.like_count").alias("likes"), "text")


@query(f"{VERSIONS}, {_STORED}, {_NEW} SELECT n.id, n.updated_at FROM n LEFT JOIN s USING (id) WHERE s.id IS NULL")
def new_stubs(spark, d):
    """Rows first seen as an update: they still need their full load."""
    _, is_new = S.merge_metrics(*_stored_and_new(spark, d))
    return is_new


@query(
    f"""{VERSIONS}, {_STORED}, {_NEW} SELECT n.id, n.updated_at, s.updated_at AS stored_at FROM n LEFT JOIN s USING (id)"""
)
def join_state(spark, d):
    stored, new = _stored_and_new(spark, d)
    joined = S.join_state(S.latest_metrics(new), stored)
    return joined.select("id", "updated_at", F.col("stored.updated_at").alias("stored_at"))


@query(
    f"""{POST} SELECT CAST(user_id AS VARCHAR) AS id, arg_max(text, event_id) FILTER (WHERE text IS NOT NULL) AS text,
  arg_max(label, event_id) FILTER (WHERE label IS NOT NULL) AS source, arg_max(likes, event_id) AS likes,
  arg_max(dom1, event_id) FILTER (WHERE dom1 IS NOT NULL) AS first_domain, max(event_id) AS version FROM post GROUP BY 1"""
)
def merge_partial_doc(spark, d):
    """Newest present value per leaf field over all documents of a key."""
    rows = B.posts(spark, d).select(
        F.col("author_id").alias("id"),
        "text",
        "source",
        "public_metrics",
        F.col("context_annotations"),
        F.col("id").cast("bigint").alias("version"),
    )
    merged = S.merge_partial(rows)
    return merged.select(
        "id",
        "text",
        "source",
        F.col("public_metrics.like_count").alias("likes"),
        F.get("context_annotations", F.lit(0))["domain"]["name"].alias("first_domain"),
        "version",
    )


@query(
    f"""{POST}, old AS (SELECT id, text, label, likes FROM post WHERE t IS NOT NULL),
new AS (SELECT post.id, d.text FROM post JOIN documents d ON d.doc_id = post.event_id JOIN labels USING (doc_id) WHERE t IS NOT NULL)
SELECT old.id, coalesce('new: ' || new.text, '') AS upserted, old.text, old.label AS source,
  CASE WHEN p.ref_kind = 'retweeted' THEN 0 ELSE old.likes END AS likes, strftime(p.t, '%Y-%m') AS month
FROM old JOIN post p USING (id) LEFT JOIN new USING (id)"""
)
def upsert_documents(spark, d):
    """Partial documents of the labelled posts (only a normalised text) over the stored documents."""
    gold = document(B.state(spark, d)).where(F.col("month").isNotNull())
    labels = B.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    changed = gold.join(labels, "id", "left_semi")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.DOCUMENT.fields}
    partial = {**blank, "id": F.col("id"), "month": F.col("month"), "normalized_text": F.concat(F.lit("new: "), "text")}
    docs = changed.select(*[partial[n].alias(n) for n in schemas.DOCUMENT.names], F.lit(1).cast("bigint").alias("version"))
    merged = upsert(gold, docs)
    return merged.select(
        "id",
        F.coalesce("normalized_text", F.lit("")).alias("upserted"),
        "text",
        "source",
        F.col("public_metrics.like_count").alias("likes"),
        "month",
    )


@query(
    f"""{POST} SELECT id, 'https://twitter.com/0/status/' || id AS url, t AS created_at, strftime(t, '%Y-%m') AS month,
  CASE WHEN ref_kind = 'retweeted' THEN 0 ELSE likes END AS likes, ref_kind AS ref_type,
  CASE WHEN dom1 = dom2 THEN dom1 ELSE dom1 || '|' || dom2 END AS domains, lower(event_type) || '|k' || (k % 10) AS hashtags,
  'user' || user_id AS mentions, CASE WHEN k % 2 = 0 THEN 'host' || (k % 13) || '.example' ELSE '' END AS display_domains,
  CASE WHEN event_id % 3 = 0 THEN event_id % 360 - 179.5 END AS lon, CASE WHEN event_id % 3 = 1 THEN 'place' || (k % 6) END AS place_id
FROM post"""
)
def to_document(spark, d):
    docs = document(B.state(spark, d))
    return docs.select(
        "id",
        "url",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        "month",
        F.col("public_metrics.like_count").alias("likes"),
        F.get("referenced_tweets.type", F.lit(0)).alias("ref_type"),
        F.array_join("context_annotations.domain", "|").alias("domains"),
        F.array_join("entities.hashtag", "|").alias("hashtags"),
        F.array_join("entities.mention", "|").alias("mentions"),
        F.array_join("entities.url.display_domain", "|").alias("display_domains"),
        F.get("geo.coordinates.coordinates", F.lit(0)).alias("lon"),
        F.col("geo.place_id").alias("place_id"),
    )


@query(
    f"""{POST} SELECT event_type, CAST(sum(CASE WHEN ref_kind = 'retweeted' THEN 0 ELSE likes END) AS BIGINT) AS likes,
  CAST(sum(likes) AS BIGINT) AS likes_in_state FROM post GROUP BY 1"""
)
def retweet_zero(spark, d):
    rows = B.raw_posts(spark, d).select("event_type", B.post_struct().alias("p"))
    types = F.transform("p.referenced_tweets", lambda r: r["type"])
    zeroed = X.zero_if_retweet(F.col("p.public_metrics"), types)
    return rows.groupBy("event_type").agg(
        F.sum(zeroed["like_count"]).alias("likes"), F.sum("p.public_metrics.like_count").alias("likes_in_state")
    )


@query(
    f"""{POST} SELECT id, CASE WHEN dom1 = dom2 THEN dom1 ELSE dom1 || '|' || dom2 END AS domains,
  CASE WHEN ent1 = ent2 THEN ent1 ELSE ent1 || '|' || ent2 END AS entities FROM post"""
)
def context_distinct(spark, d):
    flat = B.posts(spark, d).select("id", X.flat_context(F.col("context_annotations")).alias("c"))
    return flat.select("id", F.array_join("c.domain", "|").alias("domains"), F.array_join("c.entity", "|").alias("entities"))


@query(
    """SELECT CAST(page_id AS VARCHAR) AS id, split_part(split_part(url, '://', 2), '/', 1) AS domains, url AS expanded_url,
  coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '') AS titles FROM pages"""
)
def display_domain(spark, d):
    flat = B.links(spark, d).select("id", X.flat_urls(F.col("urls")).alias("u"))
    return flat.select(
        "id",
        F.array_join("u.display_domain", "|").alias("domains"),
        F.array_join("u.expanded_url", "|").alias("expanded_url"),
        F.array_join("u.title", "|").alias("titles"),
    )


@query(
    f"""{POST} SELECT id, CASE WHEN event_id % 3 = 0 THEN 'Point' END AS type, CASE WHEN event_id % 3 = 0 THEN event_id % 170 - 84.75 END AS lat,
  CASE WHEN event_id % 3 = 1 THEN 'place' || (k % 6) END AS place_id, event_id % 3 <> 2 AS present FROM post"""
)
def geo(spark, d):
    flat = B.posts(spark, d).select("id", X.flat_geo(F.col("geo")).alias("g"))
    return flat.select(
        "id",
        F.col("g.coordinates.type").alias("type"),
        F.get("g.coordinates.coordinates", F.lit(1)).alias("lat"),
        F.col("g.place_id").alias("place_id"),
        F.col("g").isNotNull().alias("present"),
    )


@query(f"{POST} SELECT id, 'stub' AS stub, created_at FROM post WHERE created_at IS NOT NULL")
def time_keys(spark, d):
    return S.time_keys(B.state(spark, d)).withColumnRenamed("_all", "stub")


@query(
    f"""{POST} SELECT id, created_at FROM post WHERE created_at >= '2024-01-05' AND created_at < '2024-01-15' ORDER BY created_at, id"""
)
def time_listing(spark, d):
    return S.time_listing(B.posts(spark, d), "2024-01-05", "2024-01-15").select("id", "created_at")


@query(
    f"""{POST} SELECT id, created_at FROM post WHERE created_at > '2024-01-10' OR (created_at = '2024-01-10' AND id > '0')
ORDER BY created_at, id LIMIT 50"""
)
def next_page(spark, d):
    return S.next_page(B.posts(spark, d).select("id", "created_at"), ("2024-01-10", "0"))


@query(
    f"""{POST} SELECT count(*) AS incoming, count(*) FILTER (WHERE t IS NULL) AS failed, count(*) FILTER (WHERE t IS NOT NULL) AS successful,
  count(*) FILTER (WHERE detail_type = 'IncludedTweet') AS updates FROM post"""
)
def ingest_counters(spark, d):
    """Counters observed while the job runs, and the same numbers from its output."""
    events = B.bus_events(spark, d).select("detail_type", "event_time")
    conditions = {
        "failed": F.col("event_time").isNull(),
        "successful": F.col("event_time").isNotNull(),
        "updates": F.col("detail_type") == "IncludedTweet",
    }
    observed, observation = counted(events, "ingest", **conditions)
    observed.write.format("noop").mode("overwrite").save()
    numbers = observation.get
    names = ["incoming", *conditions]
    return spark.createDataFrame([[numbers[n] for n in names]], ", ".join(f"{n} BIGINT" for n in names))
