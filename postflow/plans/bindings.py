"""The given tables seen as posts, threads, users and links (whole tables, nothing is left out).

post    events, with the document of the same id as text     user   customers
thread  conversations: each turn answers the one before it    link   pages
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow import schemas

DOMAINS = ("Musician", "Sports", "Actor", "Politics", "TV Shows", "Technology", "Science")
REFERENCE_KINDS = {"error": "retweeted", "purchase": "quoted", "click": "replied_to"}
DENIED_SOURCES = ("src1", "src3")

#: The words of the test documents that play the part of a sentiment lexicon.
POSITIVE = ("with", "that", "une", "est", "und", "die", "los", "con")
NEGATIVE = ("of", "by", "les", "des", "der", "nicht", "por", "las")
TERMS = {"the": "TITLE", "there": "OTHER", "with": "OTHER", "elle": "PERSON", "und": "OTHER", "para": "TITLE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    # a pattern, because a stream takes a directory or a pattern but no single file
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _string(col: Column) -> Column:
    return col.cast("string")


def _none(kind: str | T.DataType = "string") -> Column:
    return F.lit(None).cast(kind)


def _as(schema: T.StructType, values: dict[str, Column]) -> list[Column]:
    """Columns in schema order. Nested values have to have their type already: a cast around a struct would have
    the whole struct built again for every field that is read from it."""
    nested = (T.StructType, T.ArrayType)
    return [
        (values[f.name] if isinstance(f.dataType, nested) and f.name in values else values.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]


def raw_posts(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events (also a stream of them) with ``k`` out of their JSON and the document's text, language and source."""
    events = table(spark, sf_dir, "events") if events is None else events
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("event_id"), "text", "lang", F.col("source").alias("label")
    )
    return events.join(documents, "event_id", "left")


def created_at() -> Column:
    """Mostly the event's time as ISO text; some are missing, malformed or from an older year."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event_id = F.col("event_id")
    return (
        F.when(event_id % 50 == 49, F.lit(None))
        .when(event_id % 50 == 48, "not a time")
        .when(event_id % 20 == 7, F.concat(F.lit("2019"), F.substring(iso, 5, 100)))
        .otherwise(iso)
    )


def post_struct() -> Column:
    """A post out of a row of :func:`raw_posts`."""
    k, event_id = F.col("k"), F.col("event_id")
    names = F.array(*[F.lit(d) for d in DOMAINS])

    def named(name: Column) -> Column:
        return F.struct(_none().alias("id"), name.alias("name"), _none().alias("description"))

    def annotation(domain: Column, entity: Column) -> Column:
        return F.struct(
            named(F.get(names, domain.cast("int"))).alias("domain"),
            named(F.concat(F.lit("entity"), _string(entity))).alias("entity"),
        )

    context = F.when(k % 5 != 0, F.array(annotation(k % 7, k % 11), annotation((k * 3 + 1) % 7, k % 4)))
    kind = F.col("event_type")
    reference_kind = F.lit(None).cast("string")
    for event_type, name in REFERENCE_KINDS.items():
        reference_kind = F.when(kind == event_type, name).otherwise(reference_kind)
    references = F.when(
        reference_kind.isNotNull(),
        F.array(F.struct(reference_kind.alias("type"), _string(event_id - 1).alias("id"))),
    )
    tags = F.array(F.struct(F.upper(kind).alias("tag")), F.struct(F.concat(F.lit("K"), _string(k % 10)).alias("tag")))
    mention = F.struct(F.concat(F.lit("User"), _string(F.col("user_id"))).alias("username"), _string(F.col("user_id")).alias("id"))
    host = F.concat(F.lit("host"), _string(k % 13), F.lit(".example/"))
    link = F.struct(
        _none().alias("url"),
        F.concat(F.lit("https://"), host, _string(event_id)).alias("expanded_url"),
        F.concat(host, _string(event_id)).alias("display_url"),
        F.when(k % 3 == 0, F.concat(F.lit("Title "), _string(k))).alias("title"),
        _none().alias("description"),
    )
    entities = F.struct(
        _none(schemas.ENTITIES["annotations"].dataType).alias("annotations"),
        _none(schemas.ENTITIES["cashtags"].dataType).alias("cashtags"),
        tags.alias("hashtags"),
        F.array(mention).alias("mentions"),
        F.when(k % 2 == 0, F.array(link)).alias("urls"),
    )
    lon = (event_id % 360).cast("double") - 179.5
    lat = (event_id % 170).cast("double") - 84.75
    point = F.when(event_id % 3 == 0, F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))
    place = F.when(event_id % 3 == 1, F.concat(F.lit("place"), _string(k % 6)))
    geo = F.when(event_id % 3 != 2, F.struct(point.alias("coordinates"), place.alias("place_id")))
    metrics = F.struct(
        (k % 10).alias("retweet_count"),
        (k % 7).alias("reply_count"),
        F.floor("value").alias("like_count"),
        (k % 3).alias("quote_count"),
    )
    values = {
        "id": _string(event_id),
        "text": F.col("text"),
        "author_id": _string(F.col("user_id")),
        "conversation_id": _string(F.floor(event_id / 4)),
        "created_at": created_at(),
        "lang": F.col("lang"),
        "source": F.col("label"),
        "in_reply_to_user_id": F.lit(None),
        "possibly_sensitive": kind == "error",
        "reply_settings": F.lit("everyone"),
        "public_metrics": metrics,
        "context_annotations": context,
        "entities": entities,
        "referenced_tweets": references,
        "geo": geo,
    }
    return F.struct(*_as(schemas.POST, values))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post columns."""
    return raw_posts(spark, sf_dir).select(post_struct().alias("data")).select("data.*")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer in the user schema."""
    customer = table(spark, sf_dir, "customer")
    values = {
        "id": _string(F.col("c_custkey")),
        "name": F.col("c_name"),
        "username": F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))),
        "url": F.lit(None),
        "verified": F.col("c_acctbal") > 5000,
        "public_metrics": F.struct(
            F.floor(F.abs("c_acctbal")).alias("followers_count"),
            F.col("c_nationkey").cast("bigint").alias("following_count"),
            F.lit(0).cast("bigint").alias("tweet_count"),
            F.lit(0).cast("bigint").alias("listed_count"),
        ),
    }
    return customer.select(*_as(schemas.USER, values))


def bus_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Posts as bus events; the author travels in ``includes`` and is named after the id."""
    k = F.col("k")
    rule = F.struct(
        F.when(k % 4 != 1, F.concat(F.lit("rule"), _string(k % 4))).alias("id"), F.lit("t").alias("tag")
    )
    author = F.struct(
        _string(F.col("user_id")).alias("id"),
        F.concat(F.lit("Name "), _string(F.col("user_id"))).alias("name"),
        F.concat(F.lit("user"), _string(F.col("user_id"))).alias("username"),
    )
    full_author = F.struct(*_as(schemas.USER, {n: author[n] for n in ("id", "name", "username")}))
    included = F.col("event_type").isin("signup", "error")
    return raw_posts(spark, sf_dir, events).select(
        F.lit(K.BUS_SOURCE).alias("source"),
        F.when(included, K.DETAIL_INCLUDED).otherwise(K.DETAIL_POST).alias("detail_type"),
        F.try_to_timestamp(created_at()).alias("event_time"),
        F.when(k % 10 == 0, "replay-1").alias("replay_name"),
        post_struct().alias("data"),
        F.struct(
            F.when(k % 6 != 0, F.array(full_author)).otherwise(F.array()).cast(schemas.INCLUDES["users"].dataType).alias("users"),
            F.lit(None).cast(schemas.INCLUDES["tweets"].dataType).alias("tweets"),
            F.lit(None).cast(schemas.INCLUDES["places"].dataType).alias("places"),
        ).alias("includes"),
        F.when(k % 4 == 0, F.array()).otherwise(F.array(rule)).cast(schemas.RULES).alias("matching_rules"),
        F.lit(None).cast(schemas.ERRORS).alias("errors"),
        F.lit(None).cast("boolean").alias("backup"),
    )


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as posts: a turn answers the one before and, from the third on, quotes the first."""
    conv, turn = _string(F.col("conv_id")), F.col("turn")

    def ref(kind: str, target: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.concat(conv, F.lit("-"), _string(target)).alias("id"))

    references = (
        F.when(turn > 1, F.array(ref("replied_to", turn - 1), ref("quoted", F.lit(0))))
        .when(turn == 1, F.array(ref("replied_to", F.lit(0))))
    )
    values = {
        "id": F.concat(conv, F.lit("-"), _string(turn)),
        "text": F.col("text"),
        "author_id": F.col("role"),
        "conversation_id": conv,
        "created_at": F.lit("2024-02-01T00:00:00.000Z"),
        "lang": F.lit("en"),
        "source": F.col("role"),
        "referenced_tweets": references,
    }
    return table(spark, sf_dir, "conversations").select(*_as(schemas.POST, values))


def thread_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of the conversations as users."""
    roles = table(spark, sf_dir, "conversations").select(F.col("role").alias("id")).distinct()
    values = {"id": F.col("id"), "name": F.initcap("id"), "username": F.col("id")}
    return roles.select(*_as(schemas.USER, values))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as state rows without analysis; the event's own time is the version."""
    rows = posts(spark, sf_dir)
    version = F.coalesce(F.unix_seconds(F.try_to_timestamp("created_at")), F.lit(0))
    return rows.select(
        *schemas.POST.names,
        version.alias("updated_at"),
        F.lit(None).cast("string").alias("normalized_text"),
        F.lit(None).cast(schemas.ANALYSIS).alias("comprehend"),
        F.lit(None).cast(schemas.USER).alias("author"),
        F.lit(K.STATE_STUB).alias("_all"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as url entities of a post with the page's id."""
    url = F.struct(
        F.lit(None).cast("string").alias("url"),
        F.col("url").alias("expanded_url"),
        F.regexp_replace("url", "^https?://", "").alias("display_url"),
        F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"),
        F.lit(None).cast("string").alias("description"),
    )
    return table(spark, sf_dir, "pages").select(_string(F.col("page_id")).alias("id"), F.array(url).alias("urls"))
