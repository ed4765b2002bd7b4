"""Envelopes to posts: authors, referenced and included posts, hydration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow.operators import filters
from postflow.operators.skew import BROADCAST_ROWS, has_at_most, keep_matching, lookup_join, small_lookup


def author_of(users: Column, author_id: Column) -> Column:
    """First user of the envelope with that id, else null."""
    return F.get(F.filter(users, lambda u: u["id"] == author_id), F.lit(0))


def first_per_key(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """The first arrival per key (combined before the shuffle, so a hot key is no problem)."""
    rest = [c for c in df.columns if c not in (key, arrival)]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), arrival).alias("_row"))
    return picked.select(key, "_row.*")


def with_author(df: DataFrame, users: DataFrame | None = None, arrival: str | None = None) -> DataFrame:
    """Adds ``author``.

    Without ``users`` it is looked up inside the envelope (columns ``data`` and ``includes``), no shuffle.
    With ``users`` (struct fields as columns, id first seen by ``arrival`` wins) ``df`` has ``author_id``.
    """
    if users is None:
        return df.withColumn("author", author_of(F.col("includes.users"), F.col("data.author_id")))
    if arrival:
        users = first_per_key(users, "id", arrival)
    fields = [c for c in users.columns if c != arrival]
    authors = users.select(
        F.col("id").alias("author_id"), F.struct(*[F.col(c) for c in fields]).alias("author")
    )
    # posts are spread by their id: prolific authors are the usual hot keys
    spread = [F.col("id")] if "id" in df.columns else None
    return lookup_join(df, authors, "author_id", "left", spread=spread)


def author_list(df: DataFrame) -> DataFrame:
    """Adds ``authors``: all users of the envelope with the author's id."""
    users, author_id = F.col("includes.users"), F.col("data.author_id")
    return df.withColumn("authors", F.filter(users, lambda u: u["id"] == author_id))


def referenced_posts(df: DataFrame) -> DataFrame:
    """Keeps of ``includes.tweets`` only the posts this post refers to."""
    ids = F.transform(
        F.coalesce(F.col("data.referenced_tweets"), F.array().cast("array<struct<type:string,id:string>>")),
        lambda r: r["id"],
    )
    kept = F.filter(F.col("includes.tweets"), lambda t: F.array_contains(ids, t["id"]))
    return df.withColumn("includes", F.col("includes").withField("tweets", kept))


def referenced_semi(posts: DataFrame, referring: DataFrame, ids: Column) -> DataFrame:
    """``posts`` that some row of ``referring`` refers to; ``ids`` is its array of referenced ids."""
    wanted = referring.select(F.explode(ids).alias("id")).distinct()
    return posts.join(wanted, "id", "left_semi")


def fanout(events: DataFrame) -> DataFrame:
    """One event per included post, with the carrier's time and includes and without matching rules."""
    exploded = events.withColumn("_included", F.explode("includes.tweets"))
    no_rules = F.array().cast(events.schema["matching_rules"].dataType)
    return exploded.withColumns(
        {
            "data": F.col("_included"),
            "matching_rules": no_rules,
            "detail_type": F.lit(K.DETAIL_INCLUDED),
            "source": F.lit(K.BUS_SOURCE),
        }
    ).drop("_included")


def distinct_ids(df: DataFrame, id_col: str = "id_str") -> DataFrame:
    return df.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()


def assemble_includes(posts: DataFrame, pool: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """Envelopes for ``posts`` (post columns): ``data`` and ``includes`` with the author and the referenced posts.

    Referenced posts come from ``pool`` (default: ``posts`` itself). An envelope collects no more posts than
    its own ``referenced_tweets`` array names, whatever the input. ``users`` has one row per id.
    """
    pool = posts if pool is None else pool
    base = posts.select("id", "author_id", F.struct(*[F.col(c) for c in posts.columns]).alias("data"))
    refs = posts.select(
        F.col("id").alias("_carrier"), F.posexplode("referenced_tweets").alias("_pos", "_ref")
    ).select("_carrier", "_pos", F.col("_ref.id").alias("id"))
    targets = pool.select("id", F.struct(*[F.col(c) for c in pool.columns]).alias("_post"))
    # viral posts are referred to by very many others
    found = lookup_join(refs, targets, "id", "inner", spread=[F.col("_carrier"), F.col("_pos")])
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "id", "_post")))
    included = found.groupBy("_carrier").agg(ordered.alias("_found"))
    included = included.select(
        F.col("_carrier").alias("id"),
        F.array_distinct(F.transform("_found", lambda f: f["_post"])).alias("_tweets"),
    )
    joined = base.join(included, "id", "left")
    no_posts = F.array().cast(included.schema["_tweets"].dataType)
    includes = [F.coalesce("_tweets", no_posts).alias("tweets")]
    if users is not None:
        joined = with_author(joined, users)
        no_users = F.array().cast(T.ArrayType(joined.schema["author"].dataType))
        found_user = F.when(F.col("author").isNotNull(), F.array("author")).otherwise(no_users)
        includes.insert(0, found_user.alias("users"))
    return joined.select("data", F.struct(*includes).alias("includes"))


def hydrate(
    ids: DataFrame,
    posts: DataFrame,
    users: DataFrame | None = None,
    labels: Sequence[str] = (),
    domains: Sequence[str] = (),
) -> DataFrame:
    """Full envelopes, marked ``backup``, of the distinct ``ids`` found in ``posts``.

    Posts from denied sources or about denied domains get no envelope of their own, but may be included. Few ids (they
    are counted), and few references, go to where the posts are read; only posts with them are moved then.
    """
    found = keep_matching(posts, ids.select("id").distinct(), "id")
    kept = filters.deny_domain(filters.deny_source(found, labels), domains)
    referenced = kept.select(F.explode("referenced_tweets.id").alias("id")).distinct()
    pool = posts.join(F.broadcast(referenced), "id", "left_semi") if has_at_most(referenced, BROADCAST_ROWS) else posts
    return assemble_includes(kept, pool, users).withColumn("backup", F.lit(True))


def deny_join(df: DataFrame, deny: DataFrame, annotations: str = "context_annotations") -> DataFrame:
    """:func:`filters.deny_domain` against a deny *table* (column ``domain``), for lists too long for a literal.

    The names of a post's annotations are exploded and matched; posts with a match are removed by id.
    """
    domains = F.array_distinct(F.transform(annotations, lambda a: a["domain"]["name"]))
    names = df.select("id", F.explode(domains).alias("domain"))
    denied = small_lookup(
        names, deny.select("domain").distinct(), "domain", "left_semi", spread=[F.col("id")]
    )
    return df.join(denied.select("id").distinct(), "id", "left_anti")
