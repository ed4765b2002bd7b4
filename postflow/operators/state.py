"""Latest state per post: projections of bus events and the keyed merges.

Every aggregate here keeps one value per key and combines before its shuffle, so an id that makes up a large
share of a batch shrinks to one row per map task before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow import schemas
from postflow.functions.keys import epoch_seconds, to_time, year_key
from postflow.operators import filters
from postflow.operators.fanout import author_of

# --- projections -------------------------------------------------------------------------------


def empty_to_null(df: DataFrame) -> DataFrame:
    """Writers of state rows store empty text as null."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in strings})


def to_state_row(events: DataFrame, now: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Bus events to state rows, still without analysis; ``keep`` names event columns to carry along."""
    rows = events.select(
        "data.*",
        epoch_seconds(F.col("event_time"), now).alias("updated_at"),
        F.lit(None).cast("string").alias("normalized_text"),
        F.lit(None).cast(schemas.ANALYSIS).alias("comprehend"),
        author_of(F.col("includes.users"), F.col("data.author_id")).alias("author"),
        F.lit(K.STATE_STUB).alias("_all"),
        *keep,
    )
    return empty_to_null(rows)


def to_state_row_v1(
    envelopes: DataFrame,
    labels: Sequence[str] = (),
    domains: Sequence[str] = K.DENIED_CONTEXT_DOMAINS,
    floor: str = K.DATE_FLOOR,
    now: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Legacy projection: main and included posts of an envelope, ``kind`` = ``main`` or ``included``.

    An envelope whose main post is filtered out yields nothing. Included rows carry the main post's time.
    """

    def allowed(post: Column) -> Column:
        return (
            filters.source_allowed(post["source"], labels)
            & filters.domain_allowed(post["context_annotations"], domains)
            & filters.created_after(post["created_at"], floor)
        )

    kept = envelopes.where(allowed(F.col("data")))
    included = F.filter("includes.tweets", allowed)
    posts = F.concat(
        F.array(F.struct(F.lit("main").alias("kind"), F.col("data").alias("post"))),
        F.coalesce(
            F.transform(
                included, lambda t: F.struct(F.lit("included").alias("kind"), t.alias("post"))
            ),
            F.array(),
        ),
    )
    updated_at = epoch_seconds(to_time(F.col("data.created_at")), now)
    rows = kept.select(
        F.explode(posts).alias("p"),
        F.col("includes.users").alias("_users"),
        updated_at.alias("updated_at"),
        *keep,
    )
    return empty_to_null(
        rows.select(
            "p.kind",
            "p.post.*",
            author_of(F.col("_users"), F.col("p.post.author_id")).alias("author"),
            year_key(F.col("p.post.created_at")).alias("created_at_year"),
            "updated_at",
            *keep,
        )
    )


def time_keys(state: DataFrame) -> DataFrame:
    """Keys of the rows that take part in time listings."""
    listed = state.where(F.col("_all").isNotNull() & F.col("created_at").isNotNull())
    return listed.select("id", "_all", "created_at")


# --- one row per key ---------------------------------------------------------------------------


def last_row(df: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """The last arrival per key."""
    rest = [c for c in df.columns if c not in (key, arrival)]
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), arrival).alias("_row"), F.max(arrival).alias(arrival)
    )
    return picked.select(key, "_row.*", arrival)


def latest_by_version(
    df: DataFrame, key: str = "id", version: str = "updated_at", arrival: str = "arrival"
) -> DataFrame:
    """The row with the newest version per key; of equal versions the first arrival."""
    rest = [c for c in df.columns if c != key]
    newest_first = F.struct(F.col(version).isNull(), -F.col(version), F.col(arrival))
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), newest_first).alias("_row"))
    return picked.select(key, "_row.*")


def latest_metrics(
    df: DataFrame, key: str = "id", version: str = "updated_at", arrival: str = "arrival"
) -> DataFrame:
    """``(key, public_metrics, version)`` of the update that wins per key."""
    return latest_by_version(df.select(key, "public_metrics", version, arrival), key, version, arrival).drop(
        arrival
    )


def merge_partial(df: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Per key and leaf field the newest present value: structs merge field by field, arrays are replaced."""
    aggregates: list[Column] = []

    def newest(path: str, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            fields = [newest(f"{path}.{f.name}", f.dataType, f.name) for f in kind.fields]
            # nothing below is present: the struct itself is absent
            any_present = F.greatest(*[f.isNotNull() for f in fields]) if len(fields) > 1 else fields[0].isNotNull()
            return F.when(any_present, F.struct(*fields)).alias(name)
        slot = f"_leaf{len(aggregates)}"
        aggregates.append(
            F.max_by(F.col(path), F.when(F.col(path).isNotNull(), F.col(version))).alias(slot)
        )
        return F.col(slot).alias(name)

    fields = [newest(f.name, f.dataType, f.name) for f in df.schema.fields if f.name not in (key, version)]
    merged = df.groupBy(key).agg(*aggregates, F.max(version).alias(version))
    return merged.select(key, *fields, version)


# --- merges with the stored rows ---------------------------------------------------------------


def put_rows(state: DataFrame, batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Unconditional put: the last arrival replaces the whole stored row."""
    rows = last_row(batch, "id", arrival).drop(arrival)
    return state.join(rows.select("id"), "id", "left_anti").unionByName(rows, allowMissingColumns=True)


def join_state(batch: DataFrame, state: DataFrame) -> DataFrame:
    """``batch`` (one row per id) with the stored row as struct ``stored``, null where there is none.

    Against a large state, reduce it first: :func:`postflow.operators.skew.keep_matching`.
    """
    stored = state.select("id", F.struct(*[F.col(c) for c in state.columns]).alias("stored"))
    return batch.join(stored, "id", "left")


def update_applies(stored_version: Column, exists: Column, new_version: Column) -> Column:
    """Strictly newer, or no stored row. A stored row without a version is never updated."""
    return ~exists | F.coalesce(stored_version < new_version, F.lit(False))


def merge_metrics(
    state: DataFrame, batch: DataFrame, arrival: str = "arrival"
) -> tuple[DataFrame, DataFrame]:
    """Conditional metric update; returns the new state and the rows that are still without text.

    Both sides have one row per id by the time they meet. A missing row becomes a stub of id, metrics and time.
    """
    new = latest_metrics(batch, arrival=arrival).select(
        "id", F.col("public_metrics").alias("_metrics"), F.col("updated_at").alias("_version")
    )
    old = state.withColumn("_exists", F.lit(True))
    joined = old.join(new, "id", "full_outer")
    exists = F.coalesce("_exists", F.lit(False))
    applies = F.col("_version").isNotNull() & update_applies(F.col("updated_at"), exists, F.col("_version"))
    merged = joined.select(
        *[
            F.when(applies, F.col({"public_metrics": "_metrics", "updated_at": "_version"}[c])).otherwise(F.col(c)).alias(c)
            if c in ("public_metrics", "updated_at")
            else F.col(c)
            for c in state.columns
        ],
        applies.alias("_applied"),
    )
    is_new = merged.where(F.col("_applied") & F.col("text").isNull()).select("id", "updated_at")
    return merged.drop("_applied"), is_new


def attach_analysis(state: DataFrame, results: DataFrame) -> DataFrame:
    """Sets ``normalized_text`` and ``comprehend`` of rows that exist; ``results`` has one row per id."""
    new = results.select(
        "id",
        F.col("normalized_text").alias("_text"),
        F.col("comprehend").alias("_analysis"),
        F.lit(True).alias("_hit"),
    )
    joined = state.join(new, "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.withColumns(
        {
            "normalized_text": F.when(hit, F.col("_text")).otherwise(F.col("normalized_text")),
            "comprehend": F.when(hit, F.col("_analysis")).otherwise(F.col("comprehend")),
        }
    ).select(*state.columns)


# --- listings ----------------------------------------------------------------------------------


def time_listing(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a time range in time order (range-partitioned sort, no single task holds it all)."""
    created = F.col("created_at")
    if start is not None:
        df = df.where(created >= start)
    if end is not None:
        df = df.where(created < end)
    return df.orderBy("created_at", "id")


def next_page(df: DataFrame, after: tuple[str, str] | None = None, n: int = K.PAGE_SIZE) -> DataFrame:
    """One page of the time listing, after the last ``(created_at, id)`` seen."""
    if after is not None:
        time, post_id = after
        created = F.col("created_at")
        df = df.where((created > time) | ((created == time) & (F.col("id") > post_id)))
    return df.orderBy("created_at", "id").limit(n)
