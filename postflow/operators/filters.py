"""Predicates and routing. All are native expressions, so they reach the Parquet scan where the format allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow import constants as K
from postflow.functions.keys import to_time


def _present(condition: Column) -> Column:
    """Two-valued: an unknown answer counts as no."""
    return F.coalesce(condition, F.lit(False))


# --- conditions (also used inside arrays of included posts) ---------------------------------


def source_allowed(source: Column, labels: Sequence[str]) -> Column:
    return ~F.coalesce(source, F.lit("")).isin(*labels) if labels else F.lit(True)


def domain_allowed(annotations: Column, domains: Sequence[str], mode: str = "none") -> Column:
    """``none``: no annotation is denied, missing annotations pass. ``any``: some annotation is not denied."""
    denied = list(domains)
    if mode == "none":
        return ~_present(F.exists(annotations, lambda a: _present(a["domain"]["name"].isin(denied))))
    if mode == "any":
        return _present(F.exists(annotations, lambda a: _present(~a["domain"]["name"].isin(denied))))
    raise ValueError(f"unknown mode {mode!r}")


def created_after(created_at: Column, floor: str = K.DATE_FLOOR) -> Column:
    return _present(to_time(created_at) > F.lit(floor).cast("timestamp"))


# --- filters --------------------------------------------------------------------------------


def deny_source(df: DataFrame, labels: Sequence[str], source: str = "source") -> DataFrame:
    return df.where(source_allowed(F.col(source), labels))


def deny_domain(
    df: DataFrame,
    domains: Sequence[str] = K.DENIED_CONTEXT_DOMAINS,
    mode: str = "none",
    annotations: str = "context_annotations",
) -> DataFrame:
    return df.where(domain_allowed(F.col(annotations), domains, mode))


def date_floor(df: DataFrame, floor: str = K.DATE_FLOOR, created_at: str = "created_at") -> DataFrame:
    return df.where(created_after(F.col(created_at), floor))


def created_prefix(df: DataFrame, prefix: str = K.CREATED_PREFIX, created_at: str = "created_at") -> DataFrame:
    return df.where(F.col(created_at).startswith(prefix))


def rule_exists(df: DataFrame, rules: str = "matching_rules") -> DataFrame:
    return df.where(_present(F.exists(F.col(rules), lambda r: r["id"].isNotNull())))


def route(df: DataFrame, detail_type: str, source: str = K.BUS_SOURCE) -> DataFrame:
    """The branch of one consumer; an event may belong to several branches."""
    return df.where((F.col("source") == source) & (F.col("detail_type") == detail_type))


def exclude_replayed(df: DataFrame) -> DataFrame:
    return df.where(F.col("replay_name").isNull())


def change_filter(df: DataFrame) -> DataFrame:
    """Changes worth indexing; stub rows have no text yet."""
    return df.where(
        F.col("event_name").isin(*K.CHANGE_EVENTS)
        & F.col("text").isNotNull()
        & F.col("created_at").isNotNull()
    )


def needs_enrichment(df: DataFrame) -> DataFrame:
    return df.where(
        F.col("event_name").isin(*K.CHANGE_EVENTS)
        & F.col("text").isNotNull()
        & F.col("comprehend").isNull()
    )


def is_supported_language(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(K.DEFAULT_LANGUAGE)).isin(*K.SUPPORTED_LANGUAGES)


def route_language(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Adds ``language_code`` (missing means automatic) and ``analysis_route``: ``detect`` or ``translate``."""
    code = F.coalesce(F.col(lang), F.lit(K.DEFAULT_LANGUAGE))
    return df.withColumns(
        {
            "language_code": code,
            "analysis_route": F.when(is_supported_language(F.col(lang)), "detect").otherwise("translate"),
        }
    )


def drop_stale(
    df: DataFrame, change_time: str, max_age: str = K.CHANGE_MAX_AGE, now: Column | None = None
) -> DataFrame:
    """Change records older than ``max_age`` on arrival are discarded."""
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(change_time) >= now - F.expr(f"INTERVAL {max_age}"))


# --- whole routes -----------------------------------------------------------------------------


def new_posts(events: DataFrame, domains: Sequence[str] = K.DENIED_CONTEXT_DOMAINS, mode: str = "none"):
    """Bus events the state writer and the fan-out listen to."""
    posts = rule_exists(route(events, K.DETAIL_POST))
    return deny_domain(posts, domains, mode, "data.context_annotations")


def included_posts(events: DataFrame, domains: Sequence[str] = K.DENIED_CONTEXT_DOMAINS, mode: str = "none"):
    """Bus events the metric updater listens to."""
    posts = created_prefix(route(events, K.DETAIL_INCLUDED), created_at="data.created_at")
    return deny_domain(posts, domains, mode, "data.context_annotations")


def archivable(events: DataFrame) -> DataFrame:
    """Bus events the archive takes."""
    return exclude_replayed(route(events, K.DETAIL_POST))
