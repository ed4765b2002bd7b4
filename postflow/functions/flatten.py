"""Nested post fields to the flat, multi-valued fields of a document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postflow import constants as K
from postflow.functions.text import utf16_length


def dedupe_array(values: Column) -> Column:
    """Distinct values in first-seen order."""
    return F.array_distinct(values)


def flat_context(annotations: Column) -> Column:
    return F.when(
        annotations.isNotNull(),
        F.struct(
            F.array_distinct(F.transform(annotations, lambda a: a["domain"]["name"])).alias("domain"),
            F.array_distinct(F.transform(annotations, lambda a: a["entity"]["name"])).alias("entity"),
        ),
    )


def display_domains(urls: Column) -> Column:
    """Distinct hosts; an empty array where there are no urls at all."""
    hosts = F.transform(urls, lambda u: F.substring_index(u["display_url"], "/", 1))
    return F.coalesce(
        F.array_distinct(F.filter(hosts, lambda h: h.isNotNull())), F.array().cast("array<string>")
    )


def flat_urls(urls: Column) -> Column:
    def present(field: str) -> Column:
        return F.filter(F.transform(urls, lambda u: u[field]), lambda v: v.isNotNull())

    return F.struct(
        display_domains(urls).alias("display_domain"),
        F.transform(urls, lambda u: u["display_url"]).alias("display_url"),
        F.transform(urls, lambda u: u["expanded_url"]).alias("expanded_url"),
        present("title").alias("title"),
        present("description").alias("description"),
    )


def flat_entities(entities: Column) -> Column:
    """Lower-cased, repeated values kept."""

    def lowered(group: str, field: str) -> Column:
        return F.transform(entities[group], lambda e: F.lower(e[field]))

    return F.when(
        entities.isNotNull(),
        F.struct(
            lowered("annotations", "normalized_text").alias("annotation"),
            lowered("cashtags", "tag").alias("cashtag"),
            lowered("hashtags", "tag").alias("hashtag"),
            lowered("mentions", "username").alias("mention"),
            flat_urls(entities["urls"]).alias("url"),
        ),
    )


def flat_geo(geo: Column) -> Column:
    point = geo["coordinates"]
    return F.when(
        point.isNotNull() | geo["place_id"].isNotNull(),
        F.struct(
            F.struct(point["type"].alias("type"), point["coordinates"].alias("coordinates")).alias(
                "coordinates"
            ),
            geo["place_id"].alias("place_id"),
        ),
    )


def flat_refs(references: Column) -> Column:
    """Parallel arrays of kind and id."""
    return F.when(
        references.isNotNull(),
        F.struct(
            F.transform(references, lambda r: r["type"]).alias("type"),
            F.transform(references, lambda r: r["id"]).alias("id"),
        ),
    )


def clean_entities(entities: Column, threshold: float = K.ENTITY_SCORE_THRESHOLD) -> Column:
    """Detected entities worth a facet. A missing type or score does not drop an entity, a missing text does."""

    def keep(e: Column) -> Column:
        dropped_type = F.coalesce(e["type"].isin(*K.DROPPED_ENTITY_TYPES), F.lit(False))
        low_score = F.coalesce(e["score"] < threshold, F.lit(False))
        good_text = (utf16_length(e["text"]) >= 2) & ~e["text"].startswith("@")
        return ~dropped_type & ~low_score & F.coalesce(good_text, F.lit(False))

    return F.array_distinct(F.transform(F.filter(entities, keep), lambda e: F.lower(e["text"])))


def flat_analysis(analysis: Column, threshold: float = K.ENTITY_SCORE_THRESHOLD) -> Column:
    score = analysis["sentiment_score"]
    return F.when(
        analysis.isNotNull(),
        F.struct(
            clean_entities(analysis["entities"], threshold).alias("entities"),
            analysis["sentiment"].alias("sentiment"),
            F.struct(*[score[n].alias(n) for n in ("positive", "negative", "neutral", "mixed")]).alias(
                "sentiment_score"
            ),
        ),
    )


def zero_if_retweet(metrics: Column, reference_types: Column) -> Column:
    """A retweet carries the counters of the original; counting them again would double them."""
    names = ("retweet_count", "reply_count", "like_count", "quote_count")
    zero = F.struct(*[F.lit(0).cast("bigint").alias(n) for n in names])
    is_retweet = F.coalesce(F.array_contains(reference_types, "retweeted"), F.lit(False))
    return F.when(is_retweet, zero).otherwise(metrics)
