"""Times, partition keys, links and the JSON form of analysis results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postflow import constants as K
from postflow import schemas


def to_time(created_at: Column) -> Column:
    """ISO-8601 text to a timestamp; null where it does not parse."""
    return F.try_to_timestamp(created_at)


def epoch_seconds(time: Column, now: Column | None = None) -> Column:
    """Whole seconds, rounded down; a missing time counts as ``now``."""
    return F.unix_seconds(F.coalesce(time, F.current_timestamp() if now is None else now))


def expire_at(now: Column, days: int = K.CACHE_DAYS) -> Column:
    return now + F.make_interval(days=F.lit(days))


def seconds_part(created_at: Column) -> Column:
    """The time up to the first ``.``: fractions play no part in archive partitions."""
    return F.try_to_timestamp(
        F.regexp_extract(created_at, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\..*)?$", 1)
    )


def day_parts(created_at: Column) -> dict[str, Column]:
    """``year``, ``month`` and ``day`` of the archive, zero-padded text in UTC."""
    time = seconds_part(created_at)
    return {
        "year": F.date_format(time, "yyyy"),
        "month": F.date_format(time, "MM"),
        "day": F.date_format(time, "dd"),
    }


def month_key(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM")


def index_name(month: Column) -> Column:
    return F.concat(F.lit(K.INDEX_PREFIX), month)


def year_key(created_at: Column) -> Column:
    return F.substring_index(created_at, "-", 1)


def permalink(post_id: Column) -> Column:
    return F.concat(F.lit(K.PERMALINK_PREFIX), post_id)


def repair_key(key: Column) -> Column:
    """Object keys arrive with ``=`` percent-encoded."""
    return F.replace(key, F.lit("%3D"), F.lit("="))


def file_identity(path: Column) -> Column:
    """Base name without ``.txt``."""
    return F.replace(F.substring_index(path, "/", -1), F.lit(".txt"), F.lit(""))


def to_wire(result: Column) -> Column:
    """Silver analysis struct to the struct whose JSON other services read."""
    score = result["sentiment_score"]
    return F.when(
        result.isNotNull(),
        F.struct(
            result["normalized_text"].alias("NormalizedText"),
            F.transform(
                result["entities"],
                lambda e: F.struct(
                    e["text"].alias("Text"), e["type"].alias("Type"), e["score"].alias("Score")
                ),
            ).alias("Entities"),
            result["sentiment"].alias("Sentiment"),
            F.when(
                score.isNotNull(),
                F.struct(
                    score["positive"].alias("Positive"),
                    score["negative"].alias("Negative"),
                    score["neutral"].alias("Neutral"),
                    score["mixed"].alias("Mixed"),
                ),
            ).alias("SentimentScore"),
        ),
    )


def from_wire(wire: Column) -> Column:
    """Inverse of :func:`to_wire`."""
    score = wire["SentimentScore"]
    return F.when(
        wire.isNotNull(),
        F.struct(
            wire["NormalizedText"].alias("normalized_text"),
            wire["Sentiment"].alias("sentiment"),
            F.when(
                score.isNotNull(),
                F.struct(
                    score["Positive"].alias("positive"),
                    score["Negative"].alias("negative"),
                    score["Neutral"].alias("neutral"),
                    score["Mixed"].alias("mixed"),
                ),
            ).alias("sentiment_score"),
            F.transform(
                wire["Entities"],
                lambda e: F.struct(
                    e["Text"].alias("text"), e["Type"].alias("type"), e["Score"].alias("score")
                ),
            ).alias("entities"),
        ),
    )


def encode_result(result: Column) -> Column:
    """Base64 of the JSON form (needs ``chunkBase64String`` off, see ``session``)."""
    return F.base64(F.encode(F.to_json(to_wire(result)), "UTF-8"))


def decode_result(value: Column) -> Column:
    return from_wire(F.from_json(F.decode(F.unbase64(value), "UTF-8"), schemas.ANALYSIS_WIRE))
