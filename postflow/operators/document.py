"""State rows to analytics documents, and their upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow import schemas
from postflow.functions import flatten as X
from postflow.functions.keys import month_key, permalink, to_time, year_key
from postflow.operators.state import merge_partial


def to_document(state: DataFrame) -> DataFrame:
    """One ``select`` of native expressions."""
    references = X.flat_refs(F.col("referenced_tweets"))
    types = F.transform("referenced_tweets", lambda r: r["type"])
    created = to_time(F.col("created_at"))
    computed = {
        "normalized_text": F.coalesce("normalized_text", F.col("comprehend.normalized_text")),
        "url": permalink(F.col("id")),
        "created_at": created,
        "created_at_year": year_key(F.col("created_at")),
        "public_metrics": X.zero_if_retweet(F.col("public_metrics"), types),
        "context_annotations": X.flat_context(F.col("context_annotations")),
        "entities": X.flat_entities(F.col("entities")),
        "referenced_tweets": references,
        "geo": X.flat_geo(F.col("geo")),
        "comprehend": X.flat_analysis(F.col("comprehend")),
        "month": month_key(created),
    }
    return state.select(*[computed.get(name, F.col(name)).alias(name) for name in schemas.DOCUMENT.names])


def upsert_documents(gold: DataFrame, docs: DataFrame, version: str = "version") -> DataFrame:
    """Partial upsert by ``(month, id)``: absent fields keep the stored value.

    ``docs`` may hold several versions of a post, ordered by ``version`` (any number above zero); one shuffle
    merges them with the stored rows, which count as version zero.
    """
    stored = gold.withColumn(version, F.lit(0).cast(docs.schema[version].dataType))
    rows = stored.unionByName(docs).withColumn("_key", F.struct("month", "id")).drop("month", "id")
    merged = merge_partial(rows, "_key", version).drop(version)
    return merged.select("_key.*", *[c for c in gold.columns if c not in ("month", "id")]).select(
        *gold.columns
    )
