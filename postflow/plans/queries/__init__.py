"""Registered queries, each next to the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postflow.plans.queries import enrich, events, index, state, streams
from postflow.plans.queries.registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["enrich", "events", "index", "oracle_sql", "queries", "state", "streams"]
