"""When the posts of the state table were created: a narrow table of ``(created_at, id, bucket)``, clustered by time.

The state table lies in buckets of ids, so a range of time could be in any of them. The listing is appended by the batches
that bring new posts or new times, each part sorted by time, so that a range of time reads few of its files and row groups.
It says which buckets hold posts of a range, and answers pages over time without the wide rows of the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow.functions.keys import to_time
from postflow.operators import state as S
from postflow.sinks.tables import BatchLog, KeyedTable

LISTING = T.StructType([T.StructField(n, T.StringType()) for n in ("created_at", "id", "bucket")])

#: Tag of a listing made of the whole state table as of a version.
_WHOLE = "whole."


def listing_rows(state: DataFrame) -> DataFrame:
    """The listing of state rows, clustered by time; rows without a usable time are in no range and left out."""
    rows = state.where(to_time(F.col("created_at")).isNotNull()).select(*LISTING.names)
    return rows.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id")


def rebuild(spark: SparkSession, listing: BatchLog, table: KeyedTable) -> None:
    """The listing anew from the state table: for tables older than their listing, and as its compaction.

    Run it while nothing else writes.
    """
    version = max(table.versions(spark).values(), default=0)
    listing.replace(listing_rows(table.read(spark)), f"{_WHOLE}{version}")


def is_complete(spark: SparkSession, listing: BatchLog, table: KeyedTable) -> bool:
    """Whether every batch of the state table has left its part of the listing. Only tags are compared."""
    tags = listing.tags(spark)
    whole = max((int(tag[len(_WHOLE) :]) for tag in tags if tag.startswith(_WHOLE)), default=0)
    return all(version <= whole or tag in tags for tag, version in table.versions(spark).items())


def in_listed_buckets(state: DataFrame, listing: DataFrame, start: str, end: str) -> DataFrame:
    """State rows created from ``start`` to before ``end``; buckets without any are not read.

    What is broadcast are bucket names, of which the table has a bounded number. They prune the partitions of the scan,
    and the range prunes row groups, in which rows lie by time. A row whose time has changed is listed under both times;
    the range is applied to the rows themselves, so that only costs a bucket.
    """
    created = F.col("created_at")
    in_range = (created >= start) & (created < end)
    buckets = listing.where(in_range).select("bucket").distinct()
    return state.where(in_range & to_time(created).isNotNull()).join(F.broadcast(buckets), "bucket", "left_semi")


def listed_page(listing: DataFrame, after: tuple[str, str] | None = None, n: int = K.PAGE_SIZE) -> DataFrame:
    """A page of ``(created_at, id)`` over time from the listing alone; an id listed twice at one time comes once."""
    if after is not None:  # a range of one column reaches the files
        listing = listing.where(F.col("created_at") >= after[0])
    return S.next_page(listing.select("created_at", "id").distinct(), after, n)
