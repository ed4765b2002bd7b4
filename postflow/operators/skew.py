"""Many-to-one lookups that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key that may meet in one task; a key with more is heavy. There are at most rows / ROWS_PER_SALT of these,
#: two million short rows for 10^12 rows.
ROWS_PER_SALT = 500_000


#: Rows of keys (or of a few short columns) that may be broadcast after they have been counted.
BROADCAST_ROWS = 200_000


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Counts within the tasks, so that one number of each moves."""
    return df.count() <= rows


def keep_matching(df: DataFrame, keys: DataFrame, key: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``keys``.

    Few keys (they are counted) go to every task, so that a large table is filtered where it is read instead of
    being shuffled; many keys meet the table in an ordinary join.
    """
    wanted = keys.select(key)
    return df.join(F.broadcast(wanted) if has_at_most(wanted, rows) else wanted, key, "left_semi")


def small_lookup(
    left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int = BROADCAST_ROWS, **options
) -> DataFrame:
    """:func:`lookup_join` for lists that are mostly short: those (they are counted) need no shuffle of ``left``."""
    if has_at_most(right, rows):
        return left.join(F.broadcast(right), key, how)
    return lookup_join(left, right, key, how, **options)


def heavy_keys(df: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(key, salts)`` of every key with more than ``rows_per_salt`` rows: at most one for each that many rows.

    Counting combines before its shuffle and reads only the key.
    """
    # count(key) is zero for the null key; a filter on the key would evaluate it twice
    counts = df.groupBy(key).agg(F.count(F.col(key)).alias("_rows"))
    return heavy_of(counts, key, "_rows", rows_per_salt)


def heavy_of(counts: DataFrame, key: str, rows: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The same from known counts per key."""
    heavy = counts.where(F.col(rows) > rows_per_salt)
    return heavy.select(key, F.ceil(F.col(rows) / rows_per_salt).cast("int").alias("_salts"))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    heavy: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    spread: list[Column] | None = None,
) -> DataFrame:
    """``left`` joined to ``right`` (at most one row per ``key``) for ``left``, ``inner``, ``left_semi``, ``left_anti``.

    Rows of heavy keys are spread over salts by a hash of the row (``spread``); the matching right row is
    repeated once per salt. The repeats add at most ``2 * rows / rows_per_salt`` rows in all.
    Whether the right side is small enough to broadcast is left to Spark's own size check.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"not a lookup: {how}")
    if heavy is None:
        heavy = heavy_keys(left, key, rows_per_salt)
    bounded = F.broadcast(heavy)  # at most rows / rows_per_salt short rows
    row_hash = F.xxhash64(*(spread or [left[c] for c in left.columns]))
    # null keys match nothing: spread them all over instead of sending them to one task
    salt = F.when(F.col(key).isNull(), F.pmod("_row_hash", F.lit(1 << 20))).otherwise(
        F.coalesce(F.pmod("_row_hash", F.col("_salts").cast("bigint")), F.lit(0))
    )
    salted_left = (
        left.withColumn("_row_hash", row_hash)
        .join(bounded, key, "left")
        .withColumn("_salt", salt.cast("int"))
        .drop("_salts", "_row_hash")
    )
    salted_right = (
        right.join(bounded, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
