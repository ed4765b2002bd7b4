"""What the corpus operators share: the word rule, tables written to the shared folder, size-checked broadcasts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow.session import configure, new_shared_path

#: The characters between words: space, and tab to carriage return.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A run of them, as a Java or RE2 pattern.
SPACES = r"[\x20\x09-\x0D]+"

#: Most rows of a table that may be sent whole to every executor. A row of the tables checked against it is a few
#: numbers and two short names, so this bounds a broadcast at some 10 MB.
BROADCAST_ROWS = 50_000


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array where there are none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.octet_length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def exact_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` with its ids as decimal text: beside a null, pandas makes doubles of a column of longs."""
    return df.withColumn(name, F.col(name).cast("string"))


def longs(values: list) -> pd.api.extensions.ExtensionArray:
    """A pandas column of longs with nulls, not by way of doubles."""
    return pd.array([None if v is None else int(v) for v in values], dtype="Int64")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the columns that are not ``used`` under names that no operator has, and these columns by their
    names in ``docs``."""
    names = {c: c if c in used else f"_in{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return moved, {c: F.col(n).alias(c) for c, n in names.items()}


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: it is computed once, and a lost executor loses nothing of it."""
    path = new_shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most :data:`BROADCAST_ROWS` rows; beyond that Spark shuffles.

    ``df`` should be a written table: counting it then reads no column.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def bound_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bounds what a Python task holds of its input at once, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
