"""Keyed tables on plain Parquet: a batch rewrites only the partitions it touches, readers never see half a batch.

Each write goes to a directory of its own, ``v=<number>.<tag>``, which counts once Spark's ``_SUCCESS`` marker is
there; the current content of a partition is the newest committed directory that has it. Where a catalog with
row-level ``MERGE`` is available, ``DataFrame.mergeInto`` on it replaces this module.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_BUCKETS = 256


def id_bucket(key: Column, buckets: int = STATE_BUCKETS) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"), 4, "0")


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path, fs = _fs(spark, pattern)
    return [str(status.getPath()) for status in (fs.globStatus(path) or [])]


@dataclass(frozen=True)
class KeyedTable:
    """A table at ``root`` with a partition column that is a function of the row's key; files are sorted by ``order``."""

    root: str
    schema: T.StructType
    partition: str
    order: tuple[str, ...] = ()

    def _committed(self, spark: SparkSession) -> dict[str, int]:
        """Directory name to version number."""
        names = [p.split("/")[-2] for p in _glob(spark, f"{self.root}/v=*/_SUCCESS")]
        return {name: int(name[2:].split(".")[0]) for name in names}

    def versions(self, spark: SparkSession) -> dict[str, int]:
        """The version that each batch was committed as."""
        return {name.split(".", 1)[1]: version for name, version in self._committed(spark).items()}

    def version_of(self, spark: SparkSession, tag: str) -> int | None:
        """Version the batch ``tag`` was committed as, if it was."""
        return self.versions(spark).get(tag)

    def read(self, spark: SparkSession, before: str | None = None) -> DataFrame:
        """Current rows; with ``before`` the rows as they were when the batch of that tag had not been written.

        Only directories are listed here, at most versions times partitions of them.
        """
        committed = self._committed(spark)
        if before is not None:
            limit = self.version_of(spark, before)
            if limit is not None:
                committed = {n: v for n, v in committed.items() if v < limit}
        newest: dict[str, tuple[int, str]] = {}
        for path in _glob(spark, f"{self.root}/v=*/{self.partition}=*"):
            name, part = path.split("/")[-2:]
            if name in committed:
                newest[part] = max(newest.get(part, (-1, "")), (committed[name], path))
        if not newest:
            return spark.createDataFrame([], self.schema)
        paths = [path for _, path in newest.values()]
        rows = spark.read.schema(self.schema).option("basePath", self.root).parquet(*paths)
        return rows.select(*self.schema.names)

    def write(self, df: DataFrame, tag: str) -> None:
        """Commits the full new content of the partitions present in ``df``; a committed tag is left alone.

        The rebalance splits partitions that are too large for one task and joins small ones.
        """
        spark = df.sparkSession
        if self.version_of(spark, tag) is not None:
            return
        number = max(self._committed(spark).values(), default=0) + 1
        target = f"{self.root}/v={number:010d}.{tag}"
        rows = df.select(*self.schema.names).hint("rebalance", self.partition)
        if self.order:
            rows = rows.sortWithinPartitions(self.partition, *self.order)
        rows.write.mode("overwrite").partitionBy(self.partition).parquet(target)

    def touched(self, stored: DataFrame, changes: DataFrame) -> DataFrame:
        """Rows of ``stored`` in partitions that ``changes`` touches: other partitions are not read.

        The broadcast side holds distinct partition values, of which the table has a bounded number.
        """
        parts = changes.select(self.partition).distinct()
        return stored.join(F.broadcast(parts), self.partition, "left_semi")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> list[str]:
        """Deletes partition directories replaced before the last ``keep`` versions; returns their paths."""
        committed = self._committed(spark)
        versions = sorted(committed.values())
        if len(versions) <= keep:
            return []
        horizon = versions[-keep]
        by_part: dict[str, list[tuple[int, str]]] = {}
        for path in _glob(spark, f"{self.root}/v=*/{self.partition}=*"):
            name, part = path.split("/")[-2:]
            if name in committed:
                by_part.setdefault(part, []).append((committed[name], path))
        removed = []
        for entries in by_part.values():
            old = sorted(e for e in entries if e[0] <= horizon)[:-1]
            for _, path in old:
                hadoop_path, fs = _fs(spark, path)
                fs.delete(hadoop_path, True)
                removed.append(path)
        return removed


@dataclass(frozen=True)
class BatchLog:
    """Append-only table with one ``batch=<tag>`` directory per batch; rewriting a batch replaces it."""

    root: str
    schema: T.StructType

    def write(self, df: DataFrame, tag: str) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.root}/batch={tag}")

    def read_batch(self, spark: SparkSession, tag: str) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.root}/batch={tag}")

    def tags(self, spark: SparkSession) -> set[str]:
        """The batches whose directories are complete."""
        return {path.split("/")[-2].split("=", 1)[1] for path in _glob(spark, f"{self.root}/batch=*/_SUCCESS")}

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes and reads back: what follows does not recompute ``df``."""
        self.write(df, tag)
        return self.read_batch(df.sparkSession, tag)

    def read(self, spark: SparkSession, without: str | None = None) -> DataFrame:
        rows = self.read_tagged(spark)
        if without is not None:
            rows = rows.where(F.col("batch") != without)
        return rows.select(*self.schema.names)

    def read_tagged(self, spark: SparkSession) -> DataFrame:
        """All rows with the tag of their ``batch``."""
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType())])
        if not _glob(spark, f"{self.root}/batch=*/_SUCCESS"):
            return spark.createDataFrame([], full)
        return spark.read.schema(full).parquet(self.root)

    def replace(self, df: DataFrame, tag: str) -> None:
        """Compaction: ``df`` becomes the whole content. Run it while nothing else writes."""
        spark = df.sparkSession
        old = _glob(spark, f"{self.root}/batch=*")
        self.write(df, tag)
        for path in old:
            if not path.endswith(f"/batch={tag}"):
                hadoop_path, fs = _fs(spark, path)
                fs.delete(hadoop_path, True)
