"""Envelope sources: stream, archive, queue bodies, legacy id files, replay."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow import constants as K
from postflow import schemas
from postflow.functions.keys import seconds_part, to_time


#: Where a record stands in its source: the time its file (or the record) was written, the file (or topic partition), the
#: block's start in the file (or the offset), and the line. Compared field by field this is the order of arrival.
ARRIVAL = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("place", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("line", T.LongType()),
    ]
)
#: The text of a line that is no JSON object of the read schema.
CORRUPT = "_corrupt_record"


def _arrival(time: Column, place: Column, position: Column, line: Column) -> Column:
    return F.struct(*[c.cast(f.dataType).alias(f.name) for f, c in zip(ARRIVAL.fields, (time, place, position, line))])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        yield batch.append_column("_line", pa.array(range(n, n + batch.num_rows), pa.int64()))
        n += batch.num_rows


def _with_file_arrival(rows: DataFrame) -> DataFrame:
    """Rows just read from files with their order. Rows of one block are read by one task in their order, so the number
    that a task counts up is the line's order within the block; tasks start in any order, and that does not count.
    Streams have no such number of their own and count on Arrow batches."""
    names = rows.columns
    about = F.col("_metadata")
    placed = rows.select(
        *names, about["file_modification_time"].alias("_time"), about["file_path"].alias("_place"), about["file_block_start"].alias("_position")
    )
    if rows.isStreaming:
        placed = placed.mapInArrow(_numbered, T.StructType([*placed.schema.fields, T.StructField("_line", T.LongType())]))
    else:
        placed = placed.withColumn("_line", F.monotonically_increasing_id())
    return placed.select(*names, _arrival(*[F.col(c) for c in ("_time", "_place", "_position", "_line")]).alias("arrival"))


def _reader(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def read_envelopes(
    spark: SparkSession,
    path: str | Sequence[str],
    streaming: bool = False,
    max_files_per_trigger: int | None = None,
    clean_source: str | None = None,
    archive_dir: str | None = None,
    max_bytes_per_trigger: int | None = None,
    arrival: bool = False,
    corrupt: bool = False,
) -> DataFrame:
    """JSON-lines envelopes, plain or gzip, as a table or as a stream.

    ``clean_source`` (``delete`` or ``archive``) consumes input files once a later batch has committed; the number and the
    bytes of the files of a micro-batch can be bounded. ``arrival`` adds the order of the rows in their source
    (:data:`ARRIVAL`), ``corrupt`` the text of lines that cannot be read (:data:`CORRUPT`): see :func:`split_readable`.
    A file that breaks off ends where it breaks off: see :func:`audit_files`.
    """
    fields = [*schemas.ENVELOPE.fields, *([T.StructField(CORRUPT, T.StringType())] if corrupt else [])]
    reader = _reader(spark, streaming).schema(T.StructType(fields)).option("ignoreCorruptFiles", "true")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    if streaming:
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        if max_bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
        if clean_source:
            reader = reader.option("cleanSource", clean_source)
        if archive_dir:
            reader = reader.option("sourceArchiveDir", archive_dir)
        if not isinstance(path, str):
            raise ValueError("a stream reads one path; use union_sources for several")
    rows = reader.json(path if isinstance(path, str) else list(path))
    return _with_file_arrival(rows) if arrival else rows


def split_readable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes with a post id, and all other lines of the same read as rows of an error table.

    ``rows`` come from :func:`read_envelopes` with ``arrival`` and ``corrupt``. An error has the file (``place``), where
    in it, the ``reason`` (``malformed`` or ``no-id``) and the ``record``: the line as it was, or what was read of it.
    Together the two have every line that is not blank.
    """
    malformed = F.col(CORRUPT).isNotNull()
    good = F.col("data.id").isNotNull() & ~malformed
    envelope = [F.col(c) for c in schemas.ENVELOPE.names]
    record = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*envelope)))
    bad = rows.where(~good).select(
        "arrival.place", "arrival.position", "arrival.line", F.when(malformed, "malformed").otherwise("no-id").alias("reason"), record.alias("record")
    )
    return rows.where(good).drop(CORRUPT), bad


def _gzip_error(data: bytes) -> tuple[int, str | None]:
    """Lines of a gzip file, as far as it can be read, and what is wrong with it."""
    lines, last, rest = 0, b"\n", data
    try:
        while rest:
            part = zlib.decompressobj(wbits=31)
            while True:
                text = part.decompress(rest, 1 << 20)
                lines += text.count(b"\n")
                last = text[-1:] or last
                rest = part.unconsumed_tail
                if part.eof or not (rest or text):
                    break
            if not part.eof:
                return lines + (last != b"\n"), "truncated"
            rest = part.unused_data
    except zlib.error as error:
        return lines + (last != b"\n"), f"damaged: {error}"
    return lines + (last != b"\n"), None


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        checked = [_gzip_error(content.as_buffer()) for content in batch.column("content")]
        lines, errors = [c[0] for c in checked], [c[1] for c in checked]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("bytes"), pa.array(lines, pa.int64()), pa.array(errors, pa.string())], ["place", "bytes", "lines", "error"]
        )


def audit_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per gzip file: ``place``, ``bytes``, ``lines`` as far as it can be read, and ``error``, null if it is whole.

    A reader that has to go on at a broken file cannot say that it lost the rest of it, so the files are read once more,
    each by one task, a megabyte of text at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
    rows = files.load(path if isinstance(path, str) else list(path))
    # the path as the reader of lines names it
    rows = rows.select(F.col("_metadata.file_path").alias("place"), F.col("length").alias("bytes"), "content")
    return rows.mapInArrow(_audited, "place STRING, bytes BIGINT, lines BIGINT, error STRING")


def unreadable(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The error table of archived envelopes: lines that are no envelope, and files that break off."""
    _, lines = split_readable(read_envelopes(spark, path, arrival=True, corrupt=True))
    files = audit_files(spark, path).where(F.col("error").isNotNull())
    none = F.lit(None)
    broken = files.select(
        "place", none.cast("bigint").alias("position"), F.col("lines").alias("line"), F.lit("file").alias("reason"), F.col("error").alias("record")
    )
    return lines.unionByName(broken)


def read_topic(spark: SparkSession, options: Mapping[str, str], streaming: bool = True) -> DataFrame:
    """Envelopes from a Kafka topic (needs the Kafka connector on the class path); starts at the latest record."""
    defaults = {"startingOffsets": "latest"} if streaming else {}
    raw = _reader(spark, streaming).format("kafka").options(**{**defaults, **options}).load()
    return decode_bodies(with_offsets(raw), "value")


def with_offsets(raw: DataFrame) -> DataFrame:
    """Topic records with the order of their ``arrival``: record time, partition, offset."""
    place = F.concat_ws("/", "topic", F.lpad(F.col("partition").cast("string"), 10, "0"))
    return raw.withColumn("arrival", _arrival(F.col("timestamp"), place, F.col("offset"), F.lit(0)))


def decode_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """Queue bodies (JSON text) to envelope columns, with their ``arrival`` if they have one; see :func:`bad_bodies`."""
    rest = [c for c in ("arrival",) if c in df.columns]
    parsed = F.from_json(F.col(body).cast("string"), schemas.ENVELOPE).alias("e")
    return df.select(parsed, *rest).where(F.col("e.data.id").isNotNull()).select("e.*", *rest)


def bad_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """The bodies that :func:`decode_bodies` leaves out, as they were, with all columns beside them."""
    parsed = F.from_json(F.col(body).cast("string"), schemas.ENVELOPE)
    return df.where(parsed["data"]["id"].isNull())


def decode_payload(df: DataFrame, col: str = "data") -> DataFrame:
    """Base64-wrapped records to envelope columns."""
    text = F.decode(F.unbase64(F.col(col)), "UTF-8")
    return decode_bodies(df.select(text.alias("body")))


def encode_payload(df: DataFrame) -> DataFrame:
    """Envelopes as Base64 records, with the post id as key."""
    body = F.to_json(F.struct(*[df[c] for c in df.columns]))
    return df.select(F.col("data.id").alias("key"), F.base64(F.encode(body, "UTF-8")).alias("data"))


def stream_errors(envelopes: DataFrame) -> DataFrame:
    """Side output: the errors the stream reported, one per row."""
    return envelopes.select(F.col("data.id").alias("id"), F.inline("errors"))


def union_sources(sources: Sequence[DataFrame | None]) -> DataFrame:
    """All enabled readers as one; a reader without credentials is passed as ``None``."""
    enabled = [s for s in sources if s is not None]
    if not enabled:
        raise ValueError("no source is enabled")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), enabled)


def to_bus_events(
    envelopes: DataFrame, detail_type: str = K.DETAIL_POST, source: str = K.BUS_SOURCE
) -> DataFrame:
    """Adds the bus attributes; the event time is the post's own time, null where that is absent or malformed."""
    replay = F.col("replay_name") if "replay_name" in envelopes.columns else F.lit(None).cast("string")
    rest = [envelopes[c] for c in envelopes.columns if c != "replay_name"]
    return envelopes.select(
        F.lit(source).alias("source"),
        F.lit(detail_type).alias("detail_type"),
        to_time(F.col("data.created_at")).alias("event_time"),
        replay.alias("replay_name"),
        *rest,
    )


def read_archive(spark: SparkSession, path: str | Sequence[str], streaming: bool = False, **options) -> DataFrame:
    """Archived envelopes of any number of paths; what cannot be read yields no rows: see :func:`unreadable`."""
    return _readable(read_envelopes(spark, path, streaming, corrupt=True, **options))


def _readable(rows: DataFrame) -> DataFrame:
    """Envelopes with a post id. Of a line that breaks off Spark reads the beginning, which is no envelope."""
    return rows.where(F.col("data.id").isNotNull() & F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_archive_days(spark: SparkSession, root: str, start: str, end: str) -> DataFrame:
    """The archive of ``start`` to ``end`` (days, both included); only their partitions are listed and read."""
    partitions = [T.StructField(n, T.StringType()) for n in ("year", "month", "day")]
    schema = T.StructType([*schemas.ENVELOPE.fields, T.StructField(CORRUPT, T.StringType()), *partitions])
    day = F.concat_ws("-", "year", "month", "day")
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("columnNameOfCorruptRecord", CORRUPT)
    return _readable(reader.json(root).where(day.between(start, end)))


def read_legacy_ids(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Ids of posts in the old format; no other field is parsed."""
    rows = spark.read.schema("id_str STRING").option("ignoreCorruptFiles", "true").json(path)
    return rows.where(F.col("id_str").isNotNull())


def replay(bronze: DataFrame, start: Column | str, end: Column | str, name: str) -> DataFrame:
    """Archived events of a time range, marked so that the archive does not take them again.

    The range applies to the post's own time; with ``year``/``month``/``day`` columns present, days outside
    of it are pruned before any file is opened.
    """
    start, end = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    time = seconds_part(F.col("data.created_at"))
    rows = bronze.where((time >= start) & (time < end))
    if {"year", "month", "day"} <= set(bronze.columns):
        day = F.concat_ws("-", "year", "month", "day")
        rows = rows.where(day.between(F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd")))
        rows = rows.drop("year", "month", "day")
    return to_bus_events(rows.withColumn("replay_name", F.lit(name)))


def stamp_arrival(df: DataFrame) -> DataFrame:
    """``df`` with its ``arrival``. Rows that come without the order of their source get that of this read."""
    if "arrival" in df.columns:
        return df
    none = F.lit(None)
    return df.withColumn("arrival", _arrival(none, none, none, F.monotonically_increasing_id()))
