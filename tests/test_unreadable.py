import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import envelope, envelopes, ids, post
from postflow.operators.analysis import LexiconScorer
from postflow.operators.state import last_row, latest_by_version
from postflow.plans.jobs import IngestConfig, Warehouse, ingest, reindex_archive
from postflow.sources import envelopes as E


def lines(*objects):
    return "".join((o if isinstance(o, str) else json.dumps(o)) + "\n" for o in objects).encode()


def many(n, start=0):
    return [envelope(post(str(i), f"text {i * 7919}")) for i in range(start, start + n)]


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "archive"
    path.mkdir()
    (path / "good.json.gz").write_bytes(gzip.compress(lines(*many(50))))
    whole = gzip.compress(lines(*many(3000, 1000)))
    (path / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    (path / "tail.json.gz").write_bytes(gzip.compress(lines(*many(2, 100)))[:-4])
    damaged = bytearray(gzip.compress(lines(*many(2000, 9000))))
    damaged[len(damaged) // 2] ^= 0xFF
    (path / "damaged.json.gz").write_bytes(bytes(damaged))
    (path / "two-members.json.gz").write_bytes(gzip.compress(lines(*many(2, 200))) + gzip.compress(lines(*many(3, 300))))
    (path / "plain.json").write_bytes(lines('{"data": {"id": "bad"', "", {"data": {"text": "no id"}}, "not json", *many(1, 400)))
    return str(path)


def test_audit_names_broken_files(spark, archive):
    found = {os.path.basename(r.place): (r.lines, r.error and r.error.split(":")[0]) for r in E.audit_files(spark, archive).collect()}
    assert found["good.json.gz"] == (50, None) and found["two-members.json.gz"] == (5, None)
    assert found["cut.json.gz"][1] == "truncated" and 0 < found["cut.json.gz"][0] < 3000
    assert found["tail.json.gz"] == (2, "truncated") and found["damaged.json.gz"][1] == "damaged"
    assert "plain.json" not in found


def test_error_table(spark, archive):
    rows = E.unreadable(spark, archive).collect()
    assert sorted(os.path.basename(r.place) for r in rows if r.reason == "file") == ["cut.json.gz", "damaged.json.gz", "tail.json.gz"]
    plain = sorted((r.reason, r.record) for r in rows if r.place.endswith("plain.json"))
    assert [r[0] for r in plain] == ["malformed", "malformed", "no-id"]
    assert {r[1] for r in plain[:2]} == {'{"data": {"id": "bad"', "not json"} and json.loads(plain[2][1])["data"]["text"] == "no id"


def test_reindex_logs_what_it_cannot_read(spark, archive, tmp_path):
    house = Warehouse(str(tmp_path / "house"), buckets=2)
    reindex_archive(spark, archive, house, LexiconScorer((), ()), "r.0")
    assert house.unreadable.read(spark).count() >= 6
    assert {"bad", "400"} & set(ids(house.gold.read(spark))) == {"400"}


def test_ingest_sets_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    reported = envelope(post("2"), errors=[{"title": "gone", "detail": "d", "type": "t"}])
    (tmp_path / "in" / "a.json").write_bytes(lines("{", {"data": {}}, "{", envelope(post("1")), reported))
    house = Warehouse(str(tmp_path / "house"), buckets=2)
    stream = E.read_envelopes(spark, str(tmp_path / "in"), streaming=True, arrival=True, corrupt=True)
    query = ingest(stream, IngestConfig(house, LexiconScorer((), ())), str(tmp_path / "cp"))
    query.awaitTermination()
    assert query.exception() is None
    assert sorted(r.reason for r in house.unreadable.read(spark).collect()) == ["malformed", "malformed", "no-id"]
    assert [(r.id, r.title) for r in house.stream_errors.read(spark).collect()] == [("2", "gone")]
    assert ids(house.gold.read(spark)) == ["1", "2"]


@pytest.mark.parametrize("streaming", [False, True])
def test_files_are_ordered_by_time(spark, tmp_path, streaming):
    """The newer row lies in a file that is read first: files are packed by size, the largest first."""
    path = tmp_path / "in"
    path.mkdir()
    (path / "z-old.json").write_bytes(lines(envelope(post("a", "old")), envelope(post("b", "old 1")), envelope(post("b", "old 2"))))
    (path / "a-new.json").write_bytes(lines(*many(500, 1000), envelope(post("a", "new 1")), envelope(post("a", "new 2"))))
    os.utime(path / "z-old.json", (1_000_000, 1_000_000))
    os.utime(path / "a-new.json", (2_000_000, 2_000_000))
    rows = E.read_envelopes(spark, str(path), streaming=streaming, arrival=True)
    if streaming:
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        rows = spark.read.schema(rows.schema).parquet(str(tmp_path / "out"))
    rows = rows.repartition(7)
    last = last_row(rows.select(F.col("data.id").alias("id"), "data.text", "arrival"))
    assert {r.id: r.text for r in last.where("id IN ('a', 'b')").collect()} == {"a": "new 2", "b": "old 2"}
    best = latest_by_version(rows.select(F.col("data.id").alias("id"), "data.text", F.lit(1).alias("updated_at"), "arrival"))
    assert {r.id: r.text for r in best.where("id IN ('a', 'b')").collect()} == {"a": "old", "b": "old 1"}


def test_topic_records_are_ordered_by_offset(spark):
    body = json.dumps(envelope(post("1", "x")))
    raw = spark.createDataFrame(
        [("t", 1, 9, body), ("t", 1, 10, body), ("t", 0, 11, "broken")], "topic STRING, partition INT, offset BIGINT, value STRING"
    ).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    placed = E.with_offsets(raw)
    good = E.decode_bodies(placed, "value").orderBy("arrival").select("arrival.position").collect()
    assert [r.position for r in good] == [9, 10]
    assert [r.offset for r in E.bad_bodies(placed, "value").collect()] == [11]


def test_rows_without_an_order_get_that_of_the_read(spark):
    rows = E.stamp_arrival(envelopes(spark, *many(3)))
    assert rows.schema["arrival"].dataType.simpleString() == E.ARRIVAL.simpleString()
    assert E.stamp_arrival(rows).schema == rows.schema
