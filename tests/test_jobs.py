import json

import pytest
from pyspark.sql import functions as F

from helpers import by_id, envelope, envelopes, from_json, ids, metrics, post, posts
from postflow import schemas
from postflow.operators.analysis import LexiconScorer
from postflow.operators.filters import drop_stale
from postflow.plans.jobs import IngestConfig, Warehouse, backfill, ingest, ingest_batch, reindex_archive, reindex_year, reingest, reingest_files, reingest_legacy_files, reingest_legacy_stream
from postflow.sinks.tables import BatchLog, KeyedTable
from postflow.sources.envelopes import read_archive, read_envelopes, to_bus_events
from postflow.streaming import operators as O

SCORER = LexiconScorer(("good",), ("bad",))


@pytest.fixture
def house(tmp_path):
    return Warehouse(str(tmp_path / "house"), buckets=4)


def config(house):
    return IngestConfig(house, SCORER, now=F.lit("2022-06-01").cast("timestamp"))


def run(spark, house, tag, *objects):
    ingest_batch(to_bus_events(envelopes(spark, *objects)), tag, config(house))


def at(second):
    return f"2022-05-01T00:00:{second:02}.000Z"


def summary(spark, house):
    rows = house.state.read(spark).collect()
    return {r["id"]: (r["updated_at"] % 100, r["public_metrics"] and r["public_metrics"]["like_count"], r["text"]) for r in rows}


BASE = 1651363200 % 100


def test_ingest_sequence(spark, house):
    ref = {"referenced_tweets": [{"type": "quoted", "id": "inc"}]}
    included = post("inc", "good good", at(1), author_id="u", public_metrics=metrics(3), lang="en")
    carrier = envelope(post("main", "bad bad", at(10), lang="en", public_metrics=metrics(1), **ref), users=[{"id": "u", "name": "n"}], tweets=[included])
    run(spark, house, "b.0", carrier, envelope(post("unruled", created_at=at(1)), rules=[]), envelope(post("late", created_at=None)))
    assert summary(spark, house) == {"main": (BASE + 10, 1, "bad bad"), "inc": (BASE + 10, 3, "good good"), "late": (0, None, "hello world")}
    docs = by_id(house.gold.read(spark))
    assert sorted(docs) == ["inc", "main"]  # a post without a time is not indexed
    assert docs["inc"]["comprehend"]["sentiment"] == "POSITIVE" and docs["main"]["comprehend"]["sentiment"] == "NEGATIVE"
    assert docs["inc"]["author"]["name"] == "n" and docs["inc"]["normalized_text"] == "good good"
    assert ids(read_archive(spark, house.bronze), "data.id") == ["main", "unruled"] and ids(read_archive(spark, house.bronze_errors), "data.id") == ["late"]
    assert {r["id"]: r["event_name"] for r in house.changes.read(spark).collect()} == {"main": "INSERT", "inc": "INSERT", "late": "INSERT"}

    # a later carrier updates the metrics of the stored post only; an older one changes nothing
    newer = {**included, "text": "changed", "public_metrics": metrics(8)}
    run(spark, house, "b.1", envelope(post("m2", created_at=at(20)), tweets=[newer]), envelope(post("m3", created_at=at(5)), tweets=[{**newer, "public_metrics": metrics(99)}]))
    state = summary(spark, house)
    assert state["inc"] == (BASE + 20, 8, "good good") and len(state) == 5
    docs = by_id(house.gold.read(spark))
    assert docs["inc"]["public_metrics"]["like_count"] == 8 and docs["inc"]["comprehend"]["sentiment"] == "POSITIVE"
    changes = {r["id"]: r["event_name"] for r in house.changes.read_batch(spark, "b.1").collect()}
    assert changes == {"inc": "MODIFY", "m2": "INSERT", "m3": "INSERT"}

    # a put replaces the row even if it is older; the update after it in the same batch applies to it
    run(spark, house, "b.2", envelope(post("inc", "put", at(3), lang="en", public_metrics=metrics(5))), envelope(post("m4", created_at=at(4)), tweets=[{**included, "public_metrics": metrics(6)}]))
    assert summary(spark, house)["inc"] == (BASE + 4, 6, "put")
    run(spark, house, "b.3", envelope(post("m5", created_at=at(30)), tweets=[{**included, "public_metrics": metrics(7)}]), envelope(post("inc", "last", at(2))))
    assert summary(spark, house)["inc"] == (BASE + 2, None, "last")
    assert by_id(house.gold.read(spark))["inc"]["text"] == "last"


def test_batches_can_be_repeated(spark, house, monkeypatch):
    first = envelope(post("a", "good", at(1), lang="en"), tweets=[post("b", "bad", at(1), lang="en", public_metrics=metrics(1))])
    second = envelope(post("c", "good", at(9), lang="en"), tweets=[post("b", "bad", at(1), public_metrics=metrics(2))])
    run(spark, house, "s.0", first)
    run(spark, house, "s.0", second)  # same batch number: already there, left alone
    assert sorted(summary(spark, house)) == ["a", "b"]

    # the job dies after the state is written, before the documents are
    import postflow.plans.jobs as jobs

    monkeypatch.setattr(jobs, "index_changes", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, house, "s.1", second)
    assert summary(spark, house)["b"][1] == 2 and by_id(house.gold.read(spark))["b"]["public_metrics"]["like_count"] == 1
    monkeypatch.undo()
    run(spark, house, "s.1", second)
    docs = by_id(house.gold.read(spark))
    assert sorted(docs) == ["a", "b", "c"] and docs["b"]["public_metrics"]["like_count"] == 2
    assert len(ids(house.state.read(spark))) == 3 and len(ids(house.cache.read(spark), "cache_key")) == 2
    assert ids(read_archive(spark, house.bronze), "data.id") == ["a", "c"]


def test_stream_equals_batch(spark, house, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    objects = [envelope(post(str(i), "good" if i % 2 else "bad", at(i), lang="en"), tweets=[post(f"i{i}", "good", at(1), lang="en", public_metrics=metrics(i))]) for i in range(4)]
    for i, chunk in enumerate((objects[:2], objects[1:3], objects[3:])):
        (source / f"{i}.json").write_text("".join(json.dumps(o) + "\n" for o in chunk))
    stream = read_envelopes(spark, str(source), streaming=True, max_files_per_trigger=1)
    query = ingest(stream, config(house), str(tmp_path / "cp"))
    query.awaitTermination()
    batch = Warehouse(str(tmp_path / "batch"), buckets=4)
    run(spark, batch, "b.0", *objects)
    assert by_id(house.gold.read(spark)) == by_id(batch.gold.read(spark))
    assert house.bronze and sorted(ids(read_archive(spark, house.bronze), "data.id")) == ["0", "1", "2", "3"]


def test_reindex(spark, house, tmp_path):
    run(spark, house, "b.0", envelope(post("a", "good", at(1), lang="en")), envelope(post("old", created_at="2021-01-01T00:00:00.000Z")))
    rebuilt = Warehouse(house.root, buckets=4)
    empty = KeyedTable(f"{tmp_path}/gold2", schemas.DOCUMENT, "month")

    class Other(Warehouse):
        gold = empty

    other = Other(house.root, buckets=4)
    reindex_year(other, spark, "2022", "year.2022")
    assert ids(empty.read(spark)) == ["a"]
    reindex_year(rebuilt, spark, "2021", "year.2021")
    assert ids(rebuilt.gold.read(spark)) == ["a", "old"]

    lines = tmp_path / "archive"
    lines.mkdir()
    (lines / "x.json").write_text(json.dumps(envelope(post("n", "bad", at(2), lang="en"))) + "\n" + json.dumps(envelope(post("a", "bad", at(3), lang="en"))) + "\n")
    reindex_archive(spark, str(lines), rebuilt, SCORER, "archive.0")
    docs = by_id(rebuilt.gold.read(spark))
    assert docs["n"]["comprehend"]["sentiment"] == "NEUTRAL" and docs["a"]["text"] == "bad"
    assert ids(reingest(spark, str(lines)), "key") == ["a", "n"]


def test_reingest_legacy_files(spark, tmp_path):
    (tmp_path / "v1.json").write_text('{"id_str": "a"}\n{"id_str": "b"}\n{"id_str": "a"}\n{"id_str": "gone"}\n')
    pool = posts(spark, post("a"), post("b", source="bot"))
    found, rate = reingest_legacy_files(spark, str(tmp_path), pool, labels=["bot"])
    assert ids(found, "data.id") == ["a"] and rate.first()[0] == 50.0
    assert reingest_legacy_files(spark, str(tmp_path), pool.where("false"))[1].first()[0] is None


def test_backfill(spark):
    state = from_json(spark, schemas.STATE, post("a", "good good", lang="en", updated_at=1), post("b", comprehend={"sentiment": "MIXED"}, updated_at=1), post("c", updated_at=1))
    changes = state.where("id <> 'c'").withColumn("event_name", F.lit("MODIFY"))
    merged, cache = backfill(changes, state, None, SCORER)
    rows = by_id(merged)
    assert rows["a"]["comprehend"]["sentiment"] == "POSITIVE" and rows["a"]["normalized_text"] == "good good"
    assert rows["b"]["comprehend"]["sentiment"] == "MIXED" and rows["c"]["comprehend"] is None and cache.count() == 1


def test_keyed_table_versions(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), spark.createDataFrame([], "id STRING, n INT, part STRING").schema, "part")

    def rows(*values):
        return spark.createDataFrame(values, "id STRING, n INT, part STRING")

    def content(**kw):
        return sorted(tuple(r) for r in table.read(spark, **kw).collect())

    assert content() == []
    table.write(rows(("a", 1, "p"), ("b", 1, "q")), "x.0")
    table.write(rows(("a", 2, "p")), "x.1")
    table.write(rows(("a", 9, "p")), "x.1")
    assert content() == [("a", 2, "p"), ("b", 1, "q")] and content(before="x.1") == [("a", 1, "p"), ("b", 1, "q")]
    # a write that died leaves no marker and is not seen
    (tmp_path / "t" / "v=0000000003.x.2" / "part=p").mkdir(parents=True)
    assert content() == [("a", 2, "p"), ("b", 1, "q")] and table.version_of(spark, "x.2") is None
    table.write(rows(("a", 3, "p")), "x.2")
    table.write(rows(("a", 4, "p")), "x.3")
    before = content(before="x.3")
    assert len(table.vacuum(spark, keep=2)) == 2
    assert content() == [("a", 4, "p"), ("b", 1, "q")] and content(before="x.3") == before
    touched = table.touched(table.read(spark), rows(("z", 0, "q")))
    assert [r["id"] for r in touched.collect()] == ["b"]


def test_batch_log(spark, tmp_path):
    log = BatchLog(str(tmp_path / "log"), spark.createDataFrame([], "k STRING").schema)
    assert log.read(spark).count() == 0
    log.write(spark.createDataFrame([("a",), ("b",)], "k STRING"), "x.0")
    log.write(spark.createDataFrame([("c",)], "k STRING"), "x.1")
    log.write(spark.createDataFrame([("d",)], "k STRING"), "x.1")
    assert ids(log.read(spark), "k") == ["a", "b", "d"] and ids(log.read(spark, without="x.1"), "k") == ["a", "b"]
    log.replace(log.read(spark).where("k <> 'a'"), "compact")
    assert ids(log.read(spark), "k") == ["b", "d"]


@pytest.mark.parametrize("local_first", [True, False])
def test_dedupe_stream_over_batches(spark, tmp_path, local_first):
    source = tmp_path / "in"
    source.mkdir()
    for i, names in enumerate((["a", "a", "b"], ["a", "c"], ["b", "d", "d"])):
        (source / f"{i}.json").write_text("".join(json.dumps(envelope(post(n, f"{n}{i}"))) + "\n" for n in names))
    events = to_bus_events(read_envelopes(spark, str(source), streaming=True, max_files_per_trigger=1))
    keyed = events.select(F.col("data.id").alias("id"), "event_time")
    out = str(tmp_path / "out")
    query = O.dedupe_stream(keyed, local_first=local_first).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    query.trigger(availableNow=True).start(out).awaitTermination()
    assert ids(spark.read.parquet(out)) == ["a", "b", "c", "d"]


def test_drop_stale(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = spark.sql("SELECT * FROM VALUES ('old', timestamp'2023-12-31 23:59:59'), ('edge', timestamp'2024-01-01 00:00:00'), ('new', timestamp'2024-01-02 00:00:00') AS t(id, ts)")
    assert ids(drop_stale(rows, "ts", now=now)) == ["edge", "new"]


def test_reingest_files_takes_each_file_once(spark, tmp_path):
    source, moved, out = tmp_path / "in", tmp_path / "moved", str(tmp_path / "out")
    source.mkdir()

    def deliver(name, *names):
        (source / name).write_text("".join(json.dumps(envelope(post(n))) + "\n" for n in names))

    def run():
        query = reingest_files(spark, str(source), out, str(tmp_path / "cp"), bytes_per_trigger=1, clean_source="archive", archive_dir=str(moved))
        query.awaitTermination()
        assert query.exception() is None
        return len([p for p in query.recentProgress if p["numInputRows"]])

    deliver("a.json", "1", "2")
    deliver("b.json", "3")
    deliver("c.json", "4")
    assert run() == 3  # a file each, however small the bound
    deliver("d.json", "5")
    assert run() == 1
    assert sorted(r["key"] for r in spark.read.schema("key STRING").json(out).collect()) == list("12345")
    assert {p.name for p in moved.rglob("*.json")} >= {"a.json", "b.json"}  # moved once a later batch has committed


def test_reingest_legacy_stream(spark, tmp_path, house):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "v1.json").write_text('{"id_str": "a"}\n{"id_str": "b"}\n{"id_str": "a"}\n{"id_str": "gone"}\nnot json\n')
    pool = posts(spark, post("a", referenced_tweets=[{"type": "quoted", "id": "c"}]), post("b", source="bot"), post("c"))
    query = reingest_legacy_stream(spark, str(source), pool, house, out, str(tmp_path / "cp"), labels=["bot"])
    query.awaitTermination()
    assert query.exception() is None
    (record,) = spark.read.schema("key STRING, value STRING").json(out).collect()
    assert record["key"] == "a" and [t["id"] for t in json.loads(record["value"])["includes"]["tweets"]] == ["c"]
    assert [tuple(r) for r in house.counters.read(spark).collect()] == [("legacy", "incoming", 1)]
