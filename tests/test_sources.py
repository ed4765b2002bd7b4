import gzip
import json

import pytest
from pyspark.sql import functions as F

from helpers import by_id, envelope, envelopes, ids, post, posts
from postflow.operators.fanout import distinct_ids
from postflow.sinks.archive import split_valid, write_bronze
from postflow.sinks.publish import emit, republish, write_with_failover
from postflow.sources import envelopes as E
from postflow.sources.images import read_change_images
from postflow.sources.lists import default_dictionary, default_synonyms, deny_list, dictionary_terms, read_dictionary, read_synonyms


def lines(*objects):
    return "".join(json.dumps(o) + "\n" for o in objects)


@pytest.fixture
def archive(tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(lines(envelope(post("1", "日本")), envelope(post("2"))))
    (tmp_path / "b.json").write_text(lines(envelope(post("3"))) + '{"data": {"id": "broken"\n\n' + lines(envelope(post("4"))))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "bad.json.gz").write_bytes(b"this is no gzip file")
    return str(tmp_path)


def test_read_archive(spark, archive):
    rows = E.read_archive(spark, archive)
    assert ids(rows, "data.id") == ["1", "2", "3", "4"] and rows.count() == 4
    assert ids(E.read_archive(spark, [f"{archive}/a.json.gz", f"{archive}/b.json"]), "data.id") == ["1", "2", "3", "4"]


def test_stream_reads_and_cleans(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(lines(envelope(post(str(i)))))
    stream = E.read_archive(spark, str(source), streaming=True, max_files_per_trigger=1, clean_source="delete")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    query = stream.select("data.id").writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert ids(spark.read.schema("id STRING").json(out)) == ["0", "1", "2"]
    assert len(list(source.iterdir())) < 3


def test_legacy_ids(spark, tmp_path):
    (tmp_path / "v1.json").write_text(lines({"id_str": "1", "text": "x"}, {"id_str": "2"}, {"id_str": "1"}, {"other": 1}))
    assert ids(distinct_ids(E.read_legacy_ids(spark, str(tmp_path)))) == ["1", "2"]


def test_bus_events_and_payloads(spark):
    rows = envelopes(spark, envelope(post("1"), errors=[{"title": "t", "detail": "d"}]), envelope(post("2", created_at="nonsense")), envelope(post("3", created_at=None)))
    events = E.to_bus_events(rows)
    times = {r["data"]["id"]: r["event_time"] for r in events.collect()}
    assert times["1"].isoformat() == "2022-05-01T12:34:56" and times["2"] is None and times["3"] is None
    assert [r["title"] for r in E.stream_errors(rows).collect()] == ["t"]
    assert E.decode_payload(E.encode_payload(rows)).collect() == rows.collect()
    bad = spark.createDataFrame([("not json",), (None,), ("{}",)], "body STRING")
    assert E.decode_bodies(bad).count() == 0
    detail = emit(events, "Tweet").select("detail").collect()
    assert json.loads(detail[0]["detail"])["data"]["id"] == "1" and "source" not in json.loads(detail[0]["detail"])
    assert ids(republish(rows), "key") == ["1", "2", "3"]
    with pytest.raises(ValueError):
        E.union_sources([None])


def test_bronze_roundtrip_and_replay(spark, tmp_path):
    out, errors = str(tmp_path / "bronze"), str(tmp_path / "errors")
    events = E.to_bus_events(envelopes(
        spark, envelope(post("a")), envelope(post("b", created_at="2022-05-02T00:00:00.000Z")), envelope(post("c", created_at=None)),
        envelope(post("d", created_at="2022-05-02T00:00:00Z")),  # the partition key needs the fraction
    ))
    for tag in ("t.0", "t.0", "t.1"):
        write_bronze(events if tag == "t.0" else events.where(F.col("data.id") == "a"), out, tag, errors)
    assert sorted(p.name for p in (tmp_path / "bronze" / "year=2022" / "month=05").glob("day=*")) == ["day=01", "day=02"]
    assert all(p.suffix == ".gz" for p in (tmp_path / "bronze").rglob("part-*"))
    assert ids(E.read_archive(spark, out), "data.id") == ["a", "a", "b"]
    assert ids(E.read_archive(spark, errors), "data.id") == ["c", "d"]
    days = E.read_archive_days(spark, out, "2022-05-02", "2022-05-31")
    assert ids(days, "data.id") == ["b"]
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(concat_ws(" in plan
    replayed = E.replay(E.read_archive_days(spark, out, "2022-01-01", "2022-12-31"), "2022-05-02", "2022-05-03", "again")
    assert [(r["data"]["id"], r["replay_name"]) for r in replayed.collect()] == [("b", "again")]
    assert split_valid(events)[1].select("error_type").distinct().count() == 1


def test_change_images(spark):
    image = {
        "id": {"S": "1"}, "updated_at": {"N": "5"}, "possibly_sensitive": {"Bool": True}, "lang": {"Nul": True}, "text": {"S": 'say "Bool"'},
        "public_metrics": {"M": {"like_count": {"N": "3"}}}, "referenced_tweets": {"L": [{"M": {"type": {"S": "quoted"}, "id": {"S": "9"}}}]},
        "geo": {"M": {"coordinates": {"M": {"coordinates": {"L": [{"N": "1.5"}, {"N": "-2"}]}}}}},
        "comprehend": {"M": {"Sentiment": {"S": "MIXED"}, "SentimentScore": {"M": {"Positive": {"N": "0.5"}}}, "Entities": {"L": []}}},
    }
    rows = spark.createDataFrame([("MODIFY", json.dumps(image)), ("INSERT", json.dumps({"id": {"S": "2"}, "updated_at": {"N": "x"}}))], "event_name STRING, new_image STRING")
    got = by_id(read_change_images(rows))
    one = got["1"]
    assert one["event_name"] == "MODIFY" and one["updated_at"] == 5 and one["possibly_sensitive"] is True and one["lang"] is None
    assert one["text"] == 'say "Bool"' and one["public_metrics"]["like_count"] == 3 and one["public_metrics"]["quote_count"] is None
    assert one["referenced_tweets"][0]["id"] == "9" and one["geo"]["coordinates"]["coordinates"] == [1.5, -2.0]
    assert one["comprehend"]["sentiment"] == "MIXED" and one["comprehend"]["sentiment_score"]["positive"] == 0.5 and one["comprehend"]["entities"] == []
    assert got["2"]["updated_at"] is None and got["2"]["comprehend"] is None


def test_lists(spark, tmp_path):
    assert deny_list("a,b") == ["a", "b"] and deny_list("a", legacy=True) == ["a", "Video Game"]
    (tmp_path / "one").mkdir()
    old, new = tmp_path / "dictionary.txt", tmp_path / "one" / "dictionary.txt"
    import os

    old.write_text("古い,古い,フルイ,一般名詞\n")
    new.write_text("k8s,k8s,kubernetes,一般名詞\n新,新,シン,固有名詞\n")
    (tmp_path / "one" / "notes.md").write_text("x,x,x,x\n")
    os.utime(old, (1, 1))
    rows = read_dictionary(spark, f"{tmp_path}/dictionary.txt,{tmp_path}/one".split(",")).collect()
    assert sorted(r["surface"] for r in rows) == ["k8s", "新"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "synonyms.txt").write_text("Kubernetes, k8s\nserver,サーバー,サーバ\n\n")
    terms = {r["term"]: r["canonical"] for r in read_synonyms(spark, str(tmp_path / "s")).collect()}
    assert terms == {"kubernetes": "kubernetes", "k8s": "kubernetes", "server": "server", "サーバー": "server", "サーバ": "server"}
    assert default_dictionary(spark).count() == 20 and default_synonyms(spark).where("canonical = 'kubernetes'").count() == 2
    assert "node.js" in dictionary_terms() and "api gateway" in dictionary_terms()


def test_failover(spark):
    rows, taken = posts(spark, post("1")), []

    def broken(df):
        raise OSError("down")

    assert write_with_failover(rows, {"b_second": lambda df: taken.append("second"), "a_first": broken}) == "b_second"
    assert write_with_failover(rows, {"b": broken, "a": lambda df: taken.append("first")}) == "a"
    assert taken == ["second", "first"]
    with pytest.raises(RuntimeError):
        write_with_failover(rows, {"a": broken})


def test_batch_archive_joins_its_batch_once(spark, monkeypatch):
    """Both branches and the retry read the rows of the batch; none of them joins posts and documents again."""
    from postflow.plans.queries import streams

    plans = []

    def write(events, *args):
        plans.append(events._jdf.queryExecution().optimizedPlan().toString())
        write_bronze(events, *args)

    monkeypatch.setattr(streams, "write_bronze", write)
    assert streams.batch_archive(spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
