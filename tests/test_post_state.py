import random
import time

import pytest
from pyspark.sql import functions as F

from helpers import by_id, envelope, metrics, post
from postflow.operators.analysis import LexiconScorer
from postflow.plans.jobs import IngestConfig, Warehouse, compact_state, ingest_keyed
from postflow.sources.envelopes import read_envelopes
from postflow.streaming import post_state as S


def sequential(stored, events):
    """The events one by one; an update that comes before the last put of its batch leaves no trace."""
    events = sorted(events, key=lambda e: e.place)
    puts = [e for e in events if e.kind == S.PUT]
    last = puts[-1] if puts else None
    base = last or stored
    behind = [e for e in events if e.kind == S.UPDATE and (last is None or e.place > last.place)]
    if not behind:
        return base and S.Stored(base.version, base.has_text, base.metrics, base.row)
    best = behind[0]
    for e in behind[1:]:
        if (e.version is not None and best.version is None) or (e.version is not None and best.version is not None and e.version > best.version):
            best = e
    if base is None or (base.version is not None and best.version is not None and base.version < best.version):
        if base is None or not base.has_text:
            return S.Stored(best.version, best.has_text, best.metrics, best.row)
        return S.Stored(best.version, base.has_text, best.metrics, base.row)
    return S.Stored(base.version, base.has_text, base.metrics, base.row)


def random_events(rng, n):
    places = rng.sample(range(100), n)
    kinds = [rng.choice([S.PUT, S.UPDATE, S.UPDATE]) for _ in range(n)]
    return [S.Event(k, rng.choice([None, 1, 2, 3, 4]), f"{p:03}", rng.random() < 0.6, f"m{p}", f"r{p}") for k, p in zip(kinds, places)]


def test_reduced_events_give_the_result_of_all():
    rng = random.Random(4)
    for _ in range(3000):
        events = random_events(rng, rng.randint(1, 9))
        stored = rng.choice([None, S.Stored(rng.choice([None, 2, 3]), rng.random() < 0.5, "m", "r")])
        want = sequential(stored, events)
        cut = rng.randint(0, len(events))
        shuffled = rng.sample(events, len(events))
        parts = S.reduced([*S.reduced(shuffled[:cut]), *S.reduced(shuffled[cut:])])
        change = S.applied(stored, parts)
        assert (change[0] if change else stored) == want
        if change:
            assert change[1] == ("INSERT" if stored is None else "MODIFY")


def test_many_updates_leave_few():
    rng = random.Random(5)
    events = [S.Event(S.UPDATE, rng.randrange(10**6), f"{p:06}", True, None, "") for p in range(20_000)]
    assert len(S.reduced(events)) < 40


def at(second):
    return f"2022-05-01T00:00:{second:02}.000Z"


def written_lines(tmp_path, name, *objects):
    import json

    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(o) for o in objects) + "\n")
    time.sleep(0.05)  # files are told apart by their time


def run(spark, tmp_path, house, **options):
    config = IngestConfig(house, LexiconScorer(("good",), ("bad",)), now=F.lit("2022-06-01").cast("timestamp"))
    envelopes = read_envelopes(spark, str(tmp_path / "in"), streaming=True, max_files_per_trigger=1, arrival=True)
    query = ingest_keyed(envelopes, config, str(tmp_path / "checkpoint"), **options)
    query.awaitTermination()
    assert query.exception() is None


def test_late_repeated_and_promoted_posts(spark, tmp_path):
    house = Warehouse(str(tmp_path / "house"), buckets=4)
    inc = post("inc", "good good", at(1), lang="en", public_metrics=metrics(3))
    carrier = lambda name, second, likes, **more: envelope(
        post(name, "bad bad", at(second), lang="en"), tweets=[{**inc, "public_metrics": metrics(likes), **more}]
    )
    written_lines(tmp_path, "a", carrier("m1", 10, 3), carrier("m2", 12, 4))  # promoted at once, the newer metrics count
    written_lines(tmp_path, "b", carrier("m3", 5, 99), carrier("m1", 10, 3))  # late, and a repeated delivery
    written_lines(tmp_path, "c", carrier("m4", 20, 8, text="changed"))  # metrics only
    written_lines(tmp_path, "d", envelope(post("m1", "good good", at(30), lang="en", public_metrics=metrics(1))))  # replaced
    run(spark, tmp_path, house)
    docs = by_id(house.gold.read(spark))
    assert sorted(docs) == ["inc", "m1", "m2", "m3", "m4"]
    assert docs["inc"]["text"] == "good good" and docs["inc"]["public_metrics"]["like_count"] == 8
    assert docs["inc"]["comprehend"]["sentiment"] == "POSITIVE" and docs["m1"]["comprehend"]["sentiment"] == "POSITIVE"
    changes = house.changes.read_tagged(spark).where("id = 'inc'").select("batch", "event_name").collect()
    assert sorted(map(tuple, changes)) == [("keyed.0", "INSERT"), ("keyed.2", "MODIFY")]
    compact_state(spark, house, "keyed", "c.0")
    state = by_id(house.state.read(spark))
    assert state["inc"]["comprehend"]["sentiment"] == "POSITIVE" and state["inc"]["public_metrics"]["like_count"] == 8
    assert state["m1"]["text"] == "good good" and state["m1"]["public_metrics"]["like_count"] == 1

    # the query goes on where it stopped, with its state
    written_lines(tmp_path, "e", carrier("m5", 15, 50), carrier("m6", 40, 9))
    run(spark, tmp_path, house)
    assert by_id(house.gold.read(spark))["inc"]["public_metrics"]["like_count"] == 9


def test_idle_posts_leave_the_store(spark, tmp_path):
    house = Warehouse(str(tmp_path / "house"), buckets=4)
    written_lines(tmp_path, "a", envelope(post("x", "good", at(1), lang="en")))
    with pytest.raises(ValueError, match="interval"):
        run(spark, tmp_path, house, idle_ms=1)
    config = IngestConfig(house, LexiconScorer((), ()), now=F.lit("2022-06-01").cast("timestamp"))
    envelopes = read_envelopes(spark, str(tmp_path / "in"), streaming=True, arrival=True)
    query = ingest_keyed(envelopes, config, str(tmp_path / "checkpoint"), interval="1 second", idle_ms=1)
    try:
        events, end = [], time.time() + 60
        while S.EXPIRED not in events and time.time() < end and query.isActive:
            time.sleep(1)
            events = [r[0] for r in house.changes.read_tagged(spark).where("id = 'x'").select("event_name").collect()]
    finally:
        query.stop()
    assert query.exception() is None and sorted(set(events)) == [S.EXPIRED, "INSERT"]
    assert "x" in by_id(house.gold.read(spark))  # its document stays


def test_a_missing_api_is_said_at_once(spark, monkeypatch):
    monkeypatch.setattr(S, "GroupedData", object)
    with pytest.raises(RuntimeError, match="transformWithStateInPandas"):
        S.require_state_api(spark)


def test_order_is_needed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError, match="arrival"):
        ingest_keyed(read_envelopes(spark, str(tmp_path / "in"), streaming=True), None, str(tmp_path / "cp"))


class Store:
    """A value of the state store that counts the messages it takes."""

    def __init__(self):
        self.value, self.messages = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.messages += 1
        return self.value

    def update(self, value):
        self.messages += 1
        self.value = value


def test_posts_of_a_page_take_two_messages_to_the_store():
    page, store = S.PostState(), Store()
    page.init(store)
    rows = lambda kind, version, place: [
        S.Row(id=f"p{i}", kind=kind, version=version, place=f"{place}", has_text=True, metrics=f"m{version}", row=f"{kind}{version}") for i in range(500)
    ]
    first = list(page.handleInputRows((0,), iter(rows(S.PUT, 1, 1)), None))
    assert store.messages == 2 and {r["event_name"] for r in first} == {"INSERT"} and len(first) == 500
    second = list(page.handleInputRows((0,), iter(rows(S.UPDATE, 3, 2) + rows(S.UPDATE, 2, 3)), None))
    assert store.messages == 4 and {(r["event_name"], r["version"], r["metrics"], r["row"], r["fresh"]) for r in second} == {("MODIFY", 3, "m3", "put1", False)}
    assert list(page.handleInputRows((0,), iter(rows(S.UPDATE, 3, 4)), None)) == [] and store.messages == 5
