import pytest
from pyspark.sql import functions as F

from helpers import envelope, envelopes, from_json, ids, post, posts
from postflow import constants as K
from postflow import schemas
from postflow.operators import fanout as O
from postflow.operators import filters
from postflow.operators.state import to_state_row, to_state_row_v1
from postflow.sources.envelopes import to_bus_events


def annotations(*names):
    return [{"domain": {"name": n}, "entity": {"name": "e"}} for n in names]


@pytest.fixture(scope="module")
def domain_posts(spark):
    return posts(
        spark,
        post("missing"),
        post("empty", context_annotations=[]),
        post("denied", context_annotations=annotations("Actor", "Musician")),
        post("mixed", context_annotations=annotations("Actor", "Sports")),
        post("fine", context_annotations=annotations("Sports")),
        post("nameless", context_annotations=[{"domain": {}, "entity": {}}]),
    )


def test_deny_domain(domain_posts, spark):
    assert ids(filters.deny_domain(domain_posts)) == ["empty", "fine", "missing", "nameless"]
    assert ids(filters.deny_domain(domain_posts, mode="any")) == ["fine", "mixed"]
    deny = spark.createDataFrame([(n,) for n in K.DENIED_CONTEXT_DOMAINS], "domain STRING")
    assert ids(O.deny_join(domain_posts, deny)) == ["empty", "fine", "missing", "nameless"]
    with pytest.raises(ValueError):
        filters.deny_domain(domain_posts, mode="all")


def test_deny_source(spark):
    rows = posts(spark, post("a", source="bot"), post("b"), post("c", source="web"))
    assert ids(filters.deny_source(rows, ["bot"])) == ["b", "c"]
    assert ids(filters.deny_source(rows, ["bot", ""])) == ["c"]
    assert ids(filters.deny_source(rows, [])) == ["a", "b", "c"]


def test_times(spark):
    rows = posts(
        spark,
        post("none", created_at=None), post("bad", created_at="201x"), post("edge", created_at="2019-12-01T00:00:00.000Z"),
        post("after", created_at="2019-12-01T00:00:00.001Z"), post("old", created_at="2018-01-01T00:00:00.000Z"),
        post("new", created_at="2022-01-01T00:00:00.000Z"),
    )
    assert ids(filters.date_floor(rows)) == ["after", "new"]
    assert ids(filters.created_prefix(rows)) == ["new"]


def test_rules_and_routes(spark):
    rows = envelopes(
        spark,
        envelope(post("a")), envelope(post("b"), rules=[]), envelope(post("c"), rules=[{"tag": "only"}]),
        {"data": post("d")}, envelope(post("e", context_annotations=annotations("Actor"))),
    )
    events = to_bus_events(rows)
    assert ids(filters.rule_exists(events), "data.id") == ["a", "e"]
    assert ids(filters.new_posts(events), "data.id") == ["a"]
    assert ids(filters.included_posts(events), "data.id") == []
    assert ids(filters.archivable(events), "data.id") == ["a", "b", "c", "d", "e"]
    replayed = to_bus_events(rows.withColumn("replay_name", F.lit("again")))
    assert ids(filters.archivable(replayed), "data.id") == [] and ids(filters.new_posts(replayed), "data.id") == ["a"]


def test_change_filters(spark):
    rows = from_json(spark, schemas.STATE, post("a"), post("b", text=None), post("c", created_at=None), post("d", comprehend={"sentiment": "MIXED"}))
    modify = rows.withColumn("event_name", F.lit("MODIFY"))
    assert ids(filters.change_filter(modify)) == ["a", "d"]
    assert ids(filters.needs_enrichment(modify)) == ["a", "c"]
    assert ids(filters.change_filter(rows.withColumn("event_name", F.lit("REMOVE")))) == []


def test_languages(spark):
    rows = posts(spark, *[post(lang or "none", lang=lang) for lang in ("ja", "zh-TW", "th", None)])
    routed = {r["id"]: (r["language_code"], r["analysis_route"]) for r in filters.route_language(rows).collect()}
    assert routed == {"ja": ("ja", "detect"), "zh-TW": ("zh-TW", "detect"), "th": ("th", "translate"), "none": ("auto", "translate")}


def test_fanout(spark):
    rows = to_bus_events(
        envelopes(
            spark,
            envelope(post("0")), envelope(post("1"), tweets=[]), envelope(post("3"), users=[{"id": "u"}], tweets=[post("a"), post("b"), post("c")]),
            envelope(post("x", created_at=None), tweets=[post("d")]),
        )
    )
    out = {r["data"]["id"]: r for r in O.fanout(rows).collect()}
    assert sorted(out) == ["a", "b", "c", "d"]
    assert out["a"]["matching_rules"] == [] and out["a"]["detail_type"] == "IncludedTweet"
    assert len(out["a"]["includes"]["tweets"]) == 3 and out["a"]["includes"]["users"][0]["id"] == "u"
    assert out["a"]["event_time"].isoformat() == "2022-05-01T12:34:56" and out["d"]["event_time"] is None
    assert O.fanout(rows).schema.simpleString() == rows.schema.simpleString()


def test_authors(spark):
    users = [{"id": "u1", "name": "first"}, {"id": "u1", "name": "second"}, {"id": "u2", "name": "other"}]
    rows = envelopes(
        spark, envelope(post("a", author_id="u1"), users=users), envelope(post("b", author_id="u9"), users=users), {"data": post("c", author_id="u1")}
    )
    found = {r["data"]["id"]: r for r in O.author_list(O.with_author(rows)).collect()}
    assert found["a"]["author"]["name"] == "first" and len(found["a"]["authors"]) == 2
    assert found["b"]["author"] is None and found["b"]["authors"] == [] and found["c"]["author"] is None
    table = from_json(spark, schemas.USER, *users).withColumn("n", F.monotonically_increasing_id())
    joined = O.with_author(posts(spark, post("a", author_id="u1"), post("b", author_id="u9"), post("c")), table, arrival="n")
    assert {r["id"]: r["author"] and r["author"]["name"] for r in joined.collect()} == {"a": "first", "b": None, "c": None}


def test_state_rows(spark):
    now = F.lit("2030-01-01").cast("timestamp")
    rows = to_bus_events(
        envelopes(spark, envelope(post("a", author_id="u", source=""), users=[{"id": "u", "name": "n"}]), envelope(post("b", created_at=None)))
    )
    out = {r["id"]: r for r in to_state_row(rows, now).collect()}
    assert out["a"]["updated_at"] == 1651408496 and out["a"]["author"]["name"] == "n" and out["a"]["_all"] == "stub"
    assert out["a"]["source"] is None and out["b"]["updated_at"] == 1893456000 and out["b"]["author"] is None
    assert to_state_row(rows).schema.names == schemas.STATE.names


def test_legacy_state_rows(spark):
    bad = post("bad", context_annotations=annotations("Actor"))
    rows = envelopes(
        spark,
        envelope(post("main", author_id="u"), users=[{"id": "u", "name": "n"}, {"id": "v", "name": "m"}],
                 tweets=[post("inc", author_id="v", created_at="2021-01-01T00:00:00.000Z"), post("old", created_at="2010-01-01T00:00:00.000Z"), bad]),
        envelope(bad, tweets=[post("lost")]),
        envelope(post("bot", source="bot")),
    )
    out = {r["id"]: r for r in to_state_row_v1(rows, ["bot"]).collect()}
    assert sorted(out) == ["inc", "main"]
    assert out["inc"]["kind"] == "included" and out["inc"]["created_at_year"] == "2021" and out["inc"]["author"]["name"] == "m"
    assert out["inc"]["updated_at"] == out["main"]["updated_at"] == 1651408496


def test_hydrate(spark):
    pool = posts(
        spark,
        post("a", author_id="u", referenced_tweets=[{"type": "quoted", "id": "b"}, {"type": "replied_to", "id": "gone"}]),
        post("b", author_id="v", source="bot"), post("c", context_annotations=annotations("Actor")), post("d"),
    )
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("missing",)], "id STRING")
    users = from_json(spark, schemas.USER, {"id": "u", "name": "n"})
    rows = O.hydrate(wanted, pool, users, ["bot"], ["Actor"]).collect()
    assert len(rows) == 1 and rows[0]["backup"] is True
    assert rows[0]["data"]["id"] == "a" and [t["id"] for t in rows[0]["includes"]["tweets"]] == ["b"]
    assert [u["name"] for u in rows[0]["includes"]["users"]] == ["n"]


def test_referenced_posts(spark):
    rows = envelopes(
        spark,
        envelope(post("a", referenced_tweets=[{"type": "quoted", "id": "x"}]), tweets=[post("x"), post("y")]),
        envelope(post("b"), tweets=[post("x")]),
    )
    kept = {r["data"]["id"]: [t["id"] for t in r["includes"]["tweets"]] for r in O.referenced_posts(rows).collect()}
    assert kept == {"a": ["x"], "b": []}
