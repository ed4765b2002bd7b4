from pyspark.sql import functions as F

from helpers import by_id, column, from_json, metrics, post
from postflow import schemas
from postflow.functions import flatten as X
from postflow.operators.document import to_document, upsert_documents
from postflow.operators.state import merge_partial


def state(spark, *objects):
    return from_json(spark, schemas.STATE, *objects)


def entity(text, kind="OTHER", score=0.9):
    return {"text": text, "type": kind, "score": score}


def test_clean_entities(spark):
    found = [
        entity("5", "QUANTITY"), entity("ten", "QUANTITY"), entity("today", "DATE"), entity("x"), entity("😀"),
        entity("@bob"), entity("low", score=0.79), entity("Edge", score=0.8), {"text": "NoScore", "type": "OTHER"},
        {"text": "NoType", "score": 0.9}, entity("edge"), entity("EDGE"),
    ]
    rows = state(spark, post("1", comprehend={"entities": found}))
    assert column(to_document(rows), "comprehend.entities") == [["😀", "edge", "noscore", "notype"]]


def test_flatten_missing_and_empty(spark):
    rows = state(
        spark,
        post("none"),
        post("empty", entities={}, context_annotations=[], referenced_tweets=[], comprehend={"sentiment": "MIXED"}),
    )
    docs = by_id(to_document(rows))
    none, empty = docs["none"], docs["empty"]
    assert none["entities"] is None and none["context_annotations"] is None and none["referenced_tweets"] is None
    assert none["geo"] is None and none["comprehend"] is None and none["public_metrics"] is None
    assert empty["entities"]["url"]["display_domain"] == [] and empty["entities"]["url"]["display_url"] is None
    assert empty["entities"]["hashtag"] is None
    assert empty["context_annotations"]["domain"] == [] and empty["referenced_tweets"]["id"] == []
    assert empty["comprehend"]["entities"] is None and empty["comprehend"]["sentiment_score"]["positive"] is None


def test_flatten_values(spark):
    urls = [
        {"display_url": "a.example/1", "expanded_url": "https://a.example/1", "title": "T"},
        {"display_url": "a.example/2", "expanded_url": "https://a.example/2", "description": "D"},
        {"display_url": "b.example"},
    ]
    context = [
        {"domain": {"name": "D1"}, "entity": {"name": "E1"}},
        {"domain": {"name": "D2"}, "entity": {"name": "E1"}},
        {"domain": {"name": "D1"}, "entity": {"name": "E2"}},
    ]
    rows = state(
        spark,
        post(
            "1", entities={"urls": urls, "hashtags": [{"tag": "AbC"}, {"tag": "abc"}], "mentions": [{"username": "Bob"}]},
            context_annotations=context, geo={"place_id": "p"},
            comprehend={"normalized_text": "n", "sentiment": "POSITIVE"},
        ),
        post("2", geo={"coordinates": {"type": "Point", "coordinates": [1.5, 2.5]}}),
    )
    docs = by_id(to_document(rows))
    one = docs["1"]
    assert one["entities"]["url"]["display_domain"] == ["a.example", "b.example"]
    assert one["entities"]["url"]["expanded_url"] == ["https://a.example/1", "https://a.example/2", None]
    assert one["entities"]["url"]["title"] == ["T"] and one["entities"]["url"]["description"] == ["D"]
    assert one["entities"]["hashtag"] == ["abc", "abc"] and one["entities"]["mention"] == ["bob"]
    assert one["context_annotations"]["domain"] == ["D1", "D2"] and one["context_annotations"]["entity"] == ["E1", "E2"]
    assert one["geo"]["place_id"] == "p" and one["geo"]["coordinates"]["coordinates"] is None
    assert docs["2"]["geo"]["coordinates"]["coordinates"] == [1.5, 2.5]
    assert one["normalized_text"] == "n" and one["month"] == "2022-05" and one["created_at_year"] == "2022"
    assert one["url"].endswith("/status/1")
    assert to_document(rows).schema.names == schemas.DOCUMENT.names


def test_retweets_lose_their_counters(spark):
    kinds = {"rt": ["retweeted"], "quote": ["quoted"], "both": ["replied_to", "retweeted"], "none": None}
    rows = state(
        spark,
        *[
            post(i, public_metrics=metrics(7), **({"referenced_tweets": [{"type": t, "id": "0"} for t in k]} if k else {}))
            for i, k in kinds.items()
        ],
    )
    likes = {i: d["public_metrics"]["like_count"] for i, d in by_id(to_document(rows)).items()}
    assert likes == {"rt": 0, "quote": 7, "both": 0, "none": 7}


def test_dedupe_array_keeps_order(spark):
    row = spark.range(1).select(X.dedupe_array(F.array(*[F.lit(v) for v in "bacab"]))).first()
    assert row[0] == ["b", "a", "c"]



def test_partial_upsert(spark):
    from pyspark.sql import types as T

    versioned = T.StructType([*schemas.DOCUMENT.fields, T.StructField("version", T.LongType())])
    old = from_json(
        spark, schemas.DOCUMENT,
        {"id": "1", "month": "2022-05", "text": "old", "lang": "ja", "public_metrics": metrics(1), "entities": {"hashtag": ["a", "b"]}},
        {"id": "9", "month": "2022-05", "text": "kept"},
    )
    new = from_json(
        spark, versioned,
        {"id": "1", "month": "2022-05", "text": "new", "public_metrics": {"like_count": 5}, "entities": {"hashtag": ["c"]}, "version": 1},
        {"id": "1", "month": "2022-05", "text": "newer", "version": 2},
        {"id": "2", "month": "2022-06", "text": "x", "version": 1},
    )
    merged = by_id(upsert_documents(old, new))
    one = merged["1"]
    assert (one["text"], one["lang"]) == ("newer", "ja")
    assert one["public_metrics"].asDict() == {**metrics(1), "like_count": 5}
    assert one["entities"]["hashtag"] == ["c"] and one["geo"] is None
    assert merged["9"]["text"] == "kept" and merged["2"]["month"] == "2022-06" and len(merged) == 3
    again = by_id(upsert_documents(upsert_documents(old, new), new))
    assert again == merged


def test_merge_partial_ignores_row_order(spark):
    rows = [("k", 1, "a", None), ("k", 2, None, "b"), ("k", 3, "c", None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id STRING, version INT, x STRING, y STRING")
        assert merge_partial(df).collect()[0].asDict() == {"id": "k", "x": "c", "y": "b", "version": 3}
