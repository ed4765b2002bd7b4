import itertools

from pyspark.sql import functions as F

from helpers import by_id, from_json, ids, metrics, post
from postflow import schemas
from postflow.operators import state as S
from postflow.sources.lists import scan_state_by_year

ARRIVING = "id STRING, updated_at BIGINT, likes BIGINT, arrival BIGINT"


def state(spark, *objects):
    return from_json(spark, schemas.STATE, *objects)


def updates(spark, *rows):
    df = spark.createDataFrame(rows, ARRIVING)
    zero = F.lit(0).cast("bigint")
    values = {"like_count": F.col("likes")}
    fields = [values.get(n, zero).alias(n) for n in schemas.POST_METRICS.names]
    return df.select("id", F.struct(*fields).alias("public_metrics"), "updated_at", "arrival")


def likes(df):
    return {r["id"]: (r["updated_at"], r["public_metrics"]["like_count"]) for r in df.collect()}


def test_merge_metrics(spark):
    stored = state(
        spark,
        *[post(i, updated_at=10, public_metrics=metrics(1)) for i in ("older", "equal", "newer", "untouched")],
        post("unversioned", public_metrics=metrics(1)),
        {"id": "stub", "updated_at": 10},
    )
    batch = updates(
        spark, ("older", 9, 9, 0), ("equal", 10, 9, 1), ("newer", 11, 9, 2), ("missing", 5, 9, 3), ("unversioned", 99, 9, 4),
        ("stub", 12, 9, 5), ("twice", 7, 70, 6), ("twice", 8, 80, 7), ("tie", 7, 1, 8), ("tie", 7, 2, 9),
    )
    merged, is_new = S.merge_metrics(stored, batch)
    assert likes(merged.where("public_metrics is not null")) == {
        "older": (10, 1), "equal": (10, 1), "newer": (11, 9), "untouched": (10, 1), "unversioned": (None, 1),
        "missing": (5, 9), "stub": (12, 9), "twice": (8, 80), "tie": (7, 1),
    }
    assert ids(is_new) == ["missing", "stub", "tie", "twice"]
    assert by_id(merged)["newer"]["text"] == "hello world"
    again, none_new = S.merge_metrics(merged, batch)
    assert likes(again.where("public_metrics is not null")) == likes(merged.where("public_metrics is not null"))
    assert ids(none_new) == []


def test_merge_metrics_ignores_row_order(spark):
    rows = [("a", 1, 1, 0), ("a", 3, 3, 1), ("a", 2, 2, 2), ("b", 5, 5, 3)]
    results = []
    for order in itertools.islice(itertools.permutations(rows), 0, 24, 7):
        merged, _ = S.merge_metrics(state(spark, post("b", updated_at=4)), updates(spark, *order))
        results.append(likes(merged))
    assert all(r == {"a": (3, 3), "b": (5, 5)} for r in results)


def test_put_rows(spark):
    stored = state(spark, post("a", text="old", updated_at=50, lang="ja"), post("z", text="kept"))
    batch = state(spark, post("a", text="late", updated_at=1), post("b", text="first"), post("b", text="second"))
    stamped = batch.withColumn("arrival", F.monotonically_increasing_id())
    rows = by_id(S.put_rows(stored, stamped))
    assert {i: r["text"] for i, r in rows.items()} == {"a": "late", "b": "second", "z": "kept"}
    assert rows["a"]["updated_at"] == 1 and rows["a"]["lang"] is None


def test_attach_analysis(spark):
    stored = state(spark, post("a"), post("b", normalized_text="kept"))
    results = state(
        spark, post("a", normalized_text="n", comprehend={"sentiment": "MIXED"}), post("ghost", normalized_text="n")
    ).select("id", "normalized_text", "comprehend")
    rows = by_id(S.attach_analysis(stored, results))
    assert sorted(rows) == ["a", "b"] and rows["a"]["comprehend"]["sentiment"] == "MIXED" and rows["b"]["normalized_text"] == "kept"


def test_empty_text_becomes_null(spark):
    row = S.empty_to_null(state(spark, post("a", source="", text=""))).first()
    assert row["source"] is None and row["text"] is None


def test_pages_cover_everything(spark):
    rows = state(spark, *[post(f"{i:03}", created_at=f"2022-05-0{i % 4 + 1}T00:00:00.000Z") for i in range(25)]).cache()
    seen, after = [], None
    while True:
        page = S.next_page(rows.select("id", "created_at"), after, n=10).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["id"])
    listing = [r["id"] for r in S.time_listing(rows).collect()]
    assert seen == listing and len(set(seen)) == 25
    assert ids(S.time_keys(rows)) == []


def test_scan_state_by_year(spark):
    rows = state(spark, post("a", created_at="2021-12-31T23:59:59Z"), post("b"), post("c", created_at="2022-bad"), post("d", created_at=None))
    assert ids(scan_state_by_year(rows, "2022")) == ["b"]
