import pytest
from pyspark.sql import functions as F

from helpers import from_json, ids, metrics
from postflow import schemas
from postflow.operators import query as Q
from postflow.operators import search
from postflow.operators.metrics import counted, filtered_rate, summary, write_stats
from postflow.session import new_shared_path
from postflow.sources.lists import default_synonyms, dictionary_terms


@pytest.fixture(scope="module")
def docs(spark):
    def doc(i, text, month="2022-05", day=1, **fields):
        return {"id": i, "text": text, "month": month, "created_at": f"{month}-{day:02}T01:00:00.000Z", "public_metrics": metrics(day), **fields}

    def at(lon, lat):
        return {"geo": {"coordinates": {"type": "Point", "coordinates": [lon, lat]}}}

    return from_json(
        spark,
        schemas.DOCUMENT,
        doc("1", "Kubernetes on a server", lang="en", entities={"hashtag": ["a", "a", "b"], "url": {"title": ["Big Data", "data"]}}, **at(179.9, 0)),
        doc("2", "K8s サーバーレス入門", lang="ja", day=2, entities={"hashtag": ["a"]}, comprehend={"sentiment": "POSITIVE", "sentiment_score": {"positive": 0.5}}, **at(-179.9, 0)),
        doc("3", "machine learning", lang="en", month="2022-06", day=3, **at(0, 0)),
        doc("4", "nothing", month="2022-07", day=4, comprehend={"sentiment": "MIXED"}),
    ).cache()


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_facets(docs):
    assert pairs(Q.terms(docs, "lang")) == [("en", 2), ("ja", 1)] and pairs(Q.terms(docs, "lang", 1)) == [("en", 2)]
    assert pairs(Q.terms_multi(docs, "entities.hashtag")) == [("a", 2), ("b", 1)]
    assert pairs(search.token_freq(docs, "entities.url.title")) == [("big", 1), ("data", 1)]
    assert Q.cardinality(docs, "lang", exact=True).first()[0] == 2 and Q.cardinality(docs, "id").first()[0] == 4
    assert ids(Q.term_filter(docs, "entities.hashtag", "b")) == ["1"] and ids(Q.term_filter(docs, "comprehend.sentiment", "MIXED")) == ["4"]
    for field in Q.NOT_FILTERABLE:
        with pytest.raises(ValueError):
            Q.term_filter(docs, field, "x")


def test_numbers(docs):
    row = Q.metric_stats(docs, "public_metrics.like_count").first().asDict()
    assert row == {"value_count": 4, "value_sum": 10, "value_avg": 2.5, "value_min": 1, "value_max": 4, "p50": 2, "p95": 4}
    by_day = {str(r["bucket"])[:7]: r["doc_count"] for r in Q.date_histogram(docs, "month").collect()}
    assert by_day == {"2022-05": 2, "2022-06": 1, "2022-07": 1}
    mood = {str(r["bucket"])[:10]: (r["positive"], r["mixed"], r["mean_positive"]) for r in Q.sentiment_over_time(docs).collect()}
    assert mood == {"2022-05-02": (1, 0, 0.5), "2022-07-04": (0, 1, None)}


def test_percentiles_are_exact(spark):
    # 20 summary entries cannot tell neighbouring values apart
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").alias("lang"), (F.col("id") * 7919 % 20_011).alias("x"))
    rows = rows.unionByName(spark.sql("SELECT 'b' AS lang, CAST(NULL AS BIGINT) AS x"))
    got = {r["key"]: (r["value_count"], r["p50"], r["p95"]) for r in Q.metric_stats(rows, "x", by="lang", accuracy=20).collect()}
    for key, first in (("a", 0), (None, 1)):
        values = sorted(i * 7919 % 20_011 for i in range(first, 20_000, 2))
        assert got[key] == (10_000, values[4_999], values[9_499])
    assert got["b"] == (0, None, None)
    whole = sorted(i * 7919 % 20_011 for i in range(20_000))
    assert Q.metric_stats(rows, "x", accuracy=20).first()["p95"] == whole[18_999]


def test_range_prunes_months(docs, spark):
    path = new_shared_path(spark, "gold")
    docs.write.partitionBy("month").parquet(path)
    rows = Q.in_range(spark.read.schema(docs.schema).parquet(path), "2022-05-02", "2022-06-30")
    assert ids(rows) == ["2", "3"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(created_at)" in plan


def test_geo(docs):
    assert ids(Q.geo_box(docs, 170, -10, -170, 10)) == ["1", "2"] and ids(Q.geo_box(docs, -10, -10, 10, 10)) == ["3"]
    assert ids(Q.geo_distance(docs, 180.0, 0.0, 50)) == ["1", "2"] and ids(Q.geo_distance(docs, 0.1, 0.0, 10)) == []


def test_match(docs, spark):
    terms = dictionary_terms()
    assert ids(search.match(docs, "text", "kubernetes nothing")) == ["1", "4"]
    assert ids(search.match(docs, "text", "server kubernetes", op="all")) == ["1"]
    assert ids(search.match(docs, "text", ["machine learning"], dictionary=terms)) == ["3"]
    assert ids(search.match(docs, "text", ["サーバーレス"], dictionary=terms)) == ["2"] and ids(search.match(docs, "text", ["サーバーレス"])) == []
    assert ids(search.match(docs, "entities.url.title", "big data", op="all")) == ["1"]
    with pytest.raises(ValueError):
        search.match(docs, "text", "x", op="none")


def test_written_index_with_synonyms(docs, spark):
    synonyms = default_synonyms(spark)
    index = search.build_inverted_index(docs, "text", dictionary_terms(), synonyms=synonyms)
    path = new_shared_path(spark, "index")
    search.write_index(index, path)
    stored = spark.read.parquet(path)
    mapping = {r["term"]: r["canonical"] for r in synonyms.collect()}
    assert ids(search.search_index(stored, "k8s", synonyms=mapping)) == ["1", "2"]
    assert ids(search.search_index(stored, ["k8s", "サーバレス"], op="all", synonyms=mapping)) == ["2"]
    assert ids(search.search_index(stored, ["ml"], synonyms=mapping)) == ["3"]
    plan = search.search_index(stored, "k8s", synonyms=mapping)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_counters(docs):
    observed, numbers = counted(docs, "load", **write_stats(docs, F.col("lang").isNull()))
    observed.write.format("noop").mode("overwrite").save()
    assert numbers.get == {"incoming": 4, "total": 4, "failed": 1, "successful": 3}
    assert summary({"b": 1, "a": 2}) == "a=2 b=1"
    assert filtered_rate(docs, F.col("lang") == "en").first()[0] == 50.0
    assert filtered_rate(docs.where("false"), F.lit(True)).first()[0] is None


def test_queries_are_analysed_like_documents(spark):
    docs = spark.createDataFrame([("1", "The cat"), ("2", "a cat, don't"), ("3", "ＡＷＳ cloud")], "id STRING, text STRING")
    assert ids(search.match(docs, "text", "the cat", op="all", stop_words=["the"])) == ["1", "2"]
    assert ids(search.match(docs, "text", "don't", op="all")) == ["2"]
    assert ids(search.match(docs, "text", "AWS")) == ids(search.match(docs, "text", "ａｗｓ")) == ["3"]
    index = search.build_inverted_index(docs, "text", stop_words=["the"])
    assert ids(search.search_index(index, "the cat", op="all", stop_words=["the"])) == ["1", "2"]
    assert ids(search.search_index(index, "don't", op="all")) == ["2"]
    for op in ("any", "all"):
        for empty in ("", " , ", []):
            assert ids(search.match(docs, "text", empty, op=op)) == []
            assert ids(search.search_index(index, empty, op=op)) == []
