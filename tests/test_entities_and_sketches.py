import random

import pytest
from pyspark.sql import functions as F

from postflow.operators import entities, sketches
from postflow.operators.analysis import LexiconScorer, analyze


def texts(spark, *values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "cache_key STRING, normalized_text STRING")


def found(df):
    return {r.cache_key: [(e.text, e.type) for e in r.entities] for r in df.collect()}


def test_terms_are_whole_words_of_any_number(spark):
    terms = [("New York", "PLACE"), ("new", "OTHER"), ("york city", "PLACE"), ("NEW-YORK", "CITY"), ("", "X"), ("...", "X"), ("Ｎｅｗ", "OTHER")]
    dictionary = spark.createDataFrame(terms, "term STRING, type STRING")
    rows = texts(spark, "In New York, new York City", "renew yorkshire", "", "york")
    want = {"0": [("new", "OTHER"), ("new york", "CITY"), ("york city", "PLACE")]}
    assert found(entities.dictionary_entities(rows, dictionary)) == want
    assert found(entities.dictionary_entities(rows, dictionary.where("false"))) == {}


def test_too_long_terms_are_an_error(spark):
    dictionary = spark.createDataFrame([("a b c d e f g h i", "X")], "term STRING, type STRING")
    with pytest.raises(ValueError, match="8 words"):
        entities.dictionary_entities(texts(spark, "a"), dictionary)


def plan(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_large_dictionary_has_the_plan_of_a_small_one(spark):
    def dictionary(n):
        number = F.col("id").cast("string")
        return spark.range(n).select(F.concat(F.lit("term"), number).alias("term"), F.lit("T").alias("type"))

    rows = texts(spark, "term7 and term99999 and term100000", "nothing")
    small, large = (entities.dictionary_entities(rows, dictionary(n)) for n in (10, 100_000))
    assert plan(small) == plan(large) and found(small) == {"0": [("term7", "T")]}
    assert found(large) == {"0": [("term7", "T"), ("term99999", "T")]}
    # the same rows when the dictionary is too long to be sent to the texts
    few = entities.small_lookup
    try:
        entities.small_lookup = lambda *args, **options: few(*args, rows=100, **options)
        assert found(entities.dictionary_entities(rows, dictionary(100_000))) == found(large)
    finally:
        entities.small_lookup = few


def test_table_and_mapping_agree(spark):
    terms = {"good": "OTHER", "bad": "TITLE"}
    posts = spark.createDataFrame([("1", "good, bad and 2024-01-01", "en"), ("2", "nothing", "en"), ("3", "good", "xx")], "id STRING, text STRING, lang STRING")
    table = spark.createDataFrame(list(terms.items()), "term STRING, type STRING")
    results = []
    for dictionary in (terms, table):
        analysed, _ = analyze(posts, None, LexiconScorer(("good",), ("bad",), dictionary))
        results.append({r.id: sorted((e.text, e.type) for e in r.analysis.entities or []) for r in analysed.collect()})
    assert results[0] == results[1] and len(results[0]["1"]) == 4 - 1


def test_sketches_merge_to_the_whole(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), rng.choice("ab"), rng.randrange(3000), rng.randrange(10**6)) for _ in range(30_000)]
    frame = spark.createDataFrame(rows, "d INT, k STRING, who INT, v BIGINT").withColumn("t", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, d)"))
    frame = frame.unionByName(frame.limit(5).withColumn("t", F.lit(None).cast("timestamp")))
    daily = sketches.daily(frame, "t", F.col("who"), F.col("v"), ["k"])
    assert daily.count() == 40
    whole = sketches.estimated(sketches.united(daily), (0.25, 0.5, 0.99)).first()
    assert whole.n == 30_000 and abs(whole.distinct_count - len({r[2] for r in rows})) <= sketches.HLL_ERROR * 3000
    values = sorted(r[3] for r in rows)
    for p, got in ((0.25, whole.p25), (0.5, whole.p50), (0.99, whole.p99)):
        rank = sum(v <= got for v in values) / len(values)
        assert abs(rank - p) <= 2 * sketches.KLL_ERROR
    some = sketches.estimated(sketches.united(daily, ["k"], "2024-01-05", "2024-01-07"))
    assert {r.k: r.n for r in some.collect()} == {k: sum(r[0] in (4, 5) and r[1] == k for r in rows) for k in "ab"}
