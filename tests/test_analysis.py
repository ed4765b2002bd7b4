import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import ids, post, posts
from postflow.operators import analysis as A
from postflow.operators.skew import heavy_keys, keep_matching, lookup_join, small_lookup
from postflow.session import new_shared_path

NOW = "2024-01-01 00:00:00"
SCORER = A.LexiconScorer(("good", "great"), ("bad",), {"spark": "TITLE", "node.js": "TITLE"})


def now():
    return F.lit(NOW).cast("timestamp")


def saver(spark):
    def save(df):
        path = new_shared_path(spark, "scored")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def results(df):
    return {r["id"]: r["analysis"] for r in df.select("id", "analysis").collect()}


def test_lexicon_analysis(spark):
    rows = posts(
        spark,
        post("pos", "Good GREAT good spark 2024-05-01 @bob 42", lang="en"),
        post("neg", "bad bad", lang="fr"), post("mix", "good bad", lang="ja"), post("neutral", "Node.js", lang="de"),
        post("foreign", "good", lang="th"), post("nolang", "great"), post("empty", "https://t.co/x", lang="en"), post("none", None, lang="en"),
    )
    got = results(A.analyze(rows, None, SCORER, now())[0])
    assert {i: a and a["sentiment"] for i, a in got.items()} == {
        "pos": "POSITIVE", "neg": "NEGATIVE", "mix": "MIXED", "neutral": "NEUTRAL", "foreign": None, "nolang": None, "empty": None, "none": None,
    }
    assert got["none"] is None and got["empty"]["normalized_text"] == "" and got["foreign"]["normalized_text"] == "good"
    assert sum(got["mix"]["sentiment_score"]) == pytest.approx(1)
    assert [(e["text"], e["type"]) for e in got["pos"]["entities"]] == [
        ("@bob", "PERSON"), ("2024-05-01", "DATE"), ("42", "QUANTITY"), ("spark", "TITLE")
    ]
    assert [e["text"] for e in got["neutral"]["entities"]] == ["node.js"]


def test_second_run_scores_nothing(spark):
    rows = posts(spark, post("a", "RT good", lang="en"), post("b", "good", lang="ja"), post("c", "bad", lang="en"), post("t", "x", lang="th"))
    first, cache = A.analyze(rows, None, SCORER, now(), save=saver(spark))
    cache = saver(spark)(cache)
    assert cache.count() == 2  # one key for a and b, one for c; the untranslated text is not cached
    second, more = A.analyze(rows, cache, SCORER, now(), save=saver(spark))
    assert more.count() == 0 and results(second) == results(first)
    later = F.lit("2024-01-16").cast("timestamp")
    assert A.analyze(rows, cache, SCORER, later)[1].count() == 2
    assert A.compact_cache(cache.unionByName(cache), now()).count() == 2 and A.compact_cache(cache, later).count() == 0


def test_cached_result_wins(spark):
    rows = posts(spark, post("a", "good", lang="en"))
    _, cache = A.analyze(rows, None, SCORER, now())
    changed = cache.withColumn("result", F.col("result").withField("sentiment", F.lit("CACHED")))
    assert results(A.analyze(rows, changed, SCORER, now())[0])["a"]["sentiment"] == "CACHED"


def test_pandas_scorer(spark):
    calls = spark.sparkContext.accumulator(0)

    def sentiment(texts, langs):
        calls.add(len(texts))
        return pd.DataFrame({"sentiment": "S-" + langs, "positive": texts.str.len() * 1.0, "negative": 0.0, "neutral": 0.0, "mixed": 0.0})

    def entities(texts, langs):
        return pd.Series([[{"text": t.upper(), "type": "OTHER", "score": 0.9}] for t in texts])

    def translate(texts):
        return texts.map(lambda t: None if t == "fails" else f"en {t}")

    scorer = A.PandasScorer(sentiment, entities, translate, batch_size=2, partitions=2)
    rows = posts(
        spark, post("a", "same", lang="en"), post("b", "same", lang="en"), post("c", "hola", lang="th"), post("d", "fails", lang="th"), post("e", "nolang"),
    )
    analysed, cache = A.analyze(rows, None, scorer, now(), save=saver(spark))
    got = results(analysed)
    assert calls.value == 3  # distinct texts that were translated or need no translation
    assert got["a"] == got["b"] and got["a"]["sentiment"] == "S-en" and got["a"]["entities"][0]["text"] == "SAME"
    assert got["c"]["normalized_text"] == "en hola" and got["c"]["sentiment_score"]["positive"] == 7.0
    assert got["d"]["normalized_text"] == "fails" and got["d"]["sentiment"] is None and got["d"]["entities"] is None
    assert cache.count() == 3
    again, more = A.analyze(rows, saver(spark)(cache), scorer, now(), save=saver(spark))
    assert more.count() == 0 and calls.value == 3 and results(again) == got


def test_scorer_retries():
    attempts = []

    def flaky(texts, langs):
        attempts.append(1)
        if len(attempts) < 3:
            raise OSError("busy")
        return pd.DataFrame({"sentiment": ["MIXED"], **{n: [0.25] for n in A.LABELS}})

    scorer = A.PandasScorer(flaky, lambda t, lang: pd.Series([[]]), None)
    frame = pd.DataFrame({"cache_key": ["k"], "normalized_text": ["t"], "language_code": ["en"], "posts": [1]})
    out = next(scorer._run(iter([frame])))
    assert len(attempts) == 3 and out["sentiment"][0] == "MIXED" and bool(out["ok"][0])
    none = A.PandasScorer(flaky, lambda t, lang: pd.Series([[]]), lambda texts: 1 / 0)
    foreign = frame.assign(language_code="th")
    assert not next(none._run(iter([foreign])))["ok"][0]


def test_lookup_join_spreads_hot_keys(spark):
    left = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    right = spark.range(40).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("v")).unionByName(
        spark.createDataFrame([("hot", -1), ("unused", -2)], "k STRING, v BIGINT")
    )
    assert [(r["k"], r["_salts"]) for r in heavy_keys(left, "k", rows_per_salt=100).collect()] == [("hot", 7)]
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)
        got = sorted(map(tuple, lookup_join(left, right, "k", how, rows_per_salt=100).collect()), key=repr)
        assert got == want, how
        got = [sorted(map(tuple, small_lookup(left, right, "k", how, rows=n).collect()), key=repr) for n in (10, 1000)]
        assert got == [want, want], how
    for n in (10, 1000):
        assert keep_matching(left, right, "k", rows=n).count() == left.join(right, "k", "left_semi").count()
    salted = lookup_join(left, right, "k", "left", rows_per_salt=100)
    assert salted.columns == left.join(right, "k", "left").columns
    with pytest.raises(ValueError):
        lookup_join(left, right, "k", "full_outer")


def test_distinct_texts_of_hot_copies(spark):
    rows = posts(spark, *[post(str(i), "copy  copy", lang="en" if i % 2 else "de") for i in range(50)], post("x", "other"))
    texts = {r["normalized_text"]: r for r in A.distinct_texts(A.keyed_texts(rows)).collect()}
    assert texts["copy copy"]["posts"] == 50 and texts["copy copy"]["language_code"] == "de" and len(texts) == 2
    assert ids(A.split_hits(A.lookup_cache(A.distinct_texts(A.keyed_texts(rows)), A.analyze(rows, None, SCORER, now())[1], now()))[0], "normalized_text") == ["copy copy"]
