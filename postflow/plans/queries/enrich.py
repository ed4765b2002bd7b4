"""Normalisation, content keys, analysis cache, sentiment and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from postflow import constants as K
from postflow import schemas
from postflow.functions.flatten import clean_entities as clean
from postflow.functions.keys import decode_result, encode_result
from postflow.functions.text import content_key as key_of
from postflow.functions.text import normalize_text as normalize
from postflow.functions.text import tokens
from postflow.operators.analysis import (
    LexiconScorer,
    analyze,
    compact_cache,
    distinct_texts,
    keyed_texts,
    lexicon_sentiment_table,
    lookup_cache,
    split_hits,
)
from postflow.operators.filters import route_language
from postflow.operators.state import attach_analysis as attach
from postflow.plans import bindings as B
from postflow.plans.jobs import backfill
from postflow.plans.queries.registry import POST, TOKENS, lexicon, norm, query, words

NOW = "2024-06-01 00:00:00"
SCORER = LexiconScorer(B.POSITIVE, B.NEGATIVE, B.TERMS)
DOCS = f"docs AS (SELECT doc_id, lang, {norm('text')} AS norm, coalesce(lang, 'auto') AS code FROM documents)"


def _now():
    return F.lit(NOW).cast("timestamp")


def _documents(spark, d):
    return B.table(spark, d, "documents").withColumn("id", F.col("doc_id").cast("string"))


def _cache(spark, d):
    """A first run over the labelled documents; entries of the poor ones have expired since."""
    labels = B.table(spark, d, "labels").select("doc_id", "quality")
    # the scorer gets one part of the documents per task, however few row groups the table has
    labelled = _documents(spark, d).join(labels, "doc_id").repartition("doc_id")
    texts = keyed_texts(labelled)
    days = F.when(F.col("quality") == 1, 14).otherwise(-1)
    rows = texts.withColumn("result", F.lit(None).cast(schemas.ANALYSIS)).withColumn("days", days)
    expire = _now() + F.make_interval(days=F.col("days"))
    return SCORER.score_missing(rows).where(F.col("ok") & F.col("cache_key").isNotNull()).select(
        "cache_key", "result", expire.alias("expire")
    )


_CACHED = f"""cached AS (SELECT sha256(norm) AS cache_key, max(quality) AS live
  FROM docs JOIN labels USING (doc_id) WHERE norm <> '' AND code IN ({words(K.SUPPORTED_LANGUAGES)}) GROUP BY 1)"""


@query(
    f"""SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, {norm('text')} AS normalized_text FROM documents
UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), {norm('html')} FROM pages
UNION ALL SELECT 'turn', conv_id || '-' || turn, {norm('text')} FROM conversations
UNION ALL SELECT 'item', CAST(item_id AS VARCHAR), {norm('text')} FROM benchmark"""
)
def normalize_text(spark, d):
    def rows(name, kind, key, text):
        return B.table(spark, d, name).select(
            F.lit(kind).alias("kind"), key.cast("string").alias("id"), normalize(F.col(text)).alias("normalized_text")
        )

    turn = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return (
        rows("documents", "document", F.col("doc_id"), "text")
        .unionByName(rows("pages", "page", F.col("page_id"), "html"))
        .unionByName(rows("conversations", "turn", turn, "text"))
        .unionByName(rows("benchmark", "item", F.col("item_id"), "text"))
    )


@query(f"SELECT doc_id, sha256({norm('text')}) AS cache_key FROM documents")
def content_key(spark, d):
    return B.table(spark, d, "documents").select("doc_id", key_of(normalize(F.col("text"))).alias("cache_key"))


@query(
    f"""WITH {DOCS} SELECT sha256(norm) AS cache_key, any_value(norm) AS normalized_text, min(code) AS language_code
FROM docs WHERE norm <> '' GROUP BY 1"""
)
def distinct_texts_of_documents(spark, d):
    return distinct_texts(keyed_texts(B.table(spark, d, "documents"))).drop("posts")


@query(
    f"""WITH {DOCS}, {_CACHED} SELECT DISTINCT sha256(norm) AS cache_key FROM docs
WHERE norm <> '' AND sha256(norm) IN (SELECT cache_key FROM cached WHERE live = 1)"""
)
def cache_hits(spark, d):
    texts = distinct_texts(keyed_texts(B.table(spark, d, "documents")))
    return split_hits(lookup_cache(texts, _cache(spark, d), _now()))[0].select("cache_key")


@query(
    f"""WITH {DOCS}, {_CACHED} SELECT DISTINCT sha256(norm) AS cache_key FROM docs
WHERE norm <> '' AND sha256(norm) NOT IN (SELECT cache_key FROM cached WHERE live = 1)"""
)
def cache_misses(spark, d):
    texts = distinct_texts(keyed_texts(B.table(spark, d, "documents")))
    return split_hits(lookup_cache(texts, _cache(spark, d), _now()))[1].select("cache_key")


@query(
    f"""WITH {DOCS}, {_CACHED} SELECT cache_key, TIMESTAMP '{NOW}' + INTERVAL 14 DAY AS expire FROM cached WHERE live = 1"""
)
def cache_compacted(spark, d):
    rows = compact_cache(_cache(spark, d), _now())
    return rows.select("cache_key", F.col("expire").cast("timestamp_ntz").alias("expire"))


@query(
    f"""WITH {DOCS}, {_CACHED}, {lexicon('', 'docs')}
SELECT cache_key, sentiment, TIMESTAMP '{NOW}' + INTERVAL 14 DAY AS expire FROM scored
WHERE ok AND cache_key NOT IN (SELECT cache_key FROM cached WHERE live = 1)"""
)
def cache_store(spark, d):
    """New cache rows of a run over all documents with the cache of the first run."""
    _, rows = analyze(_documents(spark, d), _cache(spark, d), SCORER, _now())
    return rows.select("cache_key", F.col("result.sentiment").alias("sentiment"), F.col("expire").cast("timestamp_ntz").alias("expire"))



def _flat(analysed):
    a = F.col("analysis")
    scores = [F.round(a["sentiment_score"][n], 9).alias(n) for n in ("positive", "negative", "neutral", "mixed")]
    return analysed.select("doc_id", a["normalized_text"].alias("normalized_text"), a["sentiment"].alias("sentiment"), *scores)


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')} SELECT doc_id, docs.norm AS normalized_text, s.sentiment, round(s.positive, 9) AS positive,
  round(s.negative, 9) AS negative, round(s.neutral, 9) AS neutral, round(s.mixed, 9) AS mixed
FROM docs LEFT JOIN scored s ON s.cache_key = sha256(docs.norm)"""
)
def analyze_default(spark, d):
    return _flat(analyze(_documents(spark, d), None, SCORER, _now())[0])


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')} SELECT doc_id, docs.norm AS normalized_text, s.sentiment, round(s.positive, 9) AS positive,
  round(s.negative, 9) AS negative, round(s.neutral, 9) AS neutral, round(s.mixed, 9) AS mixed
FROM docs LEFT JOIN scored s ON s.cache_key = sha256(docs.norm)"""
)
def analyze_warm_cache(spark, d):
    return _flat(analyze(_documents(spark, d), _cache(spark, d), SCORER, _now())[0])


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')} SELECT lang, count(*) AS documents,
  count(*) FILTER (WHERE s.sentiment = 'POSITIVE') AS positive, count(*) FILTER (WHERE s.sentiment = 'NEGATIVE') AS negative,
  count(*) FILTER (WHERE s.sentiment = 'MIXED') AS mixed, count(*) FILTER (WHERE s.sentiment = 'NEUTRAL') AS neutral,
  round(avg(s.positive), 6) AS mean_positive, round(avg(s.negative), 6) AS mean_negative
FROM docs LEFT JOIN scored s ON s.cache_key = sha256(docs.norm) GROUP BY lang"""
)
def sentiment_by_lang(spark, d):
    """Flagship: normalise, hash, distinct, score, back to the documents, aggregate."""
    a = F.col("analysis")
    analysed = analyze(_documents(spark, d), None, SCORER, _now())[0]
    names = ("POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL")
    return analysed.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.count_if(a["sentiment"] == s).alias(s.lower()) for s in names],
        F.round(F.avg(a["sentiment_score"]["positive"]), 6).alias("mean_positive"),
        F.round(F.avg(a["sentiment_score"]["negative"]), 6).alias("mean_negative"),
    )


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')} SELECT quality, toxic, s.sentiment, count(*) AS documents
FROM labels JOIN docs USING (doc_id) LEFT JOIN scored s ON s.cache_key = sha256(docs.norm) GROUP BY ALL"""
)
def sentiment_by_label(spark, d):
    analysed = analyze(_documents(spark, d), None, SCORER, _now())[0]
    labels = B.table(spark, d, "labels")
    joined = analysed.select("doc_id", F.col("analysis.sentiment").alias("sentiment")).join(labels, "doc_id")
    return joined.groupBy("quality", "toxic", "sentiment").agg(F.count(F.lit(1)).alias("documents"))


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')} SELECT cache_key, sentiment, round(positive, 9) AS positive FROM
(SELECT cache_key, CASE WHEN up > mix AND up > 1 THEN 'POSITIVE' WHEN down > mix AND down > 1 THEN 'NEGATIVE'
  WHEN mix > 1 THEN 'MIXED' ELSE 'NEUTRAL' END AS sentiment, CAST(up AS DOUBLE) / (up + down + mix + 1) AS positive FROM parts)"""
)
def sentiment_lexicon_table(spark, d):
    """The lexicon as a table instead of literals."""
    texts = distinct_texts(keyed_texts(B.table(spark, d, "documents")))
    rows = [(w, 1) for w in B.POSITIVE] + [(w, -1) for w in B.NEGATIVE]
    scored = lexicon_sentiment_table(texts, spark.createDataFrame(rows, "word STRING, polarity INT"))
    return scored.select("cache_key", "sentiment", F.round("sentiment_score.positive", 9).alias("positive"))


@query(
    f"""WITH {DOCS}, t AS (SELECT doc_id, w FROM docs, unnest(regexp_split_to_array(lower(norm), '[^\\p{{L}}\\p{{N}}_]+')) AS u(w))
SELECT docs.doc_id, coalesce(string_agg(DISTINCT w, '|' ORDER BY w), '') AS entities
FROM docs LEFT JOIN t ON t.doc_id = docs.doc_id AND w IN ({words(B.TERMS)}) GROUP BY 1"""
)
def document_entities(spark, d):
    analysed = analyze(_documents(spark, d), None, SCORER, _now())[0]
    return analysed.select("doc_id", F.array_join(F.array_sort(clean(F.col("analysis.entities"))), "|").alias("entities"))


_BENCH = f"b AS (SELECT item_id, list_filter({TOKENS.format(norm('text'))}, lambda w: w <> '') AS ws FROM benchmark)"


@query(
    f"""WITH {DOCS}, {_BENCH},
terms AS (SELECT DISTINCT phrase FROM (SELECT unnest(ws) AS phrase FROM b
  UNION ALL SELECT ws[i] || ' ' || ws[i + 1] FROM b, unnest(range(1, len(ws))) AS u(i)) x),
t AS (SELECT doc_id, list_filter({TOKENS.format('norm')}, lambda w: w <> '') AS ws FROM docs),
runs AS (SELECT DISTINCT doc_id, unnest(ws) AS phrase FROM t
  UNION SELECT doc_id, ws[i] || ' ' || ws[i + 1] FROM t, unnest(range(1, len(ws))) AS u(i)),
hits AS (SELECT doc_id, phrase FROM runs JOIN terms USING (phrase))
SELECT docs.doc_id, count(phrase) AS n_terms, count(phrase) FILTER (WHERE contains(phrase, ' ')) AS n_pairs,
  coalesce(min(phrase), '') AS first_term FROM docs LEFT JOIN hits ON hits.doc_id = docs.doc_id GROUP BY 1"""
)
def entities_of_table(spark, d):
    """Entities of a dictionary table: all words and pairs of neighbouring words of the benchmark items."""
    words = tokens(normalize(F.col("text")))
    items = B.table(spark, d, "benchmark").select(words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    single = items.select(F.explode("w").alias("term"), F.lit("WORD").alias("type"))
    dictionary = single.unionByName(items.select(F.explode(pairs).alias("term"), F.lit("PAIR").alias("type"))).distinct()
    scorer = LexiconScorer(B.POSITIVE, B.NEGATIVE, dictionary)
    analysed = analyze(_documents(spark, d), None, scorer, _now())[0]
    terms = F.filter("analysis.entities", lambda e: e["type"].isin("WORD", "PAIR"))
    texts = F.transform(terms, lambda e: e["text"])
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return analysed.select(
        "doc_id",
        F.greatest(n(terms), F.lit(0)).alias("n_terms"),
        F.greatest(n(F.filter(terms, lambda e: e["type"] == "PAIR")), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.array_min(texts), F.lit("")).alias("first_term"),
    )


@query(
    f"""{POST}, e AS (
  SELECT event_id, upper(event_type) AS text, [NULL, 'PERSON', 'QUANTITY', 'DATE'][k % 4 + 1] AS type,
         CASE WHEN k % 9 <> 0 THEN (k + 40) / 100.0 END AS score FROM post
  UNION ALL SELECT event_id, '@user', 'PERSON', 0.99 FROM post
  UNION ALL SELECT event_id, label, 'ORGANIZATION', 0.8 FROM post
  UNION ALL SELECT event_id, 'x', NULL, NULL FROM post
  UNION ALL SELECT event_id, event_type, 'OTHER', 0.79 FROM post)
SELECT event_id, coalesce(string_agg(DISTINCT lower(text), '|' ORDER BY lower(text)) FILTER (
  WHERE coalesce(type NOT IN ('QUANTITY', 'DATE'), true) AND coalesce(score >= 0.8, true) AND length(text) >= 2
    AND NOT starts_with(text, '@')), '') AS entities FROM e GROUP BY 1"""
)
def clean_entities(spark, d):
    k = F.col("k")
    kinds = F.array(F.lit(None), F.lit("PERSON"), F.lit("QUANTITY"), F.lit("DATE"))

    def entity(text, kind, score):
        return F.struct(text.alias("text"), kind.cast("string").alias("type"), score.cast("double").alias("score"))

    nothing = F.lit(None)
    found = F.array(
        entity(F.upper("event_type"), F.get(kinds, (k % 4).cast("int")), F.when(k % 9 != 0, (k + 40) / 100.0)),
        entity(F.lit("@user"), F.lit("PERSON"), F.lit(0.99)),
        entity(F.col("label"), F.lit("ORGANIZATION"), F.lit(0.8)),
        entity(F.lit("x"), nothing, nothing),
        entity(F.col("event_type"), F.lit("OTHER"), F.lit(0.79)),
    )
    return B.raw_posts(spark, d).select(
        "event_id", F.array_join(F.array_sort(clean(found)), "|").alias("entities")
    )


@query(
    f"""SELECT coalesce(lang, 'auto') AS language_code,
  CASE WHEN coalesce(lang, 'auto') IN ({words(K.SUPPORTED_LANGUAGES)}) THEN 'detect' ELSE 'translate' END AS analysis_route,
  count(*) AS posts FROM (SELECT d.lang FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id) GROUP BY 1, 2"""
)
def language_route(spark, d):
    routed = route_language(B.raw_posts(spark, d))
    return routed.groupBy("language_code", "analysis_route").agg(F.count(F.lit(1)).alias("posts"))


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')}
SELECT doc_id, s.sentiment, round(s.positive, 9) AS positive, to_base64(encode(docs.norm)) AS text_base64
FROM docs LEFT JOIN scored s ON s.cache_key = sha256(docs.norm)"""
)
def cache_value_roundtrip(spark, d):
    """Results through their stored form: Base64 of JSON, and back."""
    analysed = analyze(_documents(spark, d), None, SCORER, _now())[0]
    back = analysed.withColumn("r", decode_result(encode_result(F.col("analysis"))))
    return back.select(
        "doc_id",
        F.col("r.sentiment").alias("sentiment"),
        F.round("r.sentiment_score.positive", 9).alias("positive"),
        F.base64(F.encode("r.normalized_text", "UTF-8")).alias("text_base64"),
    )


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')}
SELECT CAST(e.event_id AS VARCHAR) AS id, docs.norm AS normalized_text, s.sentiment
FROM events e LEFT JOIN docs ON docs.doc_id = e.event_id LEFT JOIN scored s ON s.cache_key = sha256(docs.norm)"""
)
def attach_analysis(spark, d):
    rows = _documents(spark, d)
    analysed = analyze(rows, None, SCORER, _now())[0]
    results = analysed.select("id", F.col("analysis.normalized_text").alias("normalized_text"), F.col("analysis").alias("comprehend"))
    merged = attach(B.state(spark, d), results)
    return merged.select("id", "normalized_text", F.col("comprehend.sentiment").alias("sentiment"))


@query(
    f"""WITH {DOCS}, {lexicon('', 'docs')}
SELECT CAST(e.event_id AS VARCHAR) AS id, docs.norm AS normalized_text, s.sentiment
FROM events e LEFT JOIN docs ON docs.doc_id = e.event_id AND e.event_type <> 'error'
LEFT JOIN scored s ON s.cache_key = sha256(docs.norm)"""
)
def backfill_state(spark, d):
    """Changed state rows without analysis get one; rows whose change was a removal do not."""
    state = B.state(spark, d)
    removed = F.element_at("referenced_tweets", 1)["type"] == "retweeted"
    changes = state.withColumn("event_name", F.when(F.coalesce(removed, F.lit(False)), "REMOVE").otherwise("MODIFY"))
    merged, _ = backfill(changes, state, None, SCORER, _now())
    return merged.select("id", "normalized_text", F.col("comprehend.sentiment").alias("sentiment"))
