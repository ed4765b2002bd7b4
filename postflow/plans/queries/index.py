"""Dashboard queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from postflow.operators import geo_index, search, sketches
from postflow.operators import query as Q
from postflow.operators.analysis import analyze
from postflow.operators.document import to_document
from postflow.plans import bindings as B
from postflow.plans import jobs
from postflow.plans.queries.enrich import SCORER
from postflow.plans.queries.registry import POST, TOKENS, lexicon, norm, query, words
from postflow.session import new_shared_path
from postflow.sinks import listing
from postflow.sinks.tables import id_bucket


def _docs(spark, d):
    """Documents of all posts."""
    return to_document(B.state(spark, d))


def _texts(spark, d):
    return B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "lang")


SYNONYMS = {"the": "le", "les": "le", "la": "le", "der": "die", "das": "die", "und": "and", "et": "and"}
_WORDS = f"w AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, t AS token FROM documents, unnest({TOKENS.format('text')}) AS u(t) WHERE t <> '')"
_LIKES = "CASE WHEN ref_kind = 'retweeted' THEN 0 ELSE likes END"


# --- filters -----------------------------------------------------------------------------------


@query(f"{POST} SELECT id FROM post WHERE lang = 'fr'")
def term_filter(spark, d):
    return Q.term_filter(_docs(spark, d), "lang", "fr").select("id")


@query(f"{POST} SELECT id FROM post WHERE dom1 = 'Sports' OR dom2 = 'Sports'")
def term_filter_multi(spark, d):
    return Q.term_filter(_docs(spark, d), "context_annotations.domain", "Sports").select("id")


@query(f"{POST} SELECT id FROM post WHERE event_type = 'error'")
def term_filter_boolean(spark, d):
    return Q.term_filter(_docs(spark, d), "possibly_sensitive", True).select("id")


@query(f"{POST} SELECT id, t AS created_at FROM post WHERE t >= TIMESTAMP '2024-01-08' AND t < TIMESTAMP '2024-01-16'")
def range_pruned(spark, d):
    rows = Q.in_range(_docs(spark, d), "2024-01-08", "2024-01-16")
    return rows.select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


_LON = "event_id % 360 - 179.5"
_LAT = "event_id % 170 - 84.75"


@query(f"{POST} SELECT id FROM post WHERE event_id % 3 = 0 AND {_LON} BETWEEN -10 AND 40 AND {_LAT} BETWEEN -20 AND 60")
def geo_box(spark, d):
    return Q.geo_box(_docs(spark, d), -10, -20, 40, 60).select("id")


@query(f"{POST} SELECT id FROM post WHERE event_id % 3 = 0 AND ({_LON} >= 170 OR {_LON} <= -170) AND {_LAT} BETWEEN -50 AND 50")
def geo_box_date_line(spark, d):
    return Q.geo_box(_docs(spark, d), 170, -50, -170, 50).select("id")


@query(
    f"""{POST} SELECT id FROM (SELECT id, radians({_LON}) AS x, radians({_LAT}) AS y FROM post WHERE event_id % 3 = 0)
WHERE 2 * 6371.0088 * asin(sqrt(least(pow(sin((y - radians(35.0)) / 2), 2)
  + cos(y) * cos(radians(35.0)) * pow(sin((x - radians(135.0)) / 2), 2), 1.0))) <= 4000"""
)
def geo_distance(spark, d):
    return Q.geo_distance(_docs(spark, d), 135.0, 35.0, 4000).select("id")


def _clustered(spark, d):
    docs, path = _docs(spark, d), new_shared_path(spark, "geo")
    geo_index.write_clustered(docs, path)
    return geo_index.read_clustered(spark, path, docs)


@query(f"{POST} SELECT id FROM post WHERE event_id % 3 = 0 AND ({_LON} >= 170 OR {_LON} <= -170) AND {_LAT} BETWEEN -50 AND 50")
def geo_box_clustered(spark, d):
    """A box across the date line over documents clustered by grid cells."""
    return geo_index.in_box(_clustered(spark, d), 170, -50, -170, 50).select("id")


@query(
    f"""{POST} SELECT id FROM (SELECT id, radians({_LON}) AS x, radians({_LAT}) AS y FROM post WHERE event_id % 3 = 0)
WHERE 2 * 6371.0088 * asin(sqrt(least(pow(sin((y - radians(35.0)) / 2), 2)
  + cos(y) * cos(radians(35.0)) * pow(sin((x - radians(135.0)) / 2), 2), 1.0))) <= 4000"""
)
def geo_distance_clustered(spark, d):
    return geo_index.within_km(_clustered(spark, d), 135.0, 35.0, 4000).select("id")


# --- facets and statistics ---------------------------------------------------------------------


@query("SELECT d.source AS key, count(*) AS doc_count FROM events e JOIN documents d ON d.doc_id = e.event_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def terms(spark, d):
    return Q.terms(_docs(spark, d), "source", 10)


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def terms_authors(spark, d):
    return Q.terms(_docs(spark, d), "author_id", 20)


@query(
    f"""{POST} SELECT key, count(*) AS doc_count FROM (SELECT event_id, lower(event_type) AS key FROM post
  UNION SELECT event_id, 'k' || (k % 10) FROM post) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
)
def terms_multi(spark, d):
    return Q.terms_multi(_docs(spark, d), "entities.hashtag", 10)


@query(
    f"""{POST} SELECT key, count(*) AS doc_count FROM (SELECT event_id, dom1 AS key FROM post UNION SELECT event_id, dom2 FROM post)
WHERE key IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
)
def terms_domains(spark, d):
    return Q.terms_multi(_docs(spark, d), "context_annotations.domain", 10)


def _ntz(df, name="bucket"):
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


@query(f"{POST} SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS bucket, count(*) AS doc_count FROM post WHERE t IS NOT NULL GROUP BY 1")
def date_histogram(spark, d):
    return _ntz(Q.date_histogram(_docs(spark, d), "day"))


@query(
    f"""{POST} SELECT CAST(date_trunc('hour', t) AS TIMESTAMP) AS bucket, lang AS key, count(*) AS doc_count FROM post
WHERE t IS NOT NULL GROUP BY 1, 2"""
)
def date_histogram_by_lang(spark, d):
    return _ntz(Q.date_histogram(_docs(spark, d), "hour", by="lang"))


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS bucket, o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1, 2")
def date_histogram_of_orders(spark, d):
    return _ntz(Q.date_histogram(B.table(spark, d, "orders"), "month", by="o_orderpriority", time="o_orderdate"))


_STATS = """count(x) AS value_count, CAST(sum(x) AS BIGINT) AS value_sum, round(avg(x), 6) AS value_avg, min(x) AS value_min,
  max(x) AS value_max, quantile_disc(x, 0.5) AS p50, quantile_disc(x, 0.95) AS p95"""


@query(f"{POST} SELECT lang AS key, {_STATS} FROM (SELECT lang, {_LIKES} AS x FROM post) GROUP BY 1")
def metric_stats(spark, d):
    stats = Q.metric_stats(_docs(spark, d), "public_metrics.like_count", by="lang")
    return stats.withColumn("value_avg", F.round("value_avg", 6))


@query(
    """SELECT l_returnflag AS key, count(l_quantity) AS value_count, sum(l_quantity) AS value_sum, round(avg(l_quantity), 6) AS value_avg,
  min(l_quantity) AS value_min, max(l_quantity) AS value_max FROM lineitem GROUP BY 1"""
)
def metric_stats_of_lineitems(spark, d):
    stats = Q.metric_stats(B.table(spark, d, "lineitem"), "l_quantity", by="l_returnflag", percentiles=())
    return stats.withColumn("value_avg", F.round("value_avg", 6))


@query("SELECT count(DISTINCT user_id) AS value FROM events")
def cardinality(spark, d):
    return Q.cardinality(_docs(spark, d), "author_id", exact=True)


@query(
    f"""{POST}, src AS (SELECT t, {norm('text')} AS norm, coalesce(lang, 'auto') AS code FROM post), {lexicon('', 'src')}
SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS bucket, count(*) FILTER (WHERE sentiment = 'POSITIVE') AS positive,
  count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS negative, count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS neutral,
  count(*) FILTER (WHERE sentiment = 'MIXED') AS mixed, round(avg(s.positive), 6) AS mean_positive, round(avg(s.negative), 6) AS mean_negative
FROM src JOIN scored s ON s.cache_key = sha256(src.norm) WHERE t IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1"""
)
def sentiment_over_time(spark, d):
    analysed, _ = analyze(B.state(spark, d), None, SCORER)
    docs = to_document(analysed.withColumn("comprehend", F.col("analysis")))
    rows = _ntz(Q.sentiment_over_time(docs, "day"))
    return rows.withColumns({f"mean_{n}": F.round(f"mean_{n}", 6) for n in ("positive", "negative")})


@query(f"{POST} SELECT id, strftime(t, '%Y-%m') AS month FROM post WHERE year(t) = 2024 AND text IS NOT NULL")
def reindex_year(spark, d):
    """The job over a written state table and its time listing: documents of one year."""
    house = _state_house(spark, d)
    jobs.reindex_year(house, spark, "2024", "reindex.2024")
    return house.gold.read(spark).select("id", "month")


def _state_house(spark, d):
    house = jobs.Warehouse(new_shared_path(spark, "warehouse"), buckets=16)
    state = B.state(spark, d)
    house.state.write(state.withColumn("bucket", id_bucket(F.col("id"), house.buckets)), "state.0")
    listing.rebuild(spark, house.times, house.state)
    return house


@query(f"{POST} SELECT id, created_at, text FROM post WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-15'")
def state_range_listed(spark, d):
    """State rows of some days, of the buckets that the time listing names."""
    house = _state_house(spark, d)
    found = listing.in_listed_buckets(house.state.read(spark), house.times.read(spark), "2024-01-05", "2024-01-15")
    return found.select("id", "created_at", "text")


@query(
    f"""{POST} SELECT id, created_at FROM post WHERE t IS NOT NULL AND (created_at > '2024-01-10' OR (created_at = '2024-01-10' AND id > '0'))
ORDER BY created_at, id LIMIT 50"""
)
def next_page_listed(spark, d):
    """A page over time from the listing alone."""
    house = _state_house(spark, d)
    return listing.listed_page(house.times.read(spark), ("2024-01-10", "0"), 50)


# --- text --------------------------------------------------------------------------------------


@query(f"WITH {_WORDS} SELECT DISTINCT id FROM w WHERE token IN ('tz', 'chou', 'there')")
def match_any(spark, d):
    return search.match(_texts(spark, d), "text", "tz chou there").select("id")


@query(f"WITH {_WORDS} SELECT id FROM w WHERE token IN ('the', 'by', 'that') GROUP BY 1 HAVING count(*) = 3")
def match_all(spark, d):
    return search.match(_texts(spark, d), "text", "the by that", op="all").select("id")


@query(f"WITH {_WORDS} SELECT id FROM w WHERE token IN ('thing', 'that') GROUP BY 1 HAVING count(*) = 2")
def match_stop_words(spark, d):
    """Stop words of the query are dropped like those of the documents."""
    return search.match(_texts(spark, d), "text", "The thing, that", op="all", stop_words=["the"]).select("id")


@query(f"WITH {_WORDS} SELECT id FROM w WHERE token IN ('the', 'that') GROUP BY 1 HAVING count(*) = 2")
def match_apostrophe(spark, d):
    """A query is split where documents are."""
    return search.match(_texts(spark, d), "text", "the'that", op="all").select("id")


@query(f"WITH {_WORDS} SELECT DISTINCT id FROM w WHERE token = 'that'")
def match_full_width(spark, d):
    """Full-width letters of a query find plain ones."""
    return search.match(_texts(spark, d), "text", "ＴＨＡＴ").select("id")


@query(f"WITH {_WORDS} SELECT id FROM w WHERE token IN ('thing', 'that') GROUP BY 1 HAVING count(*) = 2")
def index_search_written(spark, d):
    """The same analysis against an index that was written and read by buckets."""
    path = new_shared_path(spark, "inverted-index")
    search.write_index(search.build_inverted_index(_texts(spark, d), "text", stop_words=["the"]), path)
    return search.search_index(spark.read.parquet(path), "The THING's: ｔｈａｔ", op="all", stop_words=["the", "s"])


@query(f"WITH {_WORDS} SELECT token, count(*) AS doc_count FROM w GROUP BY 1")
def inverted_index(spark, d):
    """Document frequencies out of the inverted table."""
    index = search.build_inverted_index(_texts(spark, d), "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("doc_count"))


@query(f"WITH {_WORDS} SELECT id FROM w WHERE token IN ('the', 'that') GROUP BY 1 HAVING count(*) = 2")
def index_search_all(spark, d):
    index = search.build_inverted_index(_texts(spark, d), "text")
    return search.search_index(index, "the that", op="all")


_CANON = f"CASE token {' '.join(f'WHEN {words([a])} THEN {words([b])}' for a, b in SYNONYMS.items())} ELSE token END"


@query(f"WITH {_WORDS} SELECT {_CANON} AS token, count(*) AS rows FROM w GROUP BY 1")
def synonym_terms(spark, d):
    """Tokens mapped to the first term of their group."""
    rows = search.build_inverted_index(_texts(spark, d), "text").select("id", "token")
    synonyms = spark.createDataFrame(list(SYNONYMS.items()), "term STRING, canonical STRING")
    return search.canonical_terms(rows, synonyms).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {_WORDS} SELECT DISTINCT id FROM w WHERE {_CANON} IN ('le', 'and')")
def index_search_synonyms(spark, d):
    synonyms = spark.createDataFrame(list(SYNONYMS.items()), "term STRING, canonical STRING")
    index = search.build_inverted_index(_texts(spark, d), "text", synonyms=synonyms)
    return search.search_index(index, ["the", "et"], synonyms=SYNONYMS)


@query(f"WITH {_WORDS} SELECT token AS key, count(*) AS doc_count FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def token_freq(spark, d):
    return search.token_freq(_texts(spark, d), "text", 25)


@query(
    f"""SELECT key, count(*) AS doc_count FROM (SELECT DISTINCT page_id, t AS key FROM (
  SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages), unnest({TOKENS.format('title')}) AS u(t)
  WHERE t <> '') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"""
)
def token_freq_of_titles(spark, d):
    titles = B.links(spark, d).select("id", F.transform("urls", lambda u: u["title"]).alias("title"))
    return search.token_freq(titles, "title", 25)


@query(f"WITH t AS (SELECT DISTINCT conv_id, turn, t AS key FROM conversations, unnest({TOKENS.format('text')}) AS u(t) WHERE t <> '') SELECT key, count(*) AS doc_count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def token_freq_of_threads(spark, d):
    return search.token_freq(B.thread_posts(spark, d), "text", 25)


@query(
    """WITH e AS (SELECT event_type AS key, user_id, CAST(floor(value) AS BIGINT) AS v FROM events WHERE ts IS NOT NULL)
SELECT key, count(*) AS n, true AS distinct_close, true AS p50_close, true AS p95_close FROM e GROUP BY 1"""
)
def daily_sketches(spark, d):
    """Sketches per day, event type and user group, written and united by event type, against the exact numbers.

    A quantile is close if the rows below it and up to it enclose its rank within the stated error."""
    rows = B.table(spark, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), (F.col("user_id") % 7).alias("user_group"), "user_id", F.floor("value").alias("v")
    )
    path = new_shared_path(spark, "sketches")
    sketches.daily(rows, "ts", F.col("user_id"), F.col("v"), ["key", "user_group"]).write.parquet(path)
    found = sketches.estimated(sketches.united(spark.read.parquet(path), ["key"]), (0.5, 0.95))
    with_estimates = rows.join(found, "key")
    error = 2 * sketches.KLL_ERROR

    def enclosed(name, share):
        below, upto = F.count_if(F.col("v") < F.col(name)), F.count_if(F.col("v") <= F.col(name))
        return ((below <= (share + error) * F.count("*")) & (upto >= (share - error) * F.count("*"))).alias(f"{name}_close")

    exact = F.count_distinct("user_id")
    close = F.abs(F.first("distinct_count") - exact) <= sketches.HLL_ERROR * exact
    return with_estimates.groupBy("key").agg(F.first("n").alias("n"), close.alias("distinct_close"), enclosed("p50", 0.5), enclosed("p95", 0.95))
