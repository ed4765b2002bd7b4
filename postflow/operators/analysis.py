"""Text analysis behind a content-hash cache.

posts -> normalised text -> one row per distinct text -> cache lookup -> score the misses -> back to the posts.
A text is scored once however many posts carry it, and texts whose result is cached are not scored at all.
"""

from __future__ import annotations

import random
import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow import constants as K
from postflow import schemas
from postflow.functions.keys import expire_at
from postflow.functions.text import content_key, normalize_text, tokens
from postflow.operators import filters
from postflow.operators.entities import dictionary_entities
from postflow.operators.skew import heavy_of, lookup_join, small_lookup

LABELS = ("positive", "negative", "neutral", "mixed")


# --- scorers -------------------------------------------------------------------------------------


def analysis_struct(
    normalized: Column, sentiment: Column | None = None, scores: Column | None = None, entities: Column | None = None
) -> Column:
    """The analysis result; everything but the text may be absent."""
    nothing = F.lit(None)
    parts = (normalized, *(nothing if c is None else c for c in (sentiment, scores, entities)))
    fields = schemas.ANALYSIS.fields
    return F.struct(*[p.cast(f.dataType).alias(f.name) for p, f in zip(parts, fields)])


def sentiment_of(pos: Column, neg: Column) -> tuple[Column, Column]:
    """``(sentiment, scores)`` from the number of positive and negative words.

    The surplus of one side, twice the balanced part (mixed) and one (neutral) share the score of one.
    """
    up, down, mixed = F.greatest(pos - neg, F.lit(0)), F.greatest(neg - pos, F.lit(0)), 2 * F.least(pos, neg)
    total = (up + down + mixed + 1).cast("double")
    sentiment = (
        F.when((up > mixed) & (up > 1), "POSITIVE")
        .when((down > mixed) & (down > 1), "NEGATIVE")
        .when(mixed > 1, "MIXED")
        .otherwise("NEUTRAL")
    )
    shares = {"positive": up / total, "negative": down / total, "neutral": 1 / total, "mixed": mixed / total}
    return sentiment, F.struct(*[shares[n].alias(n) for n in LABELS])


def lexicon_sentiment_table(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same scores against a lexicon *table* ``(word, polarity)`` of any size, one row per ``cache_key``.

    Words are counted per text before they meet the lexicon, and the sums combine before they move.
    """
    words = texts.select("cache_key", F.explode(tokens(F.col("normalized_text"))).alias("word"))
    polarity = lexicon.groupBy("word").agg(F.min("polarity").alias("polarity"))
    hits = small_lookup(words, polarity, "word", "inner", spread=[F.col("cache_key")])
    sums = hits.groupBy("cache_key").agg(
        F.count_if(F.col("polarity") > 0).alias("_pos"), F.count_if(F.col("polarity") < 0).alias("_neg")
    )
    joined = texts.select("cache_key").join(sums, "cache_key", "left")
    pos, neg = (F.coalesce(F.col(c), F.lit(0)) for c in ("_pos", "_neg"))
    sentiment, scores = sentiment_of(pos, neg)
    return joined.select("cache_key", sentiment.alias("sentiment"), scores.alias("sentiment_score"))


def pattern_entities(text: Column, words: Column, dictionary: Mapping[str, str]) -> Column:
    """Default entity detection: mentions, ISO dates, numbers, and the ``dictionary`` terms among ``words``.

    ``dictionary`` maps a term to its entity type.
    """

    def tagged(found: Column, kind: str, score: float) -> Column:
        return F.transform(
            found, lambda t: F.struct(t.alias("text"), F.lit(kind).alias("type"), F.lit(score).alias("score"))
        )

    def matches(pattern: str, kind: str, score: float) -> Column:
        return tagged(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), kind, score)

    # most characters are no digits, which is seen faster than what stands before them
    groups = [
        matches(r"@\w+", "PERSON", 0.99),
        matches(r"(?=\d)(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])", "DATE", 0.99),
        matches(r"(?=\d)(?<![\w-])\d+(?![\w-])", "QUANTITY", 0.9),
    ]
    by_kind: dict[str, list[str]] = {}
    for term, kind in dictionary.items():
        by_kind.setdefault(kind, []).append(term)
    for kind, terms in by_kind.items():
        hits = F.array_intersect(words, F.array(*[F.lit(t.lower()) for t in terms]))
        groups.append(tagged(hits, kind, 0.95))
    return F.concat(*groups)


@dataclass(frozen=True)
class LexiconScorer:
    """Built-in scorer made of column expressions. Languages that need a translation get no analysis."""

    positive: Sequence[str]
    negative: Sequence[str]
    #: Terms and their types: a mapping becomes part of the plan; a table (term, type) of any size is joined.
    dictionary: Mapping[str, str] | DataFrame | None = None

    def score_missing(self, texts: DataFrame) -> DataFrame:
        """Fills ``result`` where it is null and adds ``ok``: whether this run made a full result.

        Column by column, because an expression that is used twice would be computed twice.
        """
        miss = F.col("result").isNull()
        table = self.dictionary if isinstance(self.dictionary, DataFrame) else None
        mapping = (self.dictionary if table is None else None) or {}
        words = tokens(F.col("normalized_text"), dictionary=mapping)
        staged = texts.withColumn("ok", miss & filters.is_supported_language(F.col("language_code")))
        staged = staged.withColumn("_words", F.when(F.col("ok"), words))
        staged = staged.withColumns(
            {
                "_pos": F.size(F.filter("_words", lambda w: w.isin(*self.positive))),
                "_neg": F.size(F.filter("_words", lambda w: w.isin(*self.negative))),
                "_entities": F.when(
                    F.col("ok"),
                    pattern_entities(F.col("normalized_text"), F.col("_words"), mapping),
                ),
            }
        )
        if table is not None:
            named = dictionary_entities(texts.where(miss), table).withColumnRenamed("entities", "_named")
            staged = staged.join(named, "cache_key", "left").withColumn(
                "_entities", F.when(F.col("_named").isNull(), F.col("_entities")).otherwise(F.concat("_entities", "_named"))
            )
            staged = staged.drop("_named")
        sentiment, scores = sentiment_of(F.col("_pos"), F.col("_neg"))
        full = analysis_struct(F.col("normalized_text"), sentiment, scores, F.col("_entities"))
        result = F.when(F.col("ok"), full).when(miss, analysis_struct(F.col("normalized_text")))
        filled = staged.withColumn("result", result.otherwise(F.col("result")))
        return filled.drop("_words", "_pos", "_neg", "_entities")


@dataclass(frozen=True)
class PandasScorer:
    """User-supplied models, run on Arrow batches of distinct uncached texts.

    ``sentiment(texts, langs)`` returns a frame with columns sentiment, positive, negative, neutral, mixed;
    ``entities(texts, langs)`` a series of lists of ``{text, type, score}``; ``translate(texts)`` a series of
    English texts (null or an exception: not translated).

    A task has at most ``in_flight`` batches with the models at once, and holds no more; ``partitions`` bounds the tasks,
    so the two bound all calls. A call that fails is tried again after a pause that doubles from ``pause`` to
    ``longest_pause`` seconds, each shortened by a share that depends on the batch and the attempt, so that batches that
    failed together do not come back together and a repeated task waits alike.
    """

    sentiment: Callable[[pd.Series, pd.Series], pd.DataFrame]
    entities: Callable[[pd.Series, pd.Series], pd.Series]
    translate: Callable[[pd.Series], pd.Series] | None = None
    batch_size: int = 100
    partitions: int | None = None
    detect_retries: int = K.DETECT_RETRIES
    translate_retries: int = K.TRANSLATE_RETRIES
    in_flight: int = 10
    pause: float = 0.5
    longest_pause: float = 30.0

    def score(self, misses: DataFrame) -> DataFrame:
        """``(cache_key, normalized_text, language_code, posts)`` to ``(cache_key, result, ok, posts, attempts)``: how many
        calls of models the row's batch took."""
        rows = misses.select("cache_key", "normalized_text", "language_code", "posts")
        if self.partitions:
            rows = rows.repartition(self.partitions, "cache_key")
        flat = rows.mapInPandas(self._run, self._FLAT)
        scores = F.struct(*[F.col(n) for n in LABELS])
        result = analysis_struct(F.col("normalized_text"), F.col("sentiment"), scores, F.col("entities"))
        only_text = analysis_struct(F.col("normalized_text"))
        scored = F.when(F.col("ok"), result).otherwise(only_text).alias("result")
        return flat.select("cache_key", scored, "ok", "posts", "attempts")

    _FLAT = (
        "cache_key STRING, normalized_text STRING, sentiment STRING, positive DOUBLE, negative DOUBLE, "
        "neutral DOUBLE, mixed DOUBLE, entities ARRAY<STRUCT<text: STRING, type: STRING, score: DOUBLE>>, ok BOOLEAN, posts BIGINT, attempts BIGINT"
    )

    def _run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (batch.iloc[i : i + self.batch_size].reset_index(drop=True) for batch in batches for i in range(0, len(batch), self.batch_size))
        with ThreadPoolExecutor(self.in_flight) as pool:
            running: deque[Future] = deque()
            try:
                for part in parts:
                    if len(running) == self.in_flight:
                        yield running.popleft().result()
                    running.append(pool.submit(self._score_batch, part))
                while running:
                    yield running.popleft().result()
            finally:
                # after a failure nothing more is started
                for waiting in running:
                    waiting.cancel()

    def _score_batch(self, pdf: pd.DataFrame) -> pd.DataFrame:
        calls = _Calls(self.pause, self.longest_pause, str(pdf["cache_key"].iloc[0]))
        text, lang = pdf["normalized_text"].copy(), pdf["language_code"].copy()
        foreign = ~lang.isin(K.SUPPORTED_LANGUAGES)
        ok = ~foreign
        if foreign.any() and self.translate is not None:
            try:
                english = calls.retried(self.translate, self.translate_retries, text[foreign].reset_index(drop=True))
            except Exception:  # the batch is kept, without analysis
                english = pd.Series([None] * int(foreign.sum()), dtype=object)
            english.index = text.index[foreign]
            done = english[english.notna()]
            text.loc[done.index] = done
            lang.loc[done.index] = K.TRANSLATION_LANGUAGE
            ok.loc[done.index] = True
        out = pd.DataFrame({"cache_key": pdf["cache_key"], "normalized_text": text})
        empty = {"sentiment": None, **{n: None for n in LABELS}, "entities": None}
        for name, value in empty.items():
            out[name] = pd.Series([value] * len(out), dtype=object if name in ("sentiment", "entities") else float)
        good = ok[ok].index
        if len(good):
            texts, langs = text[good].reset_index(drop=True), lang[good].reset_index(drop=True)
            found = calls.retried(self.entities, self.detect_retries, texts, langs)
            mood = calls.retried(self.sentiment, self.detect_retries, texts, langs)
            for name in ("sentiment", *LABELS):
                out.loc[good, name] = mood[name].to_numpy()
            out.loc[good, "entities"] = pd.Series(list(found), index=good, dtype=object)
        out["ok"] = ok
        out["posts"] = pdf["posts"]
        out["attempts"] = calls.made
        return out


class _Calls:
    """Calls of models for one batch, with their number."""

    def __init__(self, pause: float, longest: float, seed: str) -> None:
        self.pause, self.longest, self.seed, self.made = pause, longest, seed, 0

    def retried(self, call: Callable, retries: int, *args):
        for attempt in range(retries + 1):
            self.made += 1
            try:
                return call(*args)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(self.wait(attempt))

    def wait(self, attempt: int) -> float:
        """Half of the doubled pause and a share of the other half."""
        whole = min(self.longest, self.pause * 2**attempt)
        return whole * (0.5 + 0.5 * random.Random(f"{self.seed}:{self.made}").random())


# --- cache -----------------------------------------------------------------------------------------


def keyed_texts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds ``normalized_text``, ``language_code`` and ``cache_key``; no key where there is nothing to analyse."""
    norm = normalize_text(F.col(text))
    with_text = df.withColumns(
        {"normalized_text": norm, "language_code": F.coalesce(F.col(lang), F.lit(K.DEFAULT_LANGUAGE))}
    )
    key = F.when(F.col("normalized_text") != "", content_key(F.col("normalized_text")))
    return with_text.withColumn("cache_key", key)


def distinct_texts(keyed: DataFrame) -> DataFrame:
    """One row per key, with the number of ``posts`` that have it.

    The key ignores the language, so of several languages the first by name is used. The conditions stand on
    aggregated values on purpose: on the key they would move below the aggregation and normalise every text
    twice (rows without a key are one group that is dropped here), and they keep all columns alive, so that
    every use of this frame has the same shuffle and Spark runs it once.
    """
    groups = keyed.groupBy(F.col("cache_key").alias("_group")).agg(
        F.any_value("cache_key").alias("cache_key"),
        F.any_value("normalized_text").alias("normalized_text"),
        F.min("language_code").alias("language_code"),
        F.count(F.lit(1)).alias("posts"),
    )
    kept = (F.col("normalized_text") != "") & F.col("language_code").isNotNull() & (F.col("posts") > 0)
    return groups.where(kept).drop("_group")


def valid_cache(cache: DataFrame, now: Column) -> DataFrame:
    """Unexpired entries, one per key (appends may repeat a key)."""
    live = cache.where(F.col("expire") > now)
    return live.groupBy("cache_key").agg(F.max_by("result", "expire").alias("result"))


def lookup_cache(texts: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``texts`` (one row per key) with ``result``, null for a miss."""
    # only entries that are asked for are compared with each other; the rest of the cache is not aggregated
    asked = cache.where(F.col("expire") > now).join(texts.select("cache_key"), "cache_key", "left_semi")
    return texts.join(valid_cache(asked, now), "cache_key", "left")


def split_hits(looked_up: DataFrame) -> tuple[DataFrame, DataFrame]:
    hit = F.col("result").isNotNull()
    return looked_up.where(hit), looked_up.where(~hit)


def cache_rows(scored: DataFrame, now: Column, days: int = K.CACHE_DAYS) -> DataFrame:
    """Cache entries of freshly scored texts; results without analysis are not cached."""
    return scored.where("ok").select("cache_key", "result", expire_at(now, days).alias("expire"))


def compact_cache(cache: DataFrame, now: Column) -> DataFrame:
    """Drops expired and repeated entries."""
    live = cache.where(F.col("expire") > now)
    newest = live.groupBy("cache_key").agg(F.max_by(F.struct("result", "expire"), "expire").alias("_row"))
    return newest.select("cache_key", "_row.*")


# --- the job ---------------------------------------------------------------------------------------


def analyze(
    df: DataFrame,
    cache: DataFrame | None,
    scorer: LexiconScorer | PandasScorer,
    now: Column | None = None,
    days: int = K.CACHE_DAYS,
    text: str = "text",
    lang: str = "lang",
    save: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``analysis``, and the rows to append to the cache.

    Empty text gives a result of nothing but the (empty) text, as does a failed translation; missing text gives
    null. Pass ``save`` (writes the scored texts and reads them back) wherever scoring is expensive: the two
    results share the scored texts, and only a saved table is sure not to be computed twice.
    """
    now = F.current_timestamp() if now is None else now
    keyed = keyed_texts(df, text, lang)
    looked_up = distinct_texts(keyed)
    if cache is not None:
        looked_up = lookup_cache(looked_up, cache, now)
    else:
        looked_up = looked_up.withColumn("result", F.lit(None).cast(schemas.ANALYSIS))
    if isinstance(scorer, LexiconScorer):
        per_key = scorer.score_missing(looked_up).select("cache_key", "result", "ok", "posts")
        per_key = fresh = save(per_key) if save else per_key
    else:
        hits, misses = split_hits(looked_up)
        fresh = scorer.score(misses)
        fresh = save(fresh) if save else fresh
        per_key = hits.select("cache_key", "result", "posts").unionByName(
            fresh.select("cache_key", "result", "posts")
        )
    # the counts that name the hot texts: from the saved table, or from the aggregation above
    counts = per_key if save else distinct_texts(keyed)
    heavy = heavy_of(counts, "cache_key", "posts")
    results = per_key.select("cache_key", "result")
    joined = lookup_join(keyed, results, "cache_key", "left", heavy=heavy, spread=_spread(df))
    empty = F.when(F.col("normalized_text") == "", analysis_struct(F.col("normalized_text")))
    analysed = joined.withColumn("analysis", F.coalesce("result", empty)).select(*df.columns, "analysis")
    return analysed, cache_rows(fresh, now, days)


def _spread(df: DataFrame) -> list[Column] | None:
    return [F.col("id")] if "id" in df.columns else None
