"""Registry, and the SQL fragments that mirror the bindings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from postflow import constants as K
from postflow.plans import bindings as B
from postflow.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir.rstrip("/"))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return run

    return register


def words(values) -> str:
    """SQL list of text literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(col: str) -> str:
    """SQL form of the text normalisation."""
    replaced = f"regexp_replace(regexp_replace({col}, '{K.RETWEET_PREFIX_PATTERN}', ''), '{K.URL_PATTERN}', '', 'g')"
    for entity, char in K.HTML_UNESCAPES:
        replaced = f"replace({replaced}, '{entity}', '{char}')"
    return f"rtrim(regexp_replace({replaced}, '{K.WHITESPACE_PATTERN}', ' ', 'g'), ' ')"


TOKENS = "regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+')"

CREATED = """CASE WHEN event_id % 50 = 49 THEN NULL WHEN event_id % 50 = 48 THEN 'not a time'
  WHEN event_id % 20 = 7 THEN '2019' || substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'), 5)
  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END"""

#: The post binding as a chain of CTEs; ``post.t`` is the parsed time.
POST = f"""WITH raw AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS k,
         d.text, d.lang, d.source AS label
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id),
post AS (
  SELECT *, CAST(event_id AS VARCHAR) AS id, TRY_CAST(created_at AS TIMESTAMP) AS t FROM (
    SELECT raw.*, {CREATED} AS created_at,
      CASE event_type WHEN 'error' THEN 'retweeted' WHEN 'purchase' THEN 'quoted' WHEN 'click' THEN 'replied_to' END AS ref_kind,
      CASE WHEN k % 5 <> 0 THEN [{words(B.DOMAINS)}][k % 7 + 1] END AS dom1,
      CASE WHEN k % 5 <> 0 THEN [{words(B.DOMAINS)}][(k * 3 + 1) % 7 + 1] END AS dom2,
      CASE WHEN k % 5 <> 0 THEN 'entity' || (k % 11) END AS ent1,
      CASE WHEN k % 5 <> 0 THEN 'entity' || (k % 4) END AS ent2,
      CAST(floor(value) AS BIGINT) AS likes,
      CASE WHEN event_type IN ('signup', 'error') THEN 'IncludedTweet' ELSE 'Tweet' END AS detail_type
    FROM raw) x)
"""

DENIED = words(K.DENIED_CONTEXT_DOMAINS)
#: None of the post's annotations is denied.
NONE_DENIED = f"(dom1 IS NULL OR (dom1 NOT IN ({DENIED}) AND dom2 NOT IN ({DENIED})))"

#: Conversation turns as posts.
THREAD = """WITH thread AS (
  SELECT conv_id || '-' || turn AS id, conv_id, turn, role, text FROM conversations),
refs AS (
  SELECT id AS carrier, 0 AS pos, conv_id || '-' || (turn - 1) AS id FROM thread WHERE turn > 0
  UNION ALL SELECT id, 1, conv_id || '-0' FROM thread WHERE turn > 1),
found AS (SELECT r.carrier, r.pos, t.id, t.role, t.text FROM refs r JOIN thread t ON t.id = r.id)
"""


def lexicon(prefix: str, source: str) -> str:
    """CTEs ``{prefix}scored``: one row per distinct text of ``source (norm, code)`` with its analysis."""
    return f"""{prefix}keys AS (SELECT sha256(norm) AS cache_key, any_value(norm) AS norm, min(code) AS code
  FROM {source} WHERE norm <> '' GROUP BY 1),
{prefix}counts AS (SELECT k.cache_key,
    count(*) FILTER (WHERE w IN ({words(B.POSITIVE)})) AS pos, count(*) FILTER (WHERE w IN ({words(B.NEGATIVE)})) AS neg
  FROM {prefix}keys k, unnest({TOKENS.format('k.norm')}) AS u(w) GROUP BY 1),
{prefix}parts AS (SELECT k.cache_key, k.norm, k.code IN ({words(K.SUPPORTED_LANGUAGES)}) AS ok,
    greatest(pos - neg, 0) AS up, greatest(neg - pos, 0) AS down, 2 * least(pos, neg) AS mix
  FROM {prefix}keys k JOIN {prefix}counts c USING (cache_key)),
{prefix}scored AS (SELECT cache_key, norm, ok,
    CASE WHEN NOT ok THEN NULL WHEN up > mix AND up > 1 THEN 'POSITIVE' WHEN down > mix AND down > 1 THEN 'NEGATIVE'
         WHEN mix > 1 THEN 'MIXED' ELSE 'NEUTRAL' END AS sentiment,
    CASE WHEN ok THEN CAST(up AS DOUBLE) / (up + down + mix + 1) END AS positive,
    CASE WHEN ok THEN CAST(down AS DOUBLE) / (up + down + mix + 1) END AS negative,
    CASE WHEN ok THEN CAST(1 AS DOUBLE) / (up + down + mix + 1) END AS neutral,
    CASE WHEN ok THEN CAST(mix AS DOUBLE) / (up + down + mix + 1) END AS mixed
  FROM {prefix}parts)"""
