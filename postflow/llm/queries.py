"""The registered queries of the corpus operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from postflow.llm import (
    centroids,
    circulant_minhash,
    decontaminate,
    filter_audit,
    html_text,
    license_scan,
    line_dedup,
    ngram_join,
    oracles,
    packing,
    pii_surrogates,
    quality_rules,
    substring_dedup,
    token_counts,
)
from postflow.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a corpus that is given away takes its key from outside the code
    secret = os.environ.get("POSTFLOW_PII_KEY", "public example key")
    replaced = pii_surrogates.replace(read(spark, sf_dir, "documents"), secret)
    return replaced.select("doc_id", "n_entities", "text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


#: The counts as plain SQL; the sketch as counts by bucket, merged by language and over all rows for small groups.
QUALITY_MEASURES = r"""
d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) x WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM starts),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) x WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS t(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    3 * CAST(len(regexp_extract_all(text, '\p{Lu}{3}')) AS BIGINT) AS caps,
    CAST(coalesce(lines.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(lines.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN covered ON covered.doc_id = w.doc_id),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbol_rate,
    coalesce(1000 * caps // nullif(word_chars, 0), 0) AS caps_rate,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS dup_line_rate,
    coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_length FROM base),
vals AS (SELECT lang, source, 'symbol_rate' AS measure, 60 AS spread, symbol_rate AS v FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'caps_rate', 100, caps_rate FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_line_rate', 150, dup_line_rate FROM m WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', 1, word_length FROM m WHERE NOT base_failed),
buckets AS (SELECT lang, source, measure, spread, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b FROM vals),
own AS (SELECT lang, source, measure, count(*) AS n, any_value(spread) AS spread, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM buckets GROUP BY ALL),
bylang AS (SELECT lang, measure, count(*) AS n, any_value(spread) AS spread, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM buckets GROUP BY ALL),
whole AS (SELECT measure, count(*) AS n, any_value(spread) AS spread, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM buckets GROUP BY ALL),
chosen AS (SELECT o.lang, o.source, o.measure, o.spread,
    CASE WHEN o.n >= 200 THEN o.q1 WHEN l.n >= 200 THEN l.q1 ELSE g.q1 END AS q1,
    CASE WHEN o.n >= 200 THEN o.q3 WHEN l.n >= 200 THEN l.q3 ELSE g.q3 END AS q3
  FROM own o JOIN bylang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN whole g ON o.measure = g.measure),
limits AS (SELECT lang, source,
    max(CASE measure WHEN 'symbol_rate' THEN q3 + 3 * greatest(q3 - q1, spread, q1 // 8) END) AS symbol_high,
    max(CASE measure WHEN 'caps_rate' THEN q3 + 3 * greatest(q3 - q1, spread, q1 // 8) END) AS caps_high,
    max(CASE measure WHEN 'dup_line_rate' THEN q3 + 3 * greatest(q3 - q1, spread, q1 // 8) END) AS dup_high,
    max(CASE measure WHEN 'word_length' THEN q3 + 3 * greatest(q3 - q1, spread, q1 // 8) END) AS length_high,
    max(CASE measure WHEN 'word_length' THEN q1 - 3 * greatest(q3 - q1, spread, q1 // 8) END) AS length_low
  FROM chosen GROUP BY lang, source),
verdict AS (SELECT m.*, coalesce(NOT base_failed AND symbol_rate <= symbol_high AND caps_rate <= caps_high AND dup_line_rate <= dup_high
    AND word_length <= length_high AND word_length >= length_low, false) AS kept
  FROM m LEFT JOIN limits ON m.lang IS NOT DISTINCT FROM limits.lang AND m.source IS NOT DISTINCT FROM limits.source)"""


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Windows of at most 4096 ids of the lower-case word vocabulary, each document ended by id 2."""
    model = Path(tokenizer_path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return packing.pack(docs, partial(packing.word_encoder, model), end=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.load_sentencepiece(tokenizer_path("piece_bpe_32k.model"))
    counted = token_counts.with_token_counts(read(spark, sf_dir, "documents"), vocabulary)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).select("doc_id", "licenses", "sentence_ids", "unmatched")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace(license_scan.CUT, "' || chr(1) || '") + "'"


def license_sql() -> str:
    """The same cuts, tables and rules as SQL."""
    cut = "coalesce(text, '')"
    for pattern, replacement in (license_scan.ABBREVIATED, *license_scan.CUTTING):
        cut = f"regexp_replace({cut}, {_quoted(pattern)}, {_quoted(re.sub(r'[$]([0-9])', lambda m: chr(92) + m[1], replacement))}, 'g')"
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.identifiers().items())
    named = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.names().items())
    steps, licenses = "", []
    for k, (name, rule) in enumerate(license_scan.RULES):
        sequence = _quoted(f"|{'||'.join(rule)}|")
        steps += f", s{k + 1} AS (SELECT *, replace(l{k}, {sequence}, '') AS l{k + 1} FROM s{k})"
        licenses.append(f"CASE WHEN contains(l{k}, {sequence}) THEN {_quoted(name)} END")
    n = len(license_scan.RULES)
    return f"""WITH cut AS (SELECT doc_id, string_split({cut}, chr(1)) AS parts FROM documents WHERE regexp_matches(text, {_quoted(license_scan.HINT)})),
parts AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, trim(regexp_replace(lower(unnest(parts)), '[^a-z0-9]+', ' ', 'g')) AS s FROM cut),
known(s, id) AS (VALUES {known}), named(s, id) AS (VALUES {named}),
hits AS (SELECT p.doc_id, p.i, coalesce(k.id, n.id) AS id FROM parts p LEFT JOIN known k ON k.s = p.s
  LEFT JOIN named n ON n.s = concat(regexp_extract(p.s, {_quoted(license_scan.NAMING)}, 1), regexp_extract(p.s, {_quoted(license_scan.NAMING)}, 2))
  WHERE coalesce(k.id, n.id) IS NOT NULL),
found AS (SELECT doc_id, string_agg(id, '|' ORDER BY i) AS ids FROM hits GROUP BY doc_id),
s0 AS (SELECT doc_id, ids, '|' || replace(ids, '|', '||') || '|' AS l0 FROM found){steps},
taken AS (SELECT doc_id, ids, l{n} AS rest, unnest([{", ".join(licenses)}]) AS name, unnest(range({n})) AS turn FROM s{n}),
firsts AS (SELECT doc_id, name, min(turn) AS turn FROM taken WHERE name IS NOT NULL GROUP BY doc_id, name),
joined AS (SELECT doc_id, string_agg(name, '|' ORDER BY turn) AS licenses FROM firsts GROUP BY doc_id),
rests AS (SELECT DISTINCT doc_id, ids, trim(replace(rest, '||', '|'), '|') AS rest FROM taken)
SELECT d.doc_id, coalesce(j.licenses, '') AS licenses, coalesce(r.ids, '') AS sentence_ids, coalesce(r.rest, '') AS unmatched
FROM documents d LEFT JOIN rests r ON r.doc_id = d.doc_id LEFT JOIN joined j ON j.doc_id = d.doc_id"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_html_text": op8_html_text,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_circulant_minhash": op12_circulant_minhash,
    "op13_centroids": op13_centroids,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": f"""WITH {QUALITY_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict""",
    "op9_license_scan": license_sql(),
    "op11_filter_audit": oracles.FILTER_AUDIT_SQL,
    "op13_centroids": oracles.CENTROID_SQL,
}
