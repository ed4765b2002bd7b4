import base64
import hashlib
import json
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postflow import constants as K
from postflow import schemas
from postflow.functions import keys
from postflow.functions import text as X
from postflow.operators.analysis import analysis_struct


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "t STRING")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


NORMALIZED = [
    ("RT @a: x &amp;lt; https://t.co/q?a=1&amp;b  y", "@a: x &lt; y"),
    ("RT RT x", "RT x"),
    ("rt x RT ", "rt x RT"),
    ("a\nb\r\n\tc", "a b c"),
    ("　a  b﻿", " a b"),
    (" lead and end  ", " lead and end"),
    ("https://example.com/a?b=c#d", ""),
    ("&lt;b&gt; &quot;", "<b> &quot;"),
    ("a\u0085b", "a\u0085b"),
    ("see http://x.y/é!", "see é!"),
    ("😀 ok", "😀 ok"),
    ("", ""),
    (None, None),
]


def test_normalize_text(spark):
    got = values(spark, X.normalize_text, [a for a, _ in NORMALIZED])
    assert got == [b for _, b in NORMALIZED]


JS_SPACE = "\t\n\x0b\x0c\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab.é語😀\u0085᠎​" + JS_SPACE)), min_size=20, max_size=40))
def test_collapse_space_is_the_wide_white_space(spark, texts):
    def expected(text):
        out = []
        for char in text:
            if char not in JS_SPACE:
                out.append(char)
            elif not out or out[-1] != " ":
                out.append(" ")
        return "".join(out).rstrip(" ")

    assert values(spark, X.collapse_space, texts) == [expected(t) for t in texts]


def test_content_key_and_utf16_length(spark):
    assert values(spark, X.content_key, ["été"]) == [hashlib.sha256("été".encode()).hexdigest()]
    assert values(spark, X.utf16_length, ["a", "😀", "語", ""]) == [1, 2, 1, 0]


def test_fold_width(spark):
    assert values(spark, X.fold_width, ["ＡＢｃ１", "ｶﾞｰﾊﾟｱ", "plain"]) == ["ABc1", "ガーパア", "plain"]


def test_tokens_keep_dictionary_terms(spark):
    terms = ["node.js", "機械学習", "学習", "web3", "web3.0", "api gateway"]
    rows = ["Node.js と機械学習の本, ＷＥＢ3.0!", "mynode.js web3 API Gateway", "naïve_test É"]
    got = values(spark, lambda c: X.tokens(c, dictionary=terms), rows)
    assert got[0] == ["node.js", "機械学習", "web3.0", "と", "の本"]
    assert sorted(got[1]) == ["api gateway", "js", "mynode", "web3"]
    assert got[2] == ["naïve_test", "é"]


def test_tokens_stop_words(spark):
    assert values(spark, lambda c: X.tokens(c, stop_words=["the"]), ["The cat the"]) == [["cat"]]


def test_day_parts_and_keys(spark):
    rows = ["2022-05-01T23:59:59.999Z", "2022-12-31T23:59:59", "2022-05-01", "bad", None]
    df = spark.createDataFrame([(r,) for r in rows], "t STRING")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in keys.day_parts(F.col("t")).items()]).collect()]
    assert got == [("2022", "05", "01"), ("2022", "12", "31"), (None,) * 3, (None,) * 3, (None,) * 3]
    assert values(spark, keys.year_key, ["2022-05-01T00:00:00Z"]) == ["2022"]
    assert values(spark, keys.permalink, ["9"]) == ["https://twitter.com/0/status/9"]
    assert values(spark, keys.repair_key, ["a/year%3D2022/x%3D"]) == ["a/year=2022/x="]
    assert values(spark, keys.file_identity, ["s3/p/dictionary.txt", "x"]) == ["dictionary", "x"]
    assert values(spark, lambda c: keys.index_name(keys.month_key(keys.to_time(c))), ["2022-05-01T00:00:00Z"]) == [
        "tweets-2022-05"
    ]


def test_epoch_seconds_floors_and_defaults(spark):
    now = F.lit("1970-01-01 00:00:09").cast("timestamp")
    got = values(spark, lambda c: keys.epoch_seconds(keys.to_time(c), now), ["1969-12-31T23:59:59.500Z", None])
    assert got == [-1, 9]


def test_expiry(spark):
    row = spark.range(1).select(keys.expire_at(F.lit("2024-01-01").cast("timestamp"), 14).cast("string")).first()
    assert row[0] == "2024-01-15 00:00:00"


@pytest.mark.parametrize("with_scores", [True, False])
def test_result_encoding(spark, with_scores):
    scores = F.struct(*[F.lit(0.25).alias(n) for n in ("positive", "negative", "neutral", "mixed")])
    entities = F.array(F.struct(F.lit("x" * 90).alias("text"), F.lit("OTHER").alias("type"), F.lit(0.9).alias("score")))
    result = analysis_struct(F.lit("hi"), F.lit("MIXED"), scores, entities) if with_scores else analysis_struct(F.lit("hi"))
    row = spark.range(1).select(
        keys.encode_result(result).alias("v"), keys.decode_result(keys.encode_result(result)).alias("r"), result.alias("o")
    ).first()
    assert "\r\n" not in row["v"]
    wire = json.loads(base64.b64decode(row["v"]))
    assert wire["NormalizedText"] == "hi" and ("Sentiment" in wire) == with_scores
    assert row["r"] == row["o"]
    assert spark.range(1).select(result.cast(schemas.ANALYSIS)).schema[0].dataType == schemas.ANALYSIS


def test_plain_texts_need_no_patterns(spark):
    blanks = [" ", "\n", *K.ASCII_BLANKS, *K.OTHER_BLANKS]
    assert all(re.fullmatch(r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]", c) for c in blanks)
    rng = random.Random(3)
    parts = [*blanks, " ", "\n", "a", "é", "漢", "😀", "\u200b", "\x85", "\x1c", "RT ", "&amp;", "&lt;", "http://x/y", "https://", "http", "."]
    texts = [None, "", " ", "\n", "RT ", " a\n\n b \n", "é  b\n", "a b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", X.normalize_text(F.col("t")).alias("a"), X.by_patterns(F.col("t")).alias("b"), X.is_plain(F.col("t")).alias("plain"))
    rows = rows.collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    plain = {r.t for r in rows if r.plain}
    assert {" a\n\n b \n", "é  b\n", "a b"} <= plain and not any(c in t for t in plain for c in ("&", "http", *blanks[2:]))
