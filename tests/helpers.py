"""Hand-made envelopes: JSON objects with only the fields a case needs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from postflow import schemas


def from_json(spark, schema, *objects):
    rows = [(json.dumps(o),) for o in objects]
    parsed = spark.createDataFrame(rows, "j STRING").select(F.from_json("j", schema).alias("r"))
    return parsed.select("r.*")


def posts(spark, *objects):
    return from_json(spark, schemas.POST, *objects)


def envelopes(spark, *objects):
    return from_json(spark, schemas.ENVELOPE, *objects)


def post(post_id, text="hello world", created_at="2022-05-01T12:34:56.000Z", **fields):
    return {"id": post_id, "text": text, "created_at": created_at, **fields}


def envelope(data, users=None, tweets=None, rules=({"id": "r1", "tag": "t"},), **fields):
    includes = {k: v for k, v in (("users", users), ("tweets", tweets)) if v is not None}
    return {"data": data, "includes": includes, "matching_rules": list(rules), **fields}


def metrics(likes):
    return {"retweet_count": 1, "reply_count": 2, "like_count": likes, "quote_count": 3}


def column(df, name):
    return [r[name] for r in df.select(F.col(name).alias(name)).collect()]


def ids(df, name="id"):
    return sorted(r[0] for r in df.select(F.col(name).alias("v")).collect())


def by_id(df):
    return {r["id"]: r for r in df.collect()}
