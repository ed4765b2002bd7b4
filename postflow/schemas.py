"""Explicit schemas of every record; nothing is inferred, absent optional fields are simply null."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, DOUBLE, BOOLEAN, TIMESTAMP = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)
STRINGS = T.ArrayType(STRING)

POST_METRICS = _struct(retweet_count=LONG, reply_count=LONG, like_count=LONG, quote_count=LONG)
USER_METRICS = _struct(followers_count=LONG, following_count=LONG, tweet_count=LONG, listed_count=LONG)
USER = _struct(
    id=STRING, name=STRING, username=STRING, url=STRING, verified=BOOLEAN, public_metrics=USER_METRICS
)

_NAMED = _struct(id=STRING, name=STRING, description=STRING)
CONTEXT_ANNOTATIONS = T.ArrayType(_struct(domain=_NAMED, entity=_NAMED))
ENTITIES = _struct(
    annotations=T.ArrayType(_struct(normalized_text=STRING, type=STRING, probability=DOUBLE)),
    cashtags=T.ArrayType(_struct(tag=STRING)),
    hashtags=T.ArrayType(_struct(tag=STRING)),
    mentions=T.ArrayType(_struct(username=STRING, id=STRING)),
    urls=T.ArrayType(
        _struct(url=STRING, expanded_url=STRING, display_url=STRING, title=STRING, description=STRING)
    ),
)
REFERENCES = T.ArrayType(_struct(type=STRING, id=STRING))
GEO = _struct(coordinates=_struct(type=STRING, coordinates=T.ArrayType(DOUBLE)), place_id=STRING)

#: One post as the stream delivers it.
POST = _struct(
    id=STRING,
    text=STRING,
    author_id=STRING,
    conversation_id=STRING,
    created_at=STRING,
    lang=STRING,
    source=STRING,
    in_reply_to_user_id=STRING,
    possibly_sensitive=BOOLEAN,
    reply_settings=STRING,
    public_metrics=POST_METRICS,
    context_annotations=CONTEXT_ANNOTATIONS,
    entities=ENTITIES,
    referenced_tweets=REFERENCES,
    geo=GEO,
)
PLACE = _struct(
    id=STRING,
    full_name=STRING,
    contained_within=STRINGS,
    country=STRING,
    country_code=STRING,
    name=STRING,
    place_type=STRING,
)
INCLUDES = _struct(users=T.ArrayType(USER), tweets=T.ArrayType(POST), places=T.ArrayType(PLACE))
RULES = T.ArrayType(_struct(id=STRING, tag=STRING))
ERRORS = T.ArrayType(_struct(title=STRING, detail=STRING, type=STRING))

#: Bronze: one line of the stream or of the archive.
ENVELOPE = _struct(data=POST, includes=INCLUDES, matching_rules=RULES, errors=ERRORS, backup=BOOLEAN)

#: Envelope plus the bus attributes.
BUS_EVENT = T.StructType(
    [
        T.StructField("source", STRING),
        T.StructField("detail_type", STRING),
        T.StructField("event_time", TIMESTAMP),
        T.StructField("replay_name", STRING),
        *ENVELOPE.fields,
    ]
)

SCORES = _struct(positive=DOUBLE, negative=DOUBLE, neutral=DOUBLE, mixed=DOUBLE)
ANALYSIS_ENTITIES = T.ArrayType(_struct(text=STRING, type=STRING, score=DOUBLE))
#: Result of the text analysis, as silver tables hold it.
ANALYSIS = _struct(
    normalized_text=STRING, sentiment=STRING, sentiment_score=SCORES, entities=ANALYSIS_ENTITIES
)
#: The same result as its JSON form spells it.
ANALYSIS_WIRE = _struct(
    NormalizedText=STRING,
    Entities=T.ArrayType(_struct(Text=STRING, Type=STRING, Score=DOUBLE)),
    Sentiment=STRING,
    SentimentScore=_struct(Positive=DOUBLE, Negative=DOUBLE, Neutral=DOUBLE, Mixed=DOUBLE),
)

#: Silver: latest state per post.
STATE = T.StructType(
    [
        *POST.fields,
        T.StructField("updated_at", LONG),
        T.StructField("normalized_text", STRING),
        T.StructField("comprehend", ANALYSIS),
        T.StructField("author", USER),
        T.StructField("_all", STRING),
    ]
)
#: A state row as change images carry it.
IMAGE = T.StructType(
    [T.StructField(f.name, ANALYSIS_WIRE if f.name == "comprehend" else f.dataType) for f in STATE.fields]
)

CACHE = _struct(cache_key=STRING, result=ANALYSIS, expire=TIMESTAMP)

#: Gold: the flat analytics document.
DOCUMENT = _struct(
    id=STRING,
    text=STRING,
    normalized_text=STRING,
    url=STRING,
    created_at=TIMESTAMP,
    created_at_year=STRING,
    updated_at=LONG,
    lang=STRING,
    source=STRING,
    possibly_sensitive=BOOLEAN,
    reply_settings=STRING,
    conversation_id=STRING,
    in_reply_to_user_id=STRING,
    author_id=STRING,
    author=USER,
    public_metrics=POST_METRICS,
    context_annotations=_struct(domain=STRINGS, entity=STRINGS),
    entities=_struct(
        annotation=STRINGS,
        cashtag=STRINGS,
        hashtag=STRINGS,
        mention=STRINGS,
        url=_struct(
            display_domain=STRINGS,
            display_url=STRINGS,
            expanded_url=STRINGS,
            title=STRINGS,
            description=STRINGS,
        ),
    ),
    referenced_tweets=_struct(type=STRINGS, id=STRINGS),
    geo=_struct(coordinates=_struct(type=STRING, coordinates=T.ArrayType(DOUBLE)), place_id=STRING),
    comprehend=_struct(entities=STRINGS, sentiment=STRING, sentiment_score=SCORES),
    month=STRING,
)

DICTIONARY = _struct(surface=STRING, segmentation=STRING, reading=STRING, part_of_speech=STRING)
SYNONYMS = _struct(term=STRING, canonical=STRING)
