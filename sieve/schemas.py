"""Explicit schemas: no source infers types, and a pid is always text."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


TOPIC = _struct(topic_id=_s, topic_title=_s, topic_objective=_s)
JUDGMENT = _struct(topic_id=_s, pid=_s, relevance=T.IntegerType())
ARTICLE = _struct(pid=_s, title=_s, abstract=_s)

# Column names and order of the CSV files exchanged with other tools (fixed values).
ARTICLES_CSV = _struct(PMID=_s, ArticleTitle=_s, Abstract=_s)
CHUNK_CSV = _struct(PID=_s, title=_s, abstract=_s)
SAMPLED_CSV = _struct(
    topic_id=_s, topic_title=_s, topic_objective=_s, PID=_s, relevance=T.IntegerType(),
    article_title=_s, abstract=_s,
)
GRADED_CSV = _struct(topic_id=_s, PID=_s, relevance=T.IntegerType(), title=_s, abstract=_s)

TOKEN_SCORE = _struct(token=_s, value=T.DoubleType())
EXPLANATION = _struct(
    tokens=T.ArrayType(_s),
    scores=T.ArrayType(T.ArrayType(T.DoubleType())),
    classes=T.ArrayType(_s),
)
EXPLAINED_ARTICLE = _struct(
    title=_s, abstract=_s, verdict=_s, title_expl=EXPLANATION, abstract_expl=EXPLANATION
)
VERDICT_EVENT = _struct(
    topic_id=_s, article_id=_s, verdict=_s, ts=T.TimestampType(), event_id=T.LongType()
)
