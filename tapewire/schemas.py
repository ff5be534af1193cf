"""Explicit schemas.  Nothing is inferred: JSON integers occur where doubles are meant."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_TEXT, _NUM, _TEXTS = StringType(), DoubleType(), ArrayType(StringType())

ENTITY = _struct(symbol=_TEXT, name=_TEXT, sentiment_score=_NUM, match_score=_NUM)

# One article as the news vendor lands it, and the response object around it.
RAW_ARTICLE = _struct(
    title=_TEXT, description=_TEXT, snippet=_TEXT, published_at=_TEXT, source=_TEXT,
    url=_TEXT, image_url=_TEXT, entities=ArrayType(ENTITY),
)
RAW_RESPONSE = _struct(data=ArrayType(RAW_ARTICLE))

# One line of the archive, and one published message.
PAYLOAD = _struct(
    doc_id=_TEXT, title=_TEXT, description=_TEXT, content=_TEXT, sentiment=_NUM,
    confidence=_NUM, sentiment_source=_TEXT, publishedAt=_TEXT, source=_TEXT, link=_TEXT,
    image_url=_TEXT, symbols=_TEXTS, entity_names=_TEXTS, category=_TEXT,
    key_phrases=_TEXT, summary=_TEXT,
)

# The 18 fields the scoring stage reads out of a message.
MESSAGE = _struct(
    title=_TEXT, description=_TEXT, content=_TEXT, publishedAt=_TEXT, source=_TEXT,
    sentiment=_NUM, confidence=_NUM, risk_score=_NUM, link=_TEXT, image_url=_TEXT,
    key_phrases=_TEXT, category=_TEXT, summary=_TEXT, impact_assessment=_TEXT,
    content_quality=_TEXT, symbols=_TEXTS, entity_names=_TEXTS, doc_id=_TEXT,
)

# The 24 scored columns, in this order.
SCORED = _struct(
    title=_TEXT, description=_TEXT, content=_TEXT, publishedAt=LongType(), source=_TEXT,
    sentiment=_NUM, confidence=_NUM, conf_norm=_NUM, risk_level=_TEXT, risk_raw=_NUM,
    risk_adj=_NUM, key_phrases=_TEXT, category=_TEXT, summary=_TEXT,
    impact_assessment=_TEXT, impact_score=_NUM, final_score=_NUM,
    sentiment_confidence_score=_NUM, content_quality=_TEXT, symbol=_TEXT,
    entity_name=_TEXT, link=_TEXT, image_url=_TEXT, doc_id=_TEXT,
)

METRIC_EVENT = _struct(
    event_id=LongType(), pipeline=_TEXT, ts=TimestampType(), latency_ms=_NUM, status=IntegerType(),
)
MODEL_SCORE = _struct(doc_id=_TEXT, label=_TEXT, score=_NUM)
KEYWORD = _struct(category=_TEXT, keyword=_TEXT)
