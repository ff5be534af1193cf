"""Signed model sentiment and the fusion of two sentiment sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewire.functions.scoring import rescale_confidence

# The names a decision is recorded under.
AGREEMENT = "HYBRID_AGREEMENT"
API_WINS = "MARKETAUX_DOMINANT"
MODEL_WINS = "FINBERT_DOMINANT"
API_ONLY = "MARKETAUX_ONLY"
MODEL_ONLY = "FINBERT_FALLBACK"
NOTHING = "NO_SENTIMENT"


def signed_sentiment(label: Column, score: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(low == "positive", score)
        .when(low == "negative", -score)
        .when(label.isNotNull(), F.lit(0.0))
    )


def fuse_sentiment(
    api: Column, api_conf: Column, model: Column, model_conf: Column, rescale_first: bool = False
) -> Column:
    """Struct of ``sentiment``, ``confidence`` and ``sentiment_source``.

    The vendor's confidence is a raw match score that may exceed 100 beside a
    model confidence in 0..1; ``rescale_first`` brings it to that scale first.
    """
    if rescale_first:
        api_conf = rescale_confidence(api_conf)
    both = api.isNotNull() & model.isNotNull()
    agree = both & (api * model >= 0) & (F.abs(api - model) < 0.5)

    def weight(c: Column) -> Column:
        return F.when(c.isNull() | (c == 0), F.lit(0.5)).otherwise(c)

    wa, wm = weight(api_conf), weight(model_conf)
    model_stronger = F.coalesce(model_conf, F.lit(0.0)) > F.coalesce(api_conf, F.lit(0.0))

    def pick(sentiment: Column, confidence: Column, source: str) -> Column:
        return F.struct(
            sentiment.alias("sentiment"),
            confidence.alias("confidence"),
            F.lit(source).alias("sentiment_source"),
        )

    unknown = F.lit(None).cast("double")
    return (
        F.when(agree, pick((api * wa + model * wm) / (wa + wm), (wa + wm) / 2, AGREEMENT))
        .when(both & model_stronger, pick(model, model_conf, MODEL_WINS))
        .when(both, pick(api, api_conf, API_WINS))
        .when(api.isNotNull(), pick(api, api_conf, API_ONLY))
        .when(model.isNotNull(), pick(model, model_conf, MODEL_ONLY))
        .otherwise(pick(unknown, unknown, NOTHING))
    )
