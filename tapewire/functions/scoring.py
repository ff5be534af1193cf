"""Risk, impact and composite score as Column expressions.

All of them are plain arithmetic and ``when`` chains, so a whole scoring pass is
one projection over the scan, in batch and in a stream alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewire.fixed_values import IMPACT_SCORES, LOW_RISK_BASE, RISK_BASE


def rescale_confidence(c: Column) -> Column:
    return F.when(c > 1.0, c / 100.0).otherwise(c)


def conf_norm(c: Column, clamp: bool = False) -> Column:
    """``ln(1 + c) / ln 2``, 0 for null and for values up to 0.  Not bounded by 1."""
    value = F.when(c.isNull() | (c <= 0), F.lit(0.0)).otherwise(F.log1p(c) / F.lit(math.log(2.0)))
    return F.least(value, F.lit(1.0)) if clamp else value


def risk_level(sentiment: Column, alarm: Column, deal: Column) -> Column:
    """``alarm``: a risk or commodity word occurs; ``deal``: a deal word occurs.

    The numeric test stands first: it decides most rows, and the text scan behind
    it is skipped for them.
    """
    return (
        F.when((sentiment < 0) & alarm, F.lit("high_risk"))
        .when((sentiment > 0.2) & deal, F.lit("medium_risk"))
        .when(sentiment < 0, F.lit("moderate_risk"))
        .otherwise(F.lit("low_risk"))
    )


def risk_base(level: Column) -> Column:
    chain = F
    for name, value in RISK_BASE.items():
        chain = chain.when(level == name, F.lit(value))
    return chain.otherwise(F.lit(LOW_RISK_BASE))


def risk_adjusted(base: Column, norm: Column) -> Column:
    return base * 0.8 + base * norm * 0.2


def impact_from_sentiment(sentiment: Column, confidence: Column) -> Column:
    return (
        F.when(confidence < 0.2, "NEUTRAL")
        .when(sentiment >= 0.7, "BULLISH")
        .when(sentiment >= 0.4, "POSITIVE")
        .when(sentiment >= 0.1, "SLIGHTLY POSITIVE")
        .when(sentiment <= -0.7, "BEARISH")
        .when(sentiment <= -0.4, "NEGATIVE")
        .when(sentiment <= -0.1, "SLIGHTLY NEGATIVE")
        .otherwise("NEUTRAL")
    )


def impact_overlay(risk_raw: Column, sentiment: Column, impact: Column) -> Column:
    return (
        F.when((risk_raw >= 0.8) & (sentiment < 0), "HIGH RISK")
        .when((risk_raw >= 0.8) & (sentiment >= 0), "RISKY BULLISH")
        .when((risk_raw >= 0.5) & (sentiment < 0), "MODERATE RISK")
        .otherwise(impact)
    )


def impact_score(impact: Column) -> Column:
    chain = F
    for name, value in IMPACT_SCORES.items():
        chain = chain.when(impact == name, F.lit(value))
    return chain.otherwise(F.lit(0.0))


def final_score(impact: Column, norm: Column, risk_raw: Column) -> Column:
    return impact * norm - risk_raw * (1 - norm)


def sentiment_confidence(sentiment: Column, norm: Column) -> Column:
    return sentiment * norm
