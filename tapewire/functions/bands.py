"""Display bands: numbers and codes to labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.fixed_values import CATEGORY_NAMES, DEFAULT_CATEGORY, OTHER_CATEGORY_NAME
from tapewire.functions.text import non_empty


def category_name(
    code: Column, missing_as_default: bool = False, names: dict[str, str] = CATEGORY_NAMES
) -> Column:
    """Display name of a category letter: a lookup in a list this short needs no join.

    A missing code is ``General News`` in rollups; cards read it as the default
    category (``missing_as_default``).
    """
    if missing_as_default:
        code = F.coalesce(non_empty(code), F.lit(DEFAULT_CATEGORY))
    chain = F
    for letter, name in names.items():
        chain = chain.when(code == letter, F.lit(name))
    return chain.otherwise(F.lit(OTHER_CATEGORY_NAME))


def risk_band(x: Column) -> Column:
    return F.when(x < 0.33, "low_risk").when(x < 0.67, "medium_risk").otherwise("high_risk")


def risk_display(level: Column) -> Column:
    known = level.isin("high_risk", "moderate_risk", "medium_risk", "low_risk")
    return F.when(known, F.upper(F.replace(level, F.lit("_"), F.lit(" ")))).otherwise("LOW RISK")


def sentiment_band(x: Column) -> Column:
    return F.when(x > 0.1, "positive").when(x < -0.1, "negative").otherwise("neutral")


def impact_group(x: Column) -> Column:
    up = F.replace(F.upper(x), F.lit("_"), F.lit(" "))
    return (
        F.when(up.isin("POSITIVE", "SLIGHTLY POSITIVE", "BULLISH"), "positive")
        .when(up.isin("NEGATIVE", "SLIGHTLY NEGATIVE", "BEARISH"), "negative")
        .when(up == "HIGH RISK", "high risk")
        .when(up == "MODERATE RISK", "moderate risk")
        .when(up == "MEDIUM RISK", "medium risk")
        .when(up == "LOW RISK", "low risk")
        .when(up == "SPECULATIVE", "speculative")
        .otherwise("neutral")
    )


def confidence_band(x: Column) -> Column:
    return (
        F.when(x >= 0.7, "high").when(x >= 0.4, "medium").when(x >= 0.2, "low").otherwise("very low")
    )


def trend_band(mean: Column) -> Column:
    """Null for an empty series."""
    return F.when(mean > 0.5, "up").when(mean < -0.5, "down").when(mean.isNotNull(), "flat")


def signal_band(score: Column, detailed: bool = False) -> Column:
    if not detailed:
        return F.when(score > 0.5, "buy").when(score < -0.5, "sell").when(score.isNotNull(), "hold")
    return (
        F.when(score >= 1.5, "strong buy")
        .when(score >= 0.5, "buy")
        .when(score >= 0, "weak buy")
        .when(score >= -0.5, "weak sell")
        .when(score >= -1.5, "sell")
        .when(score.isNotNull(), "strong sell")
    )


def with_category_name(df: DataFrame, names: dict[str, str] = CATEGORY_NAMES) -> DataFrame:
    return df.withColumn("category_name", category_name(F.col("category"), names=names))
