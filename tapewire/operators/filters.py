"""Filters over scored articles.

All are plain comparisons on stored columns, so a parquet scan receives them as
pushed filters; only the substring search has to look at every text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.functions.text import display_confidence, non_empty
from tapewire.operators.search_spec import DAY_MS, SearchSpec, check_symbol

#: Folders of a table by day and symbol (see `sources.history`), and how many slots symbols have.
DAY, SLOT, SYMBOL_SLOTS = "day", "slot", 16


def sentiment_condition(band: str, bands: str = "server", column: str = "sentiment") -> Column:
    """Two band sets: the server's (0 and +-0.05, overlapping) and the client's (+-0.1)."""
    c = F.col(column)
    if bands == "server":
        tests = {"positive": c > 0, "negative": c < 0, "neutral": c.between(-0.05, 0.05)}
    else:
        tests = {"positive": c > 0.1, "negative": c < -0.1, "neutral": c.between(-0.1, 0.1)}
    return tests[band]


def where_sentiment(df: DataFrame, band: str, bands: str = "server") -> DataFrame:
    return df if band == "all" else df.where(sentiment_condition(band, bands))


def where_category(df: DataFrame, value: str) -> DataFrame:
    """A single letter A-J in any case means that category; other text must be equal."""
    return df.where(F.col("category") == (value.upper() if re.fullmatch("[A-Ja-j]", value) else value))


def where_source(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("source") == value)


def where_risk_level(df: DataFrame, level: str) -> DataFrame:
    return df.where(F.col("risk_level") == level)


def where_published(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Publication time in epoch milliseconds, both ends included, either may be open."""
    by_day = DAY in df.columns
    if start is not None:
        df = df.where(F.col("publishedAt") >= start)
        df = df.where(F.col(DAY) >= day_of(F.lit(start))) if by_day else df
    if end is not None:
        df = df.where(F.col("publishedAt") <= end)
        df = df.where(F.col(DAY) <= day_of(F.lit(end))) if by_day else df
    return df


def day_of(ms: Column) -> Column:
    """The UTC day of a time in epoch milliseconds."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def symbol_slot(symbol: Column) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(SYMBOL_SLOTS)).cast("int")


def where_impact(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col("impact_assessment") == label)


def where_risk_between(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.where(F.col("risk_adj").between(low, high))


def where_confidence_between(df: DataFrame, low: float, high: float) -> DataFrame:
    """Shown confidence in percent."""
    shown = display_confidence(F.col("conf_norm"), F.col("confidence")) * 100
    return df.where(shown.between(low, high))


def where_contains(df: DataFrame, term: str) -> DataFrame:
    """Substring search over title, key phrases and content, ignoring case."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "key_phrases", "content")]
    return df.where(F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(term.lower())))


def where_has_ticker(df: DataFrame) -> DataFrame:
    return df.where(non_empty(F.col("symbol")).isNotNull() & non_empty(F.col("entity_name")).isNotNull())


def where_symbol(df: DataFrame, symbol: str) -> DataFrame:
    """The wanted symbol is trimmed and upper-cased, the stored one compared as it is."""
    wanted = F.lit(check_symbol(symbol))
    df = df.where(F.col("symbol") == wanted)
    return df.where(F.col(SLOT) == symbol_slot(wanted)) if SLOT in df.columns else df


def where_not_self(df: DataFrame, doc_id: str) -> DataFrame:
    return df.where(F.col("doc_id") != doc_id)


def valid_history(df: DataFrame) -> DataFrame:
    """Rows with a numeric score and a time."""
    score = F.col("final_score").try_cast("double")
    return df.withColumn("final_score", score).where(F.col("final_score").isNotNull() & F.col("publishedAt").isNotNull())


def get_article(df: DataFrame, doc_id: str) -> DataFrame:
    """Lookup by id: one row, or none."""
    return df.where(F.col("doc_id") == doc_id).limit(1)


def apply_filters(df: DataFrame, spec: SearchSpec) -> DataFrame:
    """Every filter of the spec; the search text itself is not one of them."""
    steps = [
        (spec.sentiment, lambda d: where_sentiment(d, spec.sentiment, spec.bands)),
        (spec.category, lambda d: where_category(d, spec.category)),
        (spec.source, lambda d: where_source(d, spec.source)),
        (spec.risk_level, lambda d: where_risk_level(d, spec.risk_level)),
        (spec.symbol, lambda d: where_symbol(d, spec.symbol)),
        (spec.impact, lambda d: where_impact(d, spec.impact)),
        (spec.risk_score, lambda d: where_risk_between(d, *spec.risk_score)),
        (spec.confidence, lambda d: where_confidence_between(d, *spec.confidence)),
    ]
    for wanted, step in steps:
        if wanted is not None:
            df = step(df)
    return where_published(df, spec.start_ms, spec.end_ms)
