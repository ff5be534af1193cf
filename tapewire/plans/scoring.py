"""From decoded messages to the 24 scored columns: one projection over the scan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.fixed_values import COMMODITY_WORDS, MA_WORDS, RISK_WORDS, SCORING_DEFAULTS
from tapewire.functions import identity, scoring
from tapewire.functions.patterns import keyword_flag, once
from tapewire.operators.filters import apply_filters, where_published
from tapewire.operators.search_spec import SearchSpec
from tapewire.schemas import SCORED

#: Filters on columns that only the words of a text decide.
LATE_FILTERS = ("risk_level", "impact", "risk_score")


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({k: v for k, v in SCORING_DEFAULTS.items() if k in df.columns})


def add_scores(
    df: DataFrame,
    risk_words: list[str] = RISK_WORDS,
    ma_words: list[str] = MA_WORDS,
    commodity_words: list[str] = COMMODITY_WORDS,
) -> DataFrame:
    """Adds every score column and keeps all others.

    ``impact_sentiment`` is the label before risk replaces it and ``extract_id`` the
    id the article came in with; the output projection leaves both out.
    """
    return add_risk(add_ids(prepare(df)), risk_words, ma_words, commodity_words)


def prepare(df: DataFrame) -> DataFrame:
    """Defaults and confidence: what filters on message columns need."""
    sentiment = F.col("sentiment")
    df = fill_defaults(df).withColumn("confidence", scoring.rescale_confidence(F.col("confidence")))
    return df.withColumns(
        {
            "conf_norm": scoring.conf_norm(F.col("confidence")),
            "impact_sentiment": scoring.impact_from_sentiment(sentiment, F.col("confidence")),
        }
    )


def add_ids(df: DataFrame) -> DataFrame:
    """The id of the article table and the time; a filter on the time does not parse it again."""
    return df.withColumns(
        {
            "extract_id": F.col("doc_id"),
            "doc_id": identity.index_doc_id(
                F.col("symbol"), F.col("source"), F.col("title"), F.col("publishedAt")
            ),
            "publishedAt": once(identity.to_epoch_ms(F.col("publishedAt"))),
        }
    )


def add_risk(
    df: DataFrame,
    risk_words: list[str] = RISK_WORDS,
    ma_words: list[str] = MA_WORDS,
    commodity_words: list[str] = COMMODITY_WORDS,
) -> DataFrame:
    """The columns that follow from the words of a text, for rows of `prepare`."""
    text = (F.col("content"), F.col("title"))
    sentiment = F.col("sentiment")
    # Risk and commodity words lead to the same level, so they are one scan.
    alarm = keyword_flag([*risk_words, *commodity_words], *text)
    deal = keyword_flag(ma_words, *text)
    df = df.withColumn("risk_level", once(scoring.risk_level(sentiment, alarm, deal)))
    df = df.withColumn("risk_raw", scoring.risk_base(F.col("risk_level")))
    df = df.withColumns(
        {
            "risk_adj": scoring.risk_adjusted(F.col("risk_raw"), F.col("conf_norm")),
            "impact_assessment": scoring.impact_overlay(
                F.col("risk_raw"), sentiment, F.col("impact_sentiment")
            ),
        }
    )
    df = df.withColumn("impact_score", scoring.impact_score(F.col("impact_assessment")))
    return df.withColumns(
        {
            "risk_score": F.col("risk_adj"),
            "final_score": scoring.final_score(F.col("impact_score"), F.col("conf_norm"), F.col("risk_raw")),
            "sentiment_confidence_score": scoring.sentiment_confidence(sentiment, F.col("conf_norm")),
        }
    )


def output_columns(df: DataFrame) -> DataFrame:
    return df.select(*SCORED.names)


def score_articles(df: DataFrame, **word_lists: list[str]) -> DataFrame:
    """Works on a batch and on a stream alike."""
    return output_columns(add_scores(df, **word_lists))


def score_where(df: DataFrame, spec: SearchSpec, **word_lists: list[str]) -> DataFrame:
    """The scored articles that pass the filters of ``spec``.

    Conditions on message columns come first, so what can be pushed reaches the scan, then
    those on the time; only what passes both is scanned for words.  Those on risk and impact
    follow.
    """
    early = replace(spec, **dict.fromkeys((*LATE_FILTERS, "start_ms", "end_ms")))
    late = SearchSpec(**{name: getattr(spec, name) for name in LATE_FILTERS})
    kept = where_published(add_ids(apply_filters(prepare(df), early)), spec.start_ms, spec.end_ms)
    return output_columns(apply_filters(add_risk(kept, **word_lists), late))
