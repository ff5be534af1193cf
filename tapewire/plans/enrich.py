"""From landed articles to payloads: identity, fused sentiment, category, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.functions import identity, text
from tapewire.functions.sentiment import fuse_sentiment, signed_sentiment
from tapewire.operators.classify import classify, needs_model, with_model_scores
from tapewire.operators.dedup import new_articles, unpack_entities
from tapewire.operators.keywords import Dictionary
from tapewire.schemas import PAYLOAD

SUMMARY_FALLBACK = "Financial news update"
NO_PHRASES = "N/A"


def with_ids(raw: DataFrame) -> DataFrame:
    return raw.withColumn("doc_id", identity.extract_doc_id(F.col("title"), F.col("snippet")))


def with_sentiment(df: DataFrame, model_sentiment: DataFrame, rescale_first: bool = False) -> DataFrame:
    """Fuses the first entity's sentiment with a model's ``(doc_id, label, score)``.

    Texts shorter than 10 characters get no model sentiment.
    """
    body = text.article_text(F.col("snippet"), F.col("description"), F.col("title"))
    usable = text.long_enough(body, 10)
    model = model_sentiment.select("doc_id", F.col("label").alias("_label"), F.col("score").alias("_score"))
    joined = with_model_scores(df, model).withColumns(
        {
            "model_sentiment": F.when(usable, signed_sentiment(F.col("_label"), F.col("_score"))),
            "model_sentiment_confidence": F.when(usable, F.col("_score")),
        }
    )
    fused = fuse_sentiment(
        F.col("api_sentiment"), F.col("api_confidence"), F.col("model_sentiment"),
        F.col("model_sentiment_confidence"), rescale_first,
    )
    return joined.withColumn("_fused", fused).select(*joined.columns, "_fused.*").drop("_label", "_score")


# --- what goes to a model, for `operators.model_hooks.score_with` ------------------------------


def sentiment_requests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` of landed articles whose text has at least 10 characters."""
    body = text.article_text(F.col("snippet"), F.col("description"), F.col("title"))
    return df.where(text.long_enough(body, 10)).select(key, text.model_input(body).alias("text"))


def category_requests(
    df: DataFrame, dictionary: Dictionary, key: str = "doc_id", scores: str | None = None
) -> DataFrame:
    """``(key, text)`` of articles with a classification ``text`` that keywords do not decide."""
    whole = text.model_input(F.col("text"), F.col("title"), F.col("description"))
    return needs_model(df, dictionary, scores=scores).select(key, whole.alias("text"))


def generation_requests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` for key phrases and summary."""
    return df.select(key, text.extraction_text(F.col("title"), F.col("description")).alias("text"))


def with_generated(df: DataFrame, generated: DataFrame | None) -> DataFrame:
    """Cleans generated phrases and summaries ``(doc_id, key_phrases, summary)``.

    Without them, or for articles they lack, the fallback values stand.
    """
    if generated is None:
        return df.withColumns({"key_phrases": F.lit(NO_PHRASES), "summary": F.lit(SUMMARY_FALLBACK)})
    source = text.extraction_text(F.col("title"), F.col("description"))
    answers = generated.select("doc_id", F.col("key_phrases").alias("_kp"), F.col("summary").alias("_sum"))
    phrases = text.validate_phrases(text.clean_generated(F.col("_kp")), source)
    summary = text.clean_generated(F.coalesce(F.col("_sum"), F.lit(SUMMARY_FALLBACK)))
    return df.join(answers, "doc_id", "left").withColumns({"key_phrases": phrases, "summary": summary}).drop("_kp", "_sum")


def enrich(
    raw: DataFrame,
    archive: DataFrame,
    model_sentiment: DataFrame,
    model_categories: DataFrame,
    dictionary: Dictionary,
    seq: str = "ingest_seq",
    generated: DataFrame | None = None,
) -> DataFrame:
    """Payloads of the articles that are new, with the audit columns beside them.

    ``seq`` orders the raw rows; of copies the last stays.  ``model_categories`` is a
    table made by `operators.classify.model_table`.
    """
    fresh = new_articles(with_ids(raw), archive, seq)
    scored = with_sentiment(unpack_entities(fresh), model_sentiment)
    body = text.classification_text(F.col("snippet"), F.col("description"), F.col("title"))
    classified = classify(scored.withColumn("text", body), dictionary, model_categories)
    staged = with_generated(classified, generated)
    return staged.withColumns(
        {
            "title": F.coalesce("title", F.lit("")),
            "description": F.coalesce("description", F.lit("")),
            "content": F.coalesce("snippet", F.lit("")),
            "publishedAt": F.col("published_at"),
            "source": F.coalesce("source", F.lit("")),
            "link": F.coalesce("url", F.lit("")),
        }
    )


def payload(df: DataFrame) -> DataFrame:
    return df.select(*PAYLOAD.names)
