"""Weighted category decision from keyword and model scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.fixed_values import CATEGORY_LABELS, CATEGORY_LETTERS, DEFAULT_CATEGORY
from tapewire.functions.patterns import once
from tapewire.functions.text import long_enough
from tapewire.operators.keywords import (
    Dictionary,
    first_category,
    keyword_score,
    with_keyword_stats,
)
from tapewire.operators.topn import top_n_per_key

# Weights and thresholds of the decision.
MODEL_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
OVERRIDE_AT, ACCEPT_AT = 0.6, 0.4
MODEL_DOMINANT_ABOVE, KEYWORD_DOMINANT_ABOVE = 0.6, 0.7
DEFAULT_CONFIDENCE = 0.3
MODEL_MIN_CHARS = 15


def label_to_category(label: Column, labels: dict[str, str] = CATEGORY_LABELS) -> Column:
    """Category letter of a label text, the default letter for an unknown one."""
    chain = F
    for letter, text in labels.items():
        chain = chain.when(label == text, F.lit(letter))
    return chain.otherwise(F.lit(DEFAULT_CATEGORY))


def all_categories(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("category").union(b.select("category")).distinct()


def top_labels(scores: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """The ``n`` best labels per article with their rank."""
    return top_n_per_key(scores, [key], [F.desc("score"), F.asc("label")], n, rank="rank")


def normalised_top_labels(scores: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """Long form: share of each category among the ``n`` best labels of an article."""
    table = model_table(scores, n, key)
    return table.select(key, F.explode("ml").alias("category", "share"))


def model_table(scores: DataFrame, n: int = 3, key: str = "doc_id") -> DataFrame:
    """One row per article: ``ml`` (category to share), best category and its raw score."""
    best = top_labels(scores, n, key).withColumn("category", label_to_category(F.col("label")))
    rows = best.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "category", "score"))).alias("_top")
    )

    def total(entries: Column) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["score"])

    whole = total(F.col("_top"))
    scale = F.when(whole > 0, whole).otherwise(F.lit(1.0))
    share = F.transform(
        F.array_distinct(F.transform("_top", lambda e: e["category"])),
        lambda c: F.struct(
            c.alias("category"),
            (total(F.filter("_top", lambda e: e["category"] == c)) / scale).alias("share"),
        ),
    )
    first = F.get(F.col("_top"), F.lit(0))
    return rows.select(
        key,
        F.map_from_entries(share).alias("ml"),
        first["category"].alias("model_category"),
        first["score"].alias("model_confidence"),
    )


def with_model_scores(df: DataFrame, model_scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left join with a precomputed table of model output, one row per article."""
    return df.join(model_scores, key, "left")


def _ranked(pairs: Column, score) -> Column:
    """``(score, order, category)`` structs: the largest is the best, ties go to the first letter."""
    return F.transform(
        pairs,
        lambda p, i: F.struct(score(p).alias("score"), (-i).alias("order"), p["category"].alias("category")),
    )


def align_scores(keyword: Column, ml: Column, api_confidence: Column) -> Column:
    """Per category letter: keyword score, scaled model score and their weighted sum.

    Categories without a score on either side count as 0.  Being one row per
    article already, the two sides are aligned in the row instead of by a join.
    """

    def entry(p: Column) -> Column:
        model = F.coalesce(F.try_element_at(ml, p["category"]) * api_confidence, F.lit(0.0))
        return F.struct(
            p["category"].alias("category"),
            p["score"].alias("keyword"),
            model.alias("ml"),
            (F.lit(MODEL_WEIGHT) * model + F.lit(KEYWORD_WEIGHT) * p["score"]).alias("combined"),
        )

    return F.transform(keyword, entry)


def best_category(pairs: Column, field: str = "score") -> Column:
    """Struct ``(score, order, category)`` of the best entry."""
    return F.array_max(_ranked(pairs, lambda p: p[field]))


def with_keyword_scores(df: DataFrame, dictionary: Dictionary, text_col: str = "text", out: str = "keyword_scores") -> DataFrame:
    """Adds ``(category, score)`` for the 14 categories, 0 without match.

    `needs_model` and `classify` take the name of this column as ``scores``; a text that goes
    through both is then scanned once.
    """
    staged = with_keyword_stats(df, dictionary, text_col, "_entries")
    scores = F.transform(
        "_entries",
        lambda e: F.struct(
            e["category"].alias("category"),
            F.coalesce(keyword_score(e["stats"]), F.lit(0.0)).alias("score"),
        ),
    )
    return staged.withColumn(out, once(scores)).drop("_entries")


def _with_scores(df: DataFrame, dictionary: Dictionary, text_col: str, scores: str | None) -> DataFrame:
    return df.withColumnRenamed(scores, "_kw") if scores else with_keyword_scores(df, dictionary, text_col, "_kw")


def classify(
    df: DataFrame,
    dictionary: Dictionary,
    model: DataFrame | None = None,
    key: str = "doc_id",
    text_col: str = "text",
    confidence_col: str = "confidence",
    scores: str | None = None,
) -> DataFrame:
    """Adds ``category``, ``category_confidence``, ``method`` and ``breakdown``.

    A keyword score of 0.6 or more decides alone.  Otherwise the best weighted sum
    wins if it reaches 0.4, else the default category.  Articles without a vendor
    confidence get the first category with any keyword.

    ``model`` is a table made by `model_table`.  It is joined after the text was
    scanned, so a caller who does not keep the text does not shuffle it.  ``scores`` names a
    column of `with_keyword_scores`, which is dropped.
    """
    conf = F.col(confidence_col)
    staged = _with_scores(df, dictionary, text_col, scores)
    usable = F.col("_usable")
    staged = staged.withColumn("_usable", once(long_enough(F.col(text_col), MODEL_MIN_CHARS)))
    if model is not None:
        model = model.select(key, F.col("ml").alias("_ml"), F.col("model_confidence").alias("_model"))
        staged = with_model_scores(staged, model, key)
    else:
        unknown = F.lit(None)
        staged = staged.withColumns({"_ml": unknown.cast("map<string,double>"), "_model": unknown.cast("double")})
    staged = staged.withColumn("_ml", F.when(usable, F.col("_ml")))
    staged = staged.withColumns(
        {
            "_all": align_scores(F.col("_kw"), F.col("_ml"), conf),
            "_best_kw": best_category(F.col("_kw")),
        }
    )
    staged = staged.withColumn("_ranked", F.sort_array(_ranked(F.col("_all"), lambda p: p["combined"]), False))
    best = F.get(F.col("_ranked"), F.lit(0))
    chosen = F.get(F.filter("_all", lambda p: p["category"] == best["category"]), F.lit(0))
    staged = staged.withColumns({"_best": best, "_chosen": chosen})

    override = F.col("_best_kw.score") >= OVERRIDE_AT
    accepted = F.col("_best.score") >= ACCEPT_AT
    no_confidence = conf.isNull()
    method = (
        F.when(no_confidence, "KEYWORD_FALLBACK")
        .when(override, "REDIS_RULE_OVERRIDE")
        .when(accepted & (F.col("_chosen.ml") > MODEL_DOMINANT_ABOVE), "WEIGHTED_ML_DOMINANT")
        .when(accepted & (F.col("_chosen.keyword") > KEYWORD_DOMINANT_ABOVE), "WEIGHTED_KEYWORD_DOMINANT")
        .when(accepted, "WEIGHTED_BALANCED")
        .otherwise("DEFAULT_LOW_CONFIDENCE")
    )
    # The fallback needs no second text scan: the first letter with any match.
    fallback = F.coalesce(
        F.get(F.filter("_kw", lambda k: k["score"] > 0), F.lit(0))["category"], F.lit(DEFAULT_CATEGORY)
    )
    category = (
        F.when(no_confidence, fallback)
        .when(override, F.col("_best_kw.category"))
        .when(accepted, F.col("_best.category"))
        .otherwise(DEFAULT_CATEGORY)
    )
    confidence = (
        F.when(no_confidence, F.lit(None).cast("double"))
        .when(override, F.col("_best_kw.score"))
        .when(accepted, F.col("_best.score"))
        .otherwise(F.lit(DEFAULT_CONFIDENCE))
    )
    top3 = F.transform(
        F.slice("_ranked", 1, 3), lambda r: F.struct(r["category"].alias("category"), r["score"].alias("score"))
    )
    own = F.array(
        F.struct(F.col("_best_kw.category").alias("category"), F.col("_best_kw.score").alias("score"))
    )
    scaled = F.transform_values(F.col("_ml"), lambda _, v: v * conf)
    empty = F.create_map().cast("map<string,double>")
    breakdown = F.when(
        ~no_confidence,
        F.struct(
            F.when(override, 0.0).otherwise(F.col("_chosen.ml")).alias("ml_score"),
            F.when(override, F.col("_best_kw.score")).otherwise(F.col("_chosen.keyword")).alias("keyword_score"),
            F.when(override, F.col("_best_kw.score")).otherwise(F.col("_best.score")).alias("combined_score"),
            F.when(override | ~usable, 0.0)
            .otherwise(F.coalesce(F.col("_model"), F.lit(0.0)))
            .alias("model_confidence"),
            conf.alias("api_confidence"),
            F.when(override, empty).otherwise(F.coalesce(scaled, empty)).alias("top_3_ml"),
            F.when(override, own).otherwise(top3).alias("top_3_combined"),
            F.struct(F.lit(MODEL_WEIGHT).alias("alpha"), F.lit(KEYWORD_WEIGHT).alias("beta")).alias("weights"),
        ),
    )
    return staged.withColumns(
        {
            "category": once(category),
            "category_confidence": once(confidence),
            "method": once(method),
            "breakdown": once(breakdown),
        }
    ).drop("_kw", "_usable", "_ml", "_model", "_all", "_best_kw", "_ranked", "_best", "_chosen")


def needs_model(df: DataFrame, dictionary: Dictionary, text_col: str = "text", scores: str | None = None) -> DataFrame:
    """Rows no keyword score decides alone: only these have to go to a model."""
    staged = _with_scores(df, dictionary, text_col, scores)
    decided = F.exists("_kw", lambda e: e["score"] >= OVERRIDE_AT)
    return staged.where(~decided & long_enough(F.col(text_col), MODEL_MIN_CHARS)).drop("_kw")


def classification_audit(df: DataFrame) -> DataFrame:
    """One log line per classified article."""
    b = F.col("breakdown")
    numbers = [
        F.format_string("%.3f", c)
        for c in (
            F.col("category_confidence"), b["ml_score"], b["keyword_score"],
            b["model_confidence"], b["api_confidence"],
        )
    ]
    line = F.concat_ws(",", F.lit("CLASSIFICATION"), F.col("method"), F.col("category"), *numbers)
    return df.where(b.isNotNull()).select("doc_id", line.alias("line"))


__all__ = [
    "CATEGORY_LETTERS", "align_scores", "all_categories", "best_category", "classification_audit",
    "classify", "first_category", "label_to_category", "model_table", "needs_model",
    "normalised_top_labels", "top_labels", "with_keyword_scores", "with_model_scores",
]
