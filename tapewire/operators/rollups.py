"""Rollups, facets and series over scored articles.

Everything is grouped with partial aggregation; what is ordered or padded
afterwards is one row per hour, category or facet value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.fixed_values import CATEGORY_NAMES, OTHER_CATEGORY_NAME
from tapewire.functions.bands import category_name, sentiment_band
from tapewire.functions.identity import hour_bucket, hour_label
from tapewire.functions.text import display_confidence, non_empty
from tapewire.operators.filters import valid_history, where_has_ticker, where_published, where_symbol
from tapewire.operators.search_spec import check_range
from tapewire.operators.topn import top_n_per_key

ALL_NAMES = [*CATEGORY_NAMES.values(), OTHER_CATEGORY_NAME]


def _number(c: Column) -> Column:
    """Numeric reading of a column, 0 when there is none."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def _values(df: DataFrame, cols: list[str], *keep: str) -> DataFrame:
    """One row per article and column with the column's name and value: many columns, one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs)).where(F.col("value").isNotNull())


def facets(df: DataFrame, cols: list[str], size: int = 50) -> DataFrame:
    """The ``size`` most frequent values of each column."""
    counts = _values(df, cols).groupBy(F.col("kind").alias("facet"), "value").agg(F.count(F.lit(1)).alias("n"))
    return top_n_per_key(counts, ["facet"], [F.desc("n"), F.asc("value")], size)


def last_buckets(hours: DataFrame, n: int, bucket: str = "hour") -> DataFrame:
    """The latest ``n`` buckets that have data, oldest first."""
    return hours.orderBy(F.desc(bucket)).limit(n).orderBy(bucket)


def hourly_sentiment(df: DataFrame, hours: int | None = 24) -> DataFrame:
    """Mean final score, sentiment and risk per hour, and the time of its first article.

    Articles without a time are left out.
    """
    risk = F.coalesce(F.when(F.col("risk_raw") != 0, F.col("risk_raw")), F.col("risk_adj"))
    rolled = (
        df.where(F.col("publishedAt").isNotNull())
        .groupBy(hour_bucket(F.col("publishedAt")).alias("hour"))
        .agg(
            F.min("publishedAt").alias("time"),
            F.avg(_number(F.col("final_score"))).alias("final_score"),
            F.avg(_number(F.col("sentiment"))).alias("avg_sentiment"),
            F.avg(_number(risk)).alias("avg_risk"),
            F.count(F.lit(1)).alias("articles"),
        )
        .withColumn("label", hour_label(F.col("hour")))
    )
    return rolled if hours is None else last_buckets(rolled, hours)


def _by_hour(df: DataFrame) -> DataFrame:
    return df.where(F.col("publishedAt").isNotNull()).select(
        hour_bucket(F.col("publishedAt")).alias("hour"), category_name(F.col("category")).alias("category")
    )


def hourly_categories(df: DataFrame, hours: int = 12) -> DataFrame:
    """Wide form: one count column per category name, 0 where an hour has none."""
    wide = _by_hour(df).groupBy("hour").pivot("category", ALL_NAMES).agg(F.count(F.lit(1)))
    return last_buckets(wide.fillna(0), hours)


def hourly_category_counts(df: DataFrame) -> DataFrame:
    """Long form of the hours and categories that occur."""
    return _by_hour(df).groupBy("hour", "category").agg(F.count(F.lit(1)).alias("n"))


def fill_hour_grid(counts: DataFrame) -> DataFrame:
    """Every hour with every category that occurs anywhere, missing counts as 0.

    The grid is made from one row per hour that holds the category list, so it
    grows with hours times categories, not with articles.
    """
    # All three uses keep n, so they share the one aggregation of the articles.
    present = counts.where(F.col("n") > 0)
    names = present.agg(F.collect_set("category")).scalar()
    grid = present.select("hour").distinct().withColumn("category", F.explode(names))
    return grid.join(counts, ["hour", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hourly_totals(df: DataFrame) -> DataFrame:
    """Counts per hour and category and, with category null, per hour; both null is the total."""
    return _by_hour(df).rollup("hour", "category").agg(F.count(F.lit(1)).alias("n"))


def tickers(df: DataFrame) -> DataFrame:
    """Distinct symbol and entity pairs with the time they were first seen."""
    return where_has_ticker(df).groupBy("symbol", "entity_name").agg(F.min("publishedAt").alias("first_seen"))


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(kind, value)`` of each value that occurs in one of the columns."""
    return _values(df, cols).distinct()


def coverage(df: DataFrame) -> DataFrame:
    symbol, entity = non_empty(F.col("symbol")).isNotNull(), non_empty(F.col("entity_name")).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if(symbol).alias("with_symbol"),
        F.count_if(entity).alias("with_entity"),
        F.count_if(symbol & entity).alias("with_both"),
    )


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """Count and share of each value."""
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return distribution(df, sentiment_band(F.col("sentiment")))


def breakdown(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean score and latest publication per value of each column."""
    return _values(df, cols, "final_score", "publishedAt").groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("final_score").alias("avg_score"),
        F.max("publishedAt").alias("latest"),
    )


def symbol_history(
    df: DataFrame, symbol: str, limit: int = 100, start: int | None = None, end: int | None = None
) -> DataFrame:
    """``(ts, final_score)`` of one symbol, oldest first; at most 10000 rows."""
    check_range(limit, 1, 10_000, "limit")
    rows = where_published(where_symbol(df, symbol), start, end)
    top = rows.select("publishedAt", "final_score", "doc_id").orderBy(F.asc_nulls_last("publishedAt"), "doc_id").limit(limit)
    return valid_history(top).select(F.col("publishedAt").alias("ts"), "final_score").orderBy("ts")


def symbol_series(df: DataFrame, limit: int = 200) -> DataFrame:
    """The history of every symbol at once, with positions 0..n-1."""
    check_range(limit, 1, 10_000, "limit")
    rows = valid_history(df.where(non_empty(F.col("symbol")).isNotNull()))
    rows = rows.select("symbol", "publishedAt", "final_score", "doc_id")
    series = top_n_per_key(rows, ["symbol"], [F.asc("publishedAt"), F.asc("doc_id")], limit, rank="position")
    return series.withColumn("position", F.col("position") - 1)


def last_related(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The latest ``n`` articles of each key, with positions from the oldest on."""
    rows = df.where(F.col("publishedAt").isNotNull()).select(*keys, "publishedAt", "final_score", "doc_id")
    latest = top_n_per_key(rows, keys, [F.desc("publishedAt"), F.desc("doc_id")], n)
    return top_n_per_key(latest, keys, [F.asc("publishedAt"), F.asc("doc_id")], n, rank="position").withColumn(
        "position", F.col("position") - 1
    )


def series_mean(series: DataFrame, keys: list[str] | None = None, score: str = "final_score") -> DataFrame:
    return series.groupBy(*(keys or [])).agg(F.avg(score).alias("mean_score"))


def sort_articles(df: DataFrame, name: str) -> DataFrame:
    """The card orders: newest, oldest, risk, sentiment, confidence, final_score."""
    zero = F.lit(0.0)
    orders = {
        "newest": F.desc_nulls_last("publishedAt"),
        "oldest": F.asc_nulls_first("publishedAt"),
        "risk": F.coalesce(F.col("risk_adj"), zero).desc(),
        "sentiment": F.coalesce(F.col("sentiment"), zero).desc(),
        "confidence": display_confidence(F.col("conf_norm"), F.col("confidence")).desc(),
        "final_score": F.coalesce(F.col("final_score"), zero).desc(),
    }
    return df.orderBy(orders[name], F.asc("doc_id")) if name in orders else df


def sample(df: DataFrame, n: int = 1) -> DataFrame:
    return df.limit(n)
