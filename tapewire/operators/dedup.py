"""Deduplication against the archive and inside a batch.

Copies are collapsed before every join, so a text that makes up a large share of
the input reaches the join as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def archived_ids(archive: DataFrame, key: str = "doc_id") -> DataFrame:
    return archive.select(key).where(F.col(key).isNotNull()).distinct()


def new_articles(df: DataFrame, archive: DataFrame, seq: str, key: str = "doc_id") -> DataFrame:
    """The copy with the greatest ``seq`` of every incoming article whose id is not archived.

    Ids and numbers alone are grouped and compared with the archive; the rows of what is left
    are fetched at the end.  Rows that repeat id and number count as one.
    """
    latest = df.groupBy(key).agg(F.max(seq).alias(seq))
    fresh = latest.join(archived_ids(archive, key), key, "left_anti")
    return df.join(fresh, [key, seq], "left_semi").dropDuplicates([key, seq])


def seen_articles(df: DataFrame, archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids that came in although they are archived, and how many rows each has."""
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(archived_ids(archive, key), key, "left_semi")


def batch_summary(df: DataFrame, archive: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: rows fetched, new articles and rows skipped as already archived."""
    copies = df.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    known = archived_ids(archive, key).withColumn("known", F.lit(True))
    skipped = F.coalesce(F.col("known"), F.lit(False))
    return copies.join(known, key, "left").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("fetched"),
        F.count_if(~skipped).alias("new_articles"),
        F.coalesce(F.sum(F.when(skipped, F.col("copies"))), F.lit(0)).alias("skipped"),
    )


def batch_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def merge_tickers(df: DataFrame, seq: str, key: str = "doc_id", symbols: str = "symbols") -> DataFrame:
    """All distinct tickers of the copies of an article, first seen first.

    Pairs are made distinct before anything is collected, so a list only ever holds
    the distinct tickers of one article.
    """
    pairs = df.select(key, seq, F.posexplode(symbols).alias("pos", "symbol"))
    first = pairs.groupBy(key, "symbol").agg(F.min(F.struct(seq, "pos")).alias("seen"))
    ordered = F.sort_array(F.collect_list(F.struct("seen", "symbol")))
    return first.groupBy(key).agg(F.transform(ordered, lambda s: s["symbol"]).alias(symbols))


def unpack_entities(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Parallel arrays of the entity fields, plus the first entity's score and confidence."""
    e = F.coalesce(F.col(entities), F.array().cast(df.schema[entities].dataType))
    return df.withColumns(
        {
            "symbols": F.transform(e, lambda x: x["symbol"]),
            "entity_names": F.transform(e, lambda x: x["name"]),
            "api_sentiment": F.get(e, F.lit(0))["sentiment_score"],
            "api_confidence": F.get(e, F.lit(0))["match_score"],
        }
    ).drop(entities)
