"""First rows per key, safe for a key that holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Groups of input partitions in which the rows of a key are cut first.
SPLITS = 256


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; ``rank`` names a column for 1..n.

    ``order`` should end in a unique column, so that ties fall the same way on every run.
    Spark cuts each key inside every input partition before the shuffle (for ``n`` up to
    spark.sql.optimizer.windowGroupLimitThreshold).  The rows of a key then go through a
    cut in groups of input partitions: of P partitions a task gets P / 256 times n rows of
    a hot key, and 256 times n in the end, instead of P times n.
    """
    position = rank or "_rank"

    def cut(frame: DataFrame, by: list[str]) -> DataFrame:
        ranked = frame.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        return ranked.where(F.col(position) <= n)

    split = F.pmod(F.spark_partition_id(), F.lit(SPLITS))
    fewer = cut(df.withColumn("_split", split), [*keys, "_split"]).drop("_split", position)
    result = cut(fewer, keys)
    return result if rank else result.drop(position)


def latest_per_id(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """One row per ``key``: the greatest in the columns of ``order`` (null is least), equal ones by
    their other columns, the same way in every run.

    Whole rows move once: each input partition sends one row per key, however often it holds it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    greatest = F.max(F.struct(F.struct(*order).alias("order"), F.struct(*df.columns).alias("row")))
    return df.groupBy(*keys).agg(greatest.alias("_latest")).select("_latest.row.*")
