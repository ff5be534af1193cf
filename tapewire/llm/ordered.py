"""Places and running sums inside keys of any size: rows are sorted over all tasks, never a key in one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewire.llm.common import saved


def placed(df: DataFrame, keys: Sequence[str], order: Sequence, name: str) -> DataFrame:
    """The rows sorted by ``keys`` and ``order`` in a table, ``_at`` rising in that order.

    ``_part`` is the sorted partition a row lies in; a key may span many of them.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [*keys, *order]
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    return saved(rows.withColumn("_part", F.shiftright("_at", 33)), name)


def spans(rows: DataFrame, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """One row per key and sorted partition: its first ``_at`` and what lies before it, ``_sum``
    (of ``value``, or the number of rows)."""
    each = F.count(F.lit(1)) if value is None else F.sum(value)
    found = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), each.alias("_own"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_sum", F.coalesce(F.sum("_own").over(earlier), F.lit(0))).drop("_own")


def numbered(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``placed`` rows with ``name``, their number inside their key, from 0."""
    own = spans(rows, keys)
    found = rows.join(own, [*keys, "_part"])
    return found.withColumn(name, F.col("_at") - F.col("_first") + F.col("_sum")).drop("_at", "_part", "_first", "_sum")


def running(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``placed`` rows with ``name``, the sum of ``value`` over the earlier rows of their key."""
    earlier = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    found = inside.join(spans(rows, keys, value), [*keys, "_part"])
    return found.withColumn(name, F.col("_inside") + F.col("_sum")).drop("_at", "_part", "_first", "_sum", "_inside")
