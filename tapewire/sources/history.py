"""The article table by day and symbol: times and symbols become folders that a scan leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from tapewire.operators.filters import DAY, SLOT, day_of, symbol_slot
from tapewire.schemas import SCORED


def write_history(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Articles in folders of their day (UTC; those without a time in one of their own) and of a
    slot of their symbol, so that a busy day is dealt to several tasks."""
    slot: Column = F.coalesce(symbol_slot(F.col("symbol")), F.lit(0))
    placed = df.withColumns({DAY: day_of(F.col("publishedAt")), SLOT: slot})
    placed.hint("rebalance", DAY, SLOT).write.mode(mode).partitionBy(DAY, SLOT).parquet(path)


def read_history(spark: SparkSession, path: str, schema: StructType = SCORED) -> DataFrame:
    """The articles with their ``day`` and ``slot``; `filters.where_published` and `where_symbol`
    reach the folders by them."""
    folders = [StructField(DAY, DateType()), StructField(SLOT, IntegerType())]
    return spark.read.schema(StructType([*schema.fields, *folders])).parquet(path)
