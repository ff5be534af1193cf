"""Helpers of the operators: tables in the shared folder, columns of a corpus, file names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.sources.sinks import work_dir

#: Places that hold more than this share of all rows under one key are hot; there are at most as many.
HOT_KEYS = 1000
#: Rows of a file of narrow rows.
FILE_ROWS = 100_000

_remembered: dict[str, Callable[[], object]] = {}


def taking_over(operator: str, forget: Callable[[], object] | None = None) -> None:
    """Said where a task of an operator begins: what others remember in this Python worker, which serves
    all tasks one after the other, is forgotten, and ``forget`` will do so for this one."""
    for other in [k for k in _remembered if k != operator]:
        _remembered.pop(other)()
    if forget:
        _remembered[operator] = forget


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows written to a fresh folder of the shared folder and read again.

    Cuts the lineage: a lost executor costs no more than the tasks after this table.  ``rows`` says
    about how many narrow rows there are at most: see `in_few_files`.
    """
    path = work_dir(df.sparkSession, name)
    if rows is not None:
        df = in_few_files(df, rows)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_few_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df``, written to a file for ``each`` of its ``rows``, two for each core at least, and not to
    one for each partition of a shuffle."""
    return df.coalesce(partitions_for(rows, each, 2 * df.sparkSession.sparkContext.defaultParallelism))


def partitions_for(amount: int, each: int, least: int = 1) -> int:
    """How many partitions hold ``amount`` at ``each`` a partition."""
    return max(least, -(-int(amount or 0) // each))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def corpus(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``_id`` and ``_text`` (null: empty), whatever else the input holds."""
    return df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def table_name(prefix: str, path: str) -> str:
    """A name for the table at ``path``; the same path always gets the same name."""
    return f"{prefix}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def looked_up(rows: DataFrame, key: str, groups: DataFrame, size: str, values: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of their group, null where ``key`` is null or unknown.

    ``groups`` has one row per key and in ``size`` how many of ``rows`` there are.  Keys of more
    than one row in HOT_KEYS, at most HOT_KEYS of them, are sent to every task; their rows, and
    those without a key, are dealt by row in the join that looks up all others.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    record = F.struct(*values)
    hot = groups.where((F.col(size) * HOT_KEYS > total) & (F.col(size) > 1)).select(F.col(key).alias("_hot_key"), record.alias("_hot"))
    cold = groups.select(F.col(key).alias("_cold_key"), record.alias("_cold"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    spread = F.unhex(F.sha2(F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")), 256))
    settled = F.col("_hot").isNotNull() | F.col(key).isNull()
    probe = F.when(settled, spread).otherwise(F.col(key))
    found = found.withColumn("_probe", probe).join(cold, F.col("_probe") == F.col("_cold_key"), "left")
    of = F.coalesce("_hot", "_cold")
    return found.withColumns({v: of[v] for v in values}).drop("_hot", "_hot_key", "_cold", "_cold_key", "_probe")


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, bucketed and sorted by ``key``: joins on it move
    only their other side."""
    spark, path = df.sparkSession, work_dir(df.sparkSession, name)
    table = table_name(name, path)
    spark.sql(
        f"CREATE TABLE {table} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    df.repartition(buckets, key).write.insertInto(table)
    return spark.table(table)
