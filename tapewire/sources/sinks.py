"""Sinks: archive, messages, the keyed article table, dictionaries and audit logs.

A write that may be retried replaces exactly what its first try wrote.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from tapewire.operators.topn import latest_per_id
from tapewire.schemas import PAYLOAD, SCORED

RUN, BATCH = "run", "batch_id"
VERSION = StructType([StructField(RUN, LongType()), StructField(BATCH, LongType())])
RUNS = StructType([StructField("run_id", StringType()), StructField(RUN, LongType())])
IDS = StructType([StructField("doc_id", StringType()), StructField("prefix", StringType())])
#: Folders of a keyed table, and their number unless another is asked for.
BUCKET, BUCKETS = "bucket", 16
BUCKET_FIELD = StructField(BUCKET, IntegerType())
STAGED = "writer string, batch_id bigint"
#: Keywords of a line of an exported dictionary, on average.
LINE_KEYWORDS = 1000


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of ``spark.checkpoint.dir``.

    Only a local session without that setting may fall back to the machine's own
    temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "tapewire")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a fresh folder of `work_dir` and read again: what several later steps
    need is computed once, and a lost executor costs no more than the tasks after it."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_archive(df: DataFrame, path: str) -> None:
    """Appends payloads as JSON lines; non-ASCII text is kept as it is."""
    df.select(*PAYLOAD.names).write.mode("append").json(path)


def to_messages(df: DataFrame) -> DataFrame:
    """One JSON text per row in ``value``; fields that are null are written as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def publish(df: DataFrame, sink: str, location: str, **options: str) -> None:
    """Sends each row as one message: to a topic (``sink="kafka"``) or a directory (``"files"``)."""
    messages = to_messages(df)
    if sink == "kafka":
        messages.write.format("kafka").option("topic", location).options(**options).save()
    elif sink == "files":
        messages.write.mode("append").text(location)
    else:
        raise ValueError(f"unknown sink {sink!r}")


# --- runs ---------------------------------------------------------------------------------------
# A run is what has one checkpoint: a new checkpoint counts its batches from 0 again, but as a new
# run, so it never touches what another wrote.


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint when it first started."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def run_number(spark: SparkSession, path: str, run_id: str) -> int:
    """The number of a run in the table at ``path``; a run that is not known gets the next one.

    Two runs that took one number at the same time are both refused.
    """
    registry = f"{path}/_runs"
    known = read_if_there(spark, registry, RUNS).collect()  # one row per checkpoint ever used
    numbers = {r["run_id"]: r[RUN] for r in known}
    if run_id not in numbers:
        numbers[run_id] = max(numbers.values(), default=0) + 1
        spark.createDataFrame([(run_id, numbers[run_id])], RUNS).coalesce(1).write.mode("append").parquet(registry)
        known = read_if_there(spark, registry, RUNS).collect()
    if any(r[RUN] == numbers[run_id] and r["run_id"] != run_id for r in known):
        raise RuntimeError(f"two runs hold number {numbers[run_id]} of {path}")
    return numbers[run_id]


def _folder(path: str, run: int, batch_id: int) -> str:
    return f"{path}/{RUN}={run}/{BATCH}={batch_id}"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows under ``path``, none where there is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _bucket(key: str | list[str], buckets: int, values: Sequence[Column] | None = None) -> Column:
    return F.pmod(F.xxhash64(*(values or _keys(key))), F.lit(buckets)).cast("int")


def _buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets the table has; None before its first batch."""
    return read_if_there(spark, f"{path}/_layout", "buckets int").agg(F.max("buckets")).first()[0]


def _stage(spark: SparkSession, path: str) -> Row | None:
    """Who staged the buckets that are still to be put in place, if there are any."""
    return read_if_there(spark, f"{path}/_staged/ready", STAGED).first()


def _settle(spark: SparkSession, path: str, schema: StructType) -> None:
    """Puts staged buckets in place.  They are whole, so doing it again changes nothing."""
    ready = _stage(spark, path)
    if ready is None:
        return
    rows = spark.read.schema(StructType([*schema.fields, BUCKET_FIELD])).parquet(f"{path}/_staged/rows")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    done = spark.createDataFrame([(ready["batch_id"],)], "batch_id bigint")
    done.coalesce(1).write.mode("overwrite").parquet(f"{path}/_applied/{ready['writer']}")
    spark.createDataFrame([], STAGED).write.mode("overwrite").parquet(f"{path}/_staged/ready")


def upsert(
    df: DataFrame, path: str, batch_id: int, order: Sequence[str], key: str | list[str] = "doc_id", writer: str = "batch",
    buckets: int = BUCKETS,
) -> DataFrame:
    """Insert or replace by ``key``; returns the rows of the batch, one per key.

    Of copies inside the batch the one greatest in the columns of ``order`` stays.  The table is
    dealt to buckets by the hash of the key: only those that the batch touches are read, without the
    keys it replaces, and written again.  They are staged whole before any is put in place; a batch
    that was cut short is finished by the next call, and one that is retried, known by its
    ``writer`` and number, changes nothing.  One writer at a time.
    """
    spark, keys = df.sparkSession, _keys(key)
    _settle(spark, path, df.schema)
    one = latest_per_id(df, keys, list(order))
    applied = read_if_there(spark, f"{path}/_applied/{writer}", "batch_id bigint").agg(F.max("batch_id")).first()[0]
    if applied is not None and applied >= batch_id:
        return one
    held = _buckets(spark, path)
    if held is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")
    n = held or buckets
    placed = one.withColumn(BUCKET, _bucket(key, n))
    staged = placed
    if held:
        ids = df.select(*keys).withColumn(BUCKET, _bucket(key, n))
        touched = [r[0] for r in ids.select(BUCKET).distinct().collect()]  # one per bucket at most
        old = _table(spark, path, df.schema).where(F.col(BUCKET).isin(touched))
        staged = old.join(ids, [BUCKET, *keys], "left_anti").unionByName(placed)
    staged.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/_staged/rows")
    spark.createDataFrame([(writer, batch_id)], STAGED).coalesce(1).write.mode("overwrite").parquet(f"{path}/_staged/ready")
    _settle(spark, path, df.schema)
    return one


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_if_there(spark, path, StructType([*schema.fields, BUCKET_FIELD]))


def read_upserted(spark: SparkSession, path: str, key: str | list[str] = "doc_id", schema: StructType = SCORED) -> DataFrame:
    """The current row of every key; empty before the first batch.  What is read does not grow with
    the number of batches."""
    return _table(spark, path, schema).select(*schema.names)


def look_up(spark: SparkSession, path: str, value: object, key: str = "doc_id", schema: StructType = SCORED) -> DataFrame:
    """The row of one key, or none; only the folder of its bucket is read."""
    n = _buckets(spark, path) or 1
    wanted = F.lit(value).cast(schema[key].dataType)
    rows = _table(spark, path, schema).where(F.col(BUCKET) == _bucket(key, n, [wanted]))
    return rows.where(F.col(key) == wanted).select(*schema.names)


def _versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_if_there(spark, path, StructType([*schema.fields, *VERSION.fields]))


# --- ids of an archive --------------------------------------------------------------------------


def _prefix() -> Column:
    return F.coalesce(F.lower(F.substring("doc_id", 1, 1)), F.lit(""))


def read_ids(spark: SparkSession, path: str, without: tuple[int, int], of: DataFrame) -> DataFrame:
    """The ids written by all batches but one (run and batch), of the prefixes that ``of`` has.

    Ids lie in a folder per first character, so a small batch reads a part of them.
    """
    wanted = [r[0] for r in of.select(_prefix()).distinct().collect()]  # one row per first character
    rows = _versions(spark, path, IDS).where(F.col("prefix").isin(wanted))
    return rows.where(~((F.col(RUN) == without[0]) & (F.col(BATCH) == without[1]))).select("doc_id")


def write_ids(df: DataFrame, path: str, batch_id: int, run: int = 0) -> None:
    ids = df.select("doc_id", _prefix().alias("prefix"))
    ids.write.mode("overwrite").partitionBy("prefix").parquet(_folder(path, run, batch_id))


def compact(
    spark: SparkSession, path: str, target: str, key: str | list[str] = "doc_id", schema: StructType = SCORED,
    buckets: int = BUCKETS,
) -> None:
    """Writes the current rows as a new table of another number of buckets, leaving the old one alone."""
    rows = read_upserted(spark, path, key, schema).withColumn(BUCKET, _bucket(key, buckets))
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(target)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{target}/_layout")


def ensure_table(spark: SparkSession, name: str, schema: StructType = SCORED) -> str:
    """``exists``, ``created`` or ``failed``."""
    try:
        if spark.catalog.tableExists(name):
            return "exists"
        spark.catalog.createTable(name, schema=schema, source="parquet")
        return "created"
    except Exception:
        return "failed"


def export_keywords(table: DataFrame, path: str) -> DataFrame:
    """Writes lines ``{category: [keywords]}``; returns the counts written.

    It is what `read_category_json` reads.  The keywords of a category are dealt to lines of
    about LINE_KEYWORDS, so a dictionary of any size is written by many tasks; lines and the
    keywords in them are sorted.
    """
    rows = table.select("category", "keyword").distinct()
    counts = rows.groupBy("category").agg(F.count("keyword").alias("n"))
    lines = F.ceil(F.col("n") / LINE_KEYWORDS)
    dealt = rows.join(counts, "category").withColumn("line", F.pmod(F.xxhash64("keyword"), lines))
    lists = dealt.groupBy("category", "line").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    text = F.to_json(F.create_map("category", "keywords")).alias("value")
    lists.orderBy("category", "line").select(text).write.mode("overwrite").text(path)
    return counts.rollup("category").agg(F.sum("n").alias("keywords"))


def append_audit(df: DataFrame, path: str) -> None:
    """Appends decision rows (`classification_audit`, `sentiment_audit`) to a log directory."""
    df.write.mode("append").csv(path)


def sentiment_audit(df: DataFrame) -> DataFrame:
    """One row per article: the source chosen, both inputs and their distance."""
    return df.select(
        "doc_id", "sentiment_source", "api_sentiment", "api_confidence", "model_sentiment",
        "model_confidence", F.abs(F.col("api_sentiment") - F.col("model_sentiment")).alias("diff"),
        "sentiment", "confidence",
    )
