"""Structured Streaming jobs.

Scoring is plain column work on the stream; ``foreachBatch`` holds only the keyed
write.  A failing batch raises, so its offsets are not committed and it is retried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tapewire.functions.identity import HOUR_MS
from tapewire.operators.dedup import archived_ids
from tapewire.operators.metrics import SAMPLES, round_half_up
from tapewire.operators.segments import add_segment
from tapewire.operators.topn import latest_per_id
from tapewire.plans.scoring import score_articles
from tapewire.sources.readers import read_archive
from tapewire.sources.sinks import (
    checkpoint_id, read_ids, read_upserted, run_number, stored, upsert, write_ids,
)
from tapewire.streaming.samples import KEPT, current_samples, latest_samples

POLL = "10 minutes"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DEDUP_SPLITS = 32


#: Of copies of an article in one batch, the one published last stays.
LATEST = ("publishedAt",)


def _run(batch: DataFrame, path: str, checkpoint: str) -> int:
    spark = batch.sparkSession
    return run_number(spark, path, checkpoint_id(spark, checkpoint))


def upsert_batch(
    path: str, checkpoint: str, order: Sequence[str] = LATEST, key: str | list[str] = "doc_id", index_path: str | None = None
) -> Callable[[DataFrame, int], None]:
    """Per-batch function: skip an empty batch, else insert or replace its rows, in the table and,
    if there is one, in the search index beside it (see `segments.read_segments`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = upsert(batch, path, batch_id, order, key, checkpoint_id(batch.sparkSession, checkpoint))
        if index_path:
            add_segment(rows, index_path, segment_number(_run(batch, index_path, checkpoint), batch_id))

    return write


def segment_number(run: int, batch_id: int) -> int:
    """Later runs have higher numbers than all batches of earlier ones."""
    return run * 10**12 + batch_id


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def start_scoring(
    decoded: DataFrame, path: str, checkpoint: str, every: str | None = None, index_path: str | None = None,
    **word_lists: list[str],
) -> StreamingQuery:
    """Scores decoded messages and keeps the table at ``path``, and the index at ``index_path``, current.

    Without ``every`` the query drains what is there and stops.
    """
    writer = (
        score_articles(decoded, **word_lists)
        .writeStream.outputMode("append")
        .foreachBatch(upsert_batch(path, checkpoint, index_path=index_path))
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, every).start()


def seed_ids(archive: DataFrame, ids_path: str) -> None:
    """Starts the id table of `start_ingest` from an archive that exists already."""
    write_ids(archived_ids(archive), ids_path, -1)  # older than all that runs write


def start_ingest(
    payloads: DataFrame,
    archive_path: str,
    checkpoint: str,
    seq: str,
    every: str | None = POLL,
    ids_path: str | None = None,
) -> StreamingQuery:
    """Appends the payloads of each poll that are not archived yet; of copies the last by ``seq``.

    Each batch goes to a folder of its run and its own, replaced when the batch is retried,
    and a batch never counts its own folder as archived.  What is archived is read anew per batch:
    from the archive itself, or, once it has grown, from a table of nothing but ids that
    is kept beside it at ``ids_path`` (see `seed_ids`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark, run = batch.sparkSession, _run(batch, archive_path, checkpoint)
        own = f"run-{run:06d}-batch-{batch_id:09d}"
        if ids_path:
            known = read_ids(spark, ids_path, without=(run, batch_id), of=batch)
        else:
            known = archived_ids(read_archive(spark, archive_path, without=own))
        fresh = latest_per_id(batch, "doc_id", [seq]).join(known, "doc_id", "left_anti")
        fresh.write.mode("overwrite").json(f"{archive_path}/{own}")
        if ids_path:
            write_ids(read_archive(spark, f"{archive_path}/{own}"), ids_path, batch_id, run)

    writer = payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def stream_dedup(stream: DataFrame, ts: str, horizon: str, key: str = "doc_id") -> DataFrame:
    """Drops copies that arrive within ``horizon`` of the first; state stays bounded by it.

    Copies are first dropped per group of input partitions, so that a text sent over and
    over does not meet in one task.  For a dedup against everything ever seen use
    `start_ingest`.
    """
    spread = stream.withWatermark(ts, horizon).withColumn("_split", F.pmod(F.spark_partition_id(), F.lit(DEDUP_SPLITS)))
    fewer = spread.dropDuplicatesWithinWatermark([key, "_split"]).drop("_split")
    return fewer.dropDuplicatesWithinWatermark([key])


def stream_minute_counts(events: DataFrame, expiry: str = "1 hour") -> DataFrame:
    """Successful requests per pipeline and minute; a minute closes after ``expiry``."""
    return (
        events.withWatermark("ts", expiry)
        .where(F.col("status") < 400)
        .groupBy("pipeline", F.window("ts", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("processed"))
        .select("pipeline", F.unix_millis("w.start").alias("start_ms"), "processed")
    )


def start_minute_counts(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps the counts of open and closed minutes current under ``path``."""
    writer = (
        stream_minute_counts(events)
        .writeStream.outputMode("update")
        .foreachBatch(upsert_batch(path, checkpoint, ("processed",), ["pipeline", "start_ms"]))
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, every).start()


def stream_throughput(events: DataFrame, expiry: str = "1 hour") -> DataFrame:
    """Successful requests per minute over sliding five minutes."""
    return (
        events.withWatermark("ts", expiry)
        .where(F.col("status") < 400)
        .groupBy("pipeline", F.window("ts", "5 minutes", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("processed"))
        .select(
            "pipeline",
            F.unix_millis("w.end").alias("end_ms"),
            round_half_up(F.col("processed") / 5, 2).alias("throughput"),
        )
    )


def start_last_samples(
    events: DataFrame, path: str, checkpoint: str, n: int = SAMPLES, every: str | None = None, delay: str = "0 seconds",
    expiry: int | None = HOUR_MS,
) -> StreamingQuery:
    """Keeps the latest ``n`` latency samples per pipeline of the last hour of event time under ``path``.

    The samples are state that expires, and what changes is written; a query with a new checkpoint
    goes on from what is there.  Events more than ``delay`` behind the newest may be too late.  With
    ``expiry=None`` the latest ``n`` stay however old they are, and no event is too late.  Read them
    with `read_samples`.
    """
    spark = events.sparkSession
    kept = read_upserted(spark, path, ["pipeline", "split"], _parsed(KEPT))
    put = upsert_batch(path, checkpoint, ("pipeline",), ["pipeline", "split"])

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written once, so that the steps of an upsert do not each run the state anew.
        put(stored(batch, "changed_samples"), batch_id)

    writer = (
        latest_samples(events, n, kept, delay, expiry)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    # Timers and lists need this store; a query keeps the one it was started with.
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _trigger(writer, every).start()
    finally:
        spark.conf.set(STATE_STORE, before)


def read_samples(spark: SparkSession, path: str, n: int = SAMPLES, hour: bool = True) -> DataFrame:
    """The samples that `start_last_samples` keeps, of the hour before the newest of them or all."""
    return current_samples(read_upserted(spark, path, ["pipeline", "split"], _parsed(KEPT)), n, hour)


def _parsed(schema: str) -> StructType:
    return StructType.fromDDL(schema)
