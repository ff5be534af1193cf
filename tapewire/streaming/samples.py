"""Latest latency samples as streaming state: bounded per pipeline, gone after an hour of event time unless they are to stay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapewire.functions.identity import HOUR_MS

#: Keys that a pipeline is dealt to, so that a busy one is no single task.
SPLITS = 16
#: Samples that a task holds while it cuts its rows; beyond that it sends what it has.
HELD = 1 << 19
STATE = "ts_ms bigint, event_id bigint, latency_ms double, status int"
COLUMNS = ["ts_ms", "event_id", "latency_ms", "status"]
KEPT = "pipeline string, split int, ts_ms array<bigint>, event_id array<bigint>, latency_ms array<double>, status array<int>"


class LatestSamples(StatefulProcessor):
    """The latest ``n`` samples of a key; none older than ``expiry`` before the watermark.

    A timer clears a key that has been idle for that long.  Without ``expiry`` samples stay until
    later ones take their place.
    """

    def __init__(self, n: int, expiry: int | None = HOUR_MS) -> None:
        self.n, self.expiry = n, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", STATE)

    def _keep(self, held: pd.DataFrame, watermark: int) -> pd.DataFrame:
        if self.expiry is not None:
            held = held[held["ts_ms"] > watermark - self.expiry]
        return held.sort_values(["ts_ms", "event_id"], ascending=False).head(self.n)

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.samples.get()) if self.samples.exists() else [], columns=COLUMNS)

    def _put(self, key, held: pd.DataFrame) -> pd.DataFrame:
        if self.expiry is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if len(held):
            self.samples.put([(int(t), int(e), float(x), int(s)) for t, e, x, s in held[COLUMNS].itertuples(index=False)])
            if self.expiry is not None:
                self.handle.registerTimer(int(held["ts_ms"].max()) + self.expiry)
        else:
            self.samples.clear()
        return pd.DataFrame({"pipeline": [key[0]], "split": [key[1]], **{c: [held[c].tolist()] for c in COLUMNS}})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, watermark = self._held(), 0 if self.expiry is None else timerValues.getCurrentWatermarkInMs()
        for more in rows:
            held = self._keep(pd.concat([held, more[COLUMNS]]) if len(held) else more[COLUMNS], watermark)
        yield self._put(key, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._put(key, self._keep(self._held(), timerValues.getCurrentWatermarkInMs()))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            row = initialState.iloc[0]
            held = pd.DataFrame({c: list(row[c]) for c in COLUMNS})
            self._put(key, held.sort_values(["ts_ms", "event_id"], ascending=False).head(self.n))

    def close(self) -> None:
        pass


def _cut(rows: pa.Table, n: int) -> pa.Table:
    """The latest ``n`` rows of each pipeline and split."""
    keys = rows.select(["pipeline", "split", "ts_ms", "event_id"]).to_pandas()
    keys = keys.sort_values(["ts_ms", "event_id"], ascending=False).groupby(["pipeline", "split"], sort=False).head(n)
    return rows.take(pa.array(keys.index))


def cut_samples(df: DataFrame, n: int) -> DataFrame:
    """The rows that can be among the latest ``n`` of their pipeline and split, as far as each input
    partition tells: the others are not sent to the state."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, bound = 0, HELD // 8
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= bound:
                kept = _cut(pa.Table.from_batches(held), n)
                if kept.num_rows >= HELD // 2:  # very many pipelines: few rows would go
                    yield from kept.to_batches()
                    kept = kept.slice(0, 0)
                held, size = kept.to_batches(), kept.num_rows
                bound = max(HELD // 8, 2 * size)
        if size:
            yield from _cut(pa.Table.from_batches(held), n).to_batches()

    return df.mapInArrow(cut, df.schema)


def latest_samples(events: DataFrame, n: int, kept: DataFrame, delay: str = "0 seconds", expiry: int | None = HOUR_MS) -> DataFrame:
    """The state of each key that changes, as one row of ``KEPT``.  ``kept`` is where a query without
    a checkpoint of its own goes on from.  Without ``expiry`` no event is too late and none gets too old."""
    columns = ["pipeline", "ts", F.pmod(F.xxhash64("event_id"), F.lit(SPLITS)).cast("int").alias("split"), *COLUMNS]
    keyed = cut_samples(events.where("ts_ms IS NOT NULL AND pipeline IS NOT NULL").select(*columns), n)
    if expiry is not None:
        keyed = keyed.withWatermark("ts", delay)
    return keyed.groupBy("pipeline", "split").transformWithStateInPandas(
        LatestSamples(n, expiry), outputStructType=KEPT, outputMode="Update", timeMode="None" if expiry is None else "EventTime",
        initialState=kept.groupBy("pipeline", "split"),
    )


def current_samples(kept: DataFrame, n: int, hour: bool = True) -> DataFrame:
    """``pipeline, event_id, ts_ms, latency_ms, status``: the latest ``n`` of each pipeline, of the
    hour before the newest sample of all."""
    from tapewire.operators.metrics import last_samples

    rows = kept.select("pipeline", F.explode(F.arrays_zip(*COLUMNS)).alias("s")).select("pipeline", "s.*")
    if hour:
        newest = kept.agg(F.max(F.array_max("ts_ms")).alias("_newest"))  # one row
        rows = rows.join(F.broadcast(newest), F.col("ts_ms") > F.col("_newest") - HOUR_MS).drop("_newest")
    return last_samples(rows, n).select("pipeline", "event_id", "ts_ms", "latency_ms", "status")
