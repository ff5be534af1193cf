"""The streaming state of latency samples."""

import pandas as pd
import pytest

from tapewire.streaming import jobs
from tapewire.streaming.samples import COLUMNS, LatestSamples, current_samples

H = 3_600_000
KIND = "event_id bigint, pipeline string, ts_ms bigint, latency_ms double, status int"


def write(spark, rows, path):
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "timestamp_millis(ts_ms) AS ts")
    df.coalesce(1).write.mode("append").parquet(path)


def run(spark, inbox, where, state, n):
    stream = spark.readStream.schema(f"{KIND}, ts timestamp").parquet(inbox)
    jobs.start_last_samples(stream, where, state, n).awaitTermination()


def test_samples_expire_and_survive_restarts(spark, tmp_path):
    inbox, where, state = (str(tmp_path / x) for x in ("inbox", "table", "state"))
    batches = [
        [(i, "busy", 1_000 * i, 1.0 * i, 200) for i in range(40)] + [(100 + i, "idle", 5_000 + i, 2.0, 500) for i in range(3)],
        [(200 + i, "busy", 50_000 + i, 3.0, 200) for i in range(5)] + [(300, None, 60_000, 1.0, 200), (301, "busy", None, 1.0, 200)],
        [(400, "late", H + 40_000, 4.0, 200)],
    ]
    seen = []
    for k, rows in enumerate(batches):
        write(spark, rows, inbox if k < 2 else f"{inbox}2")
        run(spark, inbox if k < 2 else f"{inbox}2", where, state if k < 2 else f"{state}2", 12)  # the third has a checkpoint of its own
        seen += [r for r in rows if r[1] is not None and r[2] is not None]
        newest = max(r[2] for r in seen)
        want = set()
        for name in {r[1] for r in seen}:
            own = sorted((r for r in seen if r[1] == name and r[2] > newest - H), key=lambda r: (-r[2], -r[0]))
            want |= {(r[1], r[0], r[2], r[3], r[4]) for r in own[:12]}
        assert {tuple(r) for r in jobs.read_samples(spark, where, 12).collect()} == want
    assert "idle" not in {r[0] for r in want}


class Handle:
    """What the processor needs of Spark's handle."""

    def __init__(self):
        self.rows, self.timers = [], set()

    def getListState(self, name, schema):
        return self

    exists = lambda self: bool(self.rows)
    get = lambda self: iter(self.rows)
    put = lambda self, rows: setattr(self, "rows", rows)
    clear = lambda self: setattr(self, "rows", [])
    listTimers = lambda self: iter(self.timers)
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


class Clock:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_state_is_bounded_and_cleared_by_its_timer():
    handle, processor = Handle(), LatestSamples(3)
    processor.init(handle)
    rows = pd.DataFrame([(10 * i, i, 0.5, 200) for i in range(8)], columns=COLUMNS)
    (out,) = processor.handleInputRows(("p", 1), iter([rows[:4], rows[4:]]), Clock(0))
    assert out["event_id"][0] == [7, 6, 5] and len(handle.rows) == 3 and handle.timers == {70 + H}
    (out,) = processor.handleInputRows(("p", 1), iter([rows[:1]]), Clock(55 + H))
    assert out["event_id"][0] == [7, 6] and handle.timers == {70 + H}
    (out,) = processor.handleExpiredTimer(("p", 1), Clock(71 + H), None)
    assert out["event_id"][0] == [] and not handle.rows and not handle.timers


def test_current_samples_of_an_empty_table(spark):
    from tapewire.streaming.samples import KEPT

    assert current_samples(spark.createDataFrame([], KEPT), 5).collect() == []


@pytest.mark.parametrize("hour", [True, False])
def test_splits_of_a_pipeline_are_one(spark, hour):
    rows = [("p", 0, [5, H + 9], [1, 2], [1.0, 2.0], [200, 200]), ("p", 1, [H + 8, H + 7], [3, 4], [1.0, 1.0], [200, 500]), ("q", 0, [], [], [], [])]
    kept = spark.createDataFrame(rows, "pipeline string, split int, ts_ms array<bigint>, event_id array<bigint>, latency_ms array<double>, status array<int>")
    assert sorted(r["event_id"] for r in current_samples(kept, 2, hour).collect()) == [2, 3]
    assert sorted(r["event_id"] for r in current_samples(kept, 9, hour).collect()) == ([2, 3, 4] if hour else [1, 2, 3, 4])


def test_samples_stay_without_expiry(spark, tmp_path):
    """The latest of a pipeline stay, however far another one is ahead, and an old event still counts."""
    inbox, where, state = (str(tmp_path / x) for x in ("inbox", "table", "state"))
    batches = [[(i, "old", 1_000 * i, 1.0, 200) for i in range(9)], [(50, "new", 9 * H, 2.0, 200)], [(60, "old", 4_500, 3.0, 500), (61, "new", 1, 3.0, 200)]]
    for k, rows in enumerate(batches):
        write(spark, rows, inbox if k < 2 else f"{inbox}2")
        stream = spark.readStream.schema(f"{KIND}, ts timestamp").parquet(inbox if k < 2 else f"{inbox}2")
        jobs.start_last_samples(stream, where, state if k < 2 else f"{state}2", 5, expiry=None).awaitTermination()
    got = {(r["pipeline"], r["event_id"]) for r in jobs.read_samples(spark, where, 5, hour=False).collect()}
    assert got == {("old", 8), ("old", 7), ("old", 6), ("old", 5), ("old", 60), ("new", 50), ("new", 61)}


def test_rows_are_cut_before_the_state(spark, monkeypatch):
    from tapewire.streaming import samples

    monkeypatch.setattr(samples, "HELD", 64)
    rows = [(f"p{i % 3}", i % 2, 7 * i % 50, i, 1.0, None if i % 5 else 200) for i in range(400)]
    df = spark.createDataFrame(rows, "pipeline string, split int, ts_ms bigint, event_id bigint, latency_ms double, status int").coalesce(1)
    got = {tuple(r) for r in samples.cut_samples(df, 4).collect()}
    best = {}
    for r in rows:
        best.setdefault(r[:2], []).append(r)
    want = {r for own in best.values() for r in sorted(own, key=lambda r: (-r[2], -r[3]))[:4]}
    assert want <= got and len(got) < 200
