import math
import random

import pytest
from pyspark.sql import functions as F

from tapewire.sources import work_dir
from tapewire.operators import dedup, metrics, rollups
from tapewire.operators.topn import top_n_per_key

H = 3_600_000


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.4
        rows.append((
            f"d{i:03d}", "S0" if hot else f"S{rng.randint(1, 5)}", rng.choice(["E", None, ""]),
            "A" if hot else rng.choice(["B", "J", "K", None]), rng.choice([None, rng.randint(0, 40) * H // 2]),
            rng.uniform(-2, 2), rng.uniform(-1, 1), 0.1, 0.2, rng.choice(["x", "y", "z"]),
        ))
    return spark.createDataFrame(
        rows, "doc_id string, symbol string, entity_name string, category string, publishedAt bigint, final_score double, "
        "sentiment double, risk_raw double, risk_adj double, source string",
    ).repartition(7).cache()


def test_hour_grid_and_pivot_agree(scored):
    grid = rollups.fill_hour_grid(rollups.hourly_category_counts(scored))
    hours = grid.select("hour").distinct().count()
    names = grid.select("category").distinct().count()
    assert grid.count() == hours * names
    wide = {r["hour"]: r.asDict() for r in rollups.hourly_categories(scored, 12).collect()}
    assert len(wide) == min(12, hours) and list(wide) == sorted(wide)
    for r in grid.collect():
        if r["hour"] in wide:
            assert wide[r["hour"]][r["category"]] == r["n"]
    totals = {(r["hour"], r["category"]): r["n"] for r in rollups.hourly_totals(scored).collect()}
    assert totals[None, None] == scored.where("publishedAt is not null").count()


def test_hourly_sentiment_last_hours(scored):
    rows = rollups.hourly_sentiment(scored, 5).collect()
    everything = rollups.hourly_sentiment(scored, None).orderBy("hour").collect()
    assert rows == everything[-5:]
    assert all(r["time"] >= r["hour"] and r["time"] < r["hour"] + H for r in rows)


def test_facets_cap_and_order(scored):
    top = rollups.facets(scored, ["category", "source"], 2).collect()
    assert sorted((r["facet"], r["value"]) for r in top if r["facet"] == "category")[0][1] == "A"
    assert len(top) == 4 and all(r["value"] is not None for r in top)


def test_symbol_series_equals_history(scored):
    series = rollups.symbol_series(scored, 30).collect()
    for symbol in ("S0", "S3"):
        mine = sorted((r["position"], r["publishedAt"], r["final_score"]) for r in series if r["symbol"] == symbol)
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        rows = rollups.symbol_history(scored.where("publishedAt is not null"), symbol, 30).collect()
        assert sorted(r["ts"] for r in rows) == [t for _, t, _ in mine]
    with pytest.raises(ValueError):
        rollups.symbol_history(scored, "S0", 10_001)


@pytest.mark.parametrize("n", [1, 3, 20, 1500])
def test_top_n_with_a_hot_key(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", rng.randint(0, 50), i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(9)
    got = {}
    for r in top_n_per_key(df, ["k"], [F.desc("v"), F.asc("i")], n, rank="r").collect():
        got.setdefault(r["k"], []).append((r["r"], r["v"], r["i"]))
    for key in {k for k, _, _ in rows}:
        want = sorted(((v, i) for k, v, i in rows if k == key), key=lambda t: (-t[0], t[1]))[:n]
        assert sorted(got[key]) == [(j + 1, v, i) for j, (v, i) in enumerate(want)]


def test_top_n_cuts_before_the_shuffle(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), "id")
    for n in (1, 100):
        plan = top_n_per_key(df, ["k"], [F.desc("id")], n)._jdf.queryExecution().executedPlan().toString()
        assert "Partial" in plan and "WindowGroupLimit" in plan


DATA = {
    "one": [5.0], "same": [2.0] * 300, "uniform": [random.Random(1).uniform(0, 1000) for _ in range(5000)],
    "tail": [random.Random(2).paretovariate(0.7) for _ in range(5000)], "outlier": [1.0 + i / 1e6 for i in range(999)] + [1e12],
    "negative": [-float(i) for i in range(777)],
}


@pytest.mark.parametrize("buckets, few", [(1024, 50_000), (8, 10), (4, 1)])
def test_exact_percentiles(spark, buckets, few):
    rows = [(k, v) for k, vs in DATA.items() for v in vs] + [("one", None), ("unnamed", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(11)
    probabilities = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in metrics.exact_percentiles(df, "k", list(DATA), "v", probabilities, buckets, few).collect()}
    assert set(got) == set(DATA)
    for key, values in DATA.items():
        ordered = sorted(values)
        for name, p in probabilities.items():
            assert got[key][name] == ordered[max(0, math.ceil(len(ordered) * p) - 1)], (key, name)


def test_percentiles_of_a_heavy_tail_order_few_values(spark, monkeypatch):
    """Values spread over twelve powers of ten: no pass orders more distinct values than buckets or ``few``."""
    df = spark.range(40_000).select(F.lit("k").alias("k"), F.pow(F.lit(10.0), F.rand(3) * 12).alias("v"))
    df.write.parquet(path := work_dir(spark, "tail"))
    df = spark.read.parquet(path)
    sizes, collect = [], metrics.Window.partitionBy

    def counted(*keys):
        sizes.append(keys)
        return collect(*keys)

    monkeypatch.setattr(metrics.Window, "partitionBy", counted)
    got = metrics.exact_percentiles(df, "k", ["k"], "v", buckets=64, few=100).first()
    values = sorted(r["v"] for r in df.collect())
    assert (got["p50"], got["p99"]) == (values[19_999], values[39_599])
    assert len(sizes) > 3  # it went on narrowing


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = [(i, "backend" if rng.random() < 0.6 else "extract", rng.randint(0, 30 * 60_000), float(rng.randint(1, 400)),
             rng.choice([200, 200, 404, 500])) for i in range(4000)]
    return spark.createDataFrame(rows, "event_id long, pipeline string, ts_ms long, latency_ms double, status int").repartition(6).cache()


def test_metrics_report(events):
    rows = events.collect()
    as_of = max(r["ts_ms"] for r in rows)
    got = {r["pipeline"]: r for r in metrics.metrics_report(events, F.lit(as_of)).collect()}
    assert set(got) == {"extract", "transform", "backend", "baseline"}
    assert tuple(got["baseline"])[1:] == (0.0, 0, 0, 0, 0)
    for name in ("backend", "extract"):
        mine = [r for r in rows if r["pipeline"] == name]
        recent = sum(1 for r in mine if r["status"] < 400 and as_of // 60000 - 4 <= r["ts_ms"] // 60000)
        assert got[name]["throughput"] == pytest.approx(math.floor(recent / 5 * 100 + 0.5) / 100)
        last = sorted(r["latency_ms"] for r in sorted(mine, key=lambda r: (-r["ts_ms"], -r["event_id"]))[:1000])
        assert got[name]["p95"] == math.floor(last[math.ceil(len(last) * 0.95) - 1] + 0.5)
        assert got[name]["avg"] == math.floor(sum(last) / len(last) + 0.5)
    long = metrics.metrics_long(metrics.metrics_report(events, F.lit(as_of))).collect()
    assert len(long) == 20 and {r["label"] for r in long} == {"Extract", "Transform", "Backend", "Baseline"}


def test_idle_pipelines_expire(events):
    as_of = F.lit(31 * 60_000 + H)
    assert metrics.last_samples(events, 10, as_of).count() == 0
    assert metrics.last_samples(events, 10).count() == 20


def test_rolling_sum(events):
    rows = metrics.rolling_sum(metrics.minute_counts(events)).collect()
    counts = {(r["pipeline"], r["minute"]): r["processed"] for r in rows}
    for r in rows:
        want = sum(counts.get((r["pipeline"], r["minute"] - i), 0) for i in range(5))
        assert r["processed_window"] == want and r["throughput"] == pytest.approx(math.floor(want / 5 * 100 + 0.5) / 100)


def test_rounding_half_up(column):
    assert column(metrics.round_half_up, [0.5, 1.5, -0.5, 2.4], "double") == [1, 2, 0, 2]


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1, ["X"]), ("a", 3, ["Y", "X"]), ("b", 2, ["Z"]), ("c", 4, [])], "doc_id string, seq int, symbols array<string>")
    archive = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "doc_id string")
    assert {(r["doc_id"], r["seq"]) for r in dedup.new_articles(df, archive, "seq").collect()} == {("a", 3), ("c", 4)}
    assert [tuple(r) for r in dedup.seen_articles(df, archive).collect()] == [("b", 1)]
    assert tuple(dedup.batch_summary(df, archive).first()) == (4, 2, 1)
    assert tuple(dedup.batch_summary(df.limit(0), archive).first()) == (0, 0, 0)
    assert dict(dedup.merge_tickers(df, "seq").collect()) == {"a": ["X", "Y"], "b": ["Z"]}


def test_new_articles_move_ids_first(spark):
    spark.range(50).selectExpr("cast(id % 9 as string) doc_id", "id seq", "repeat('text', 99) content").write.parquet(path := work_dir(spark, "raw"))
    df, archive = spark.read.parquet(path), spark.createDataFrame([("1",)], "doc_id string")
    plan = dedup.new_articles(df, archive, "seq")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert any("content" not in line for line in scans)
    first = plan[plan.rindex("HashAggregate"):]
    assert "content" not in first
