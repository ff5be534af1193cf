"""Throughput and latency of request events ``(event_id, pipeline, ts_ms, latency_ms, status)``.

Time is event time in epoch milliseconds; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewire.fixed_values import PIPELINES
from tapewire.functions.identity import HOUR_MS, minute_bucket
from tapewire.operators.topn import top_n_per_key

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
WINDOW_MINUTES = 5
SAMPLES = 1000


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds .5 toward plus infinity."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def minute_counts(events: DataFrame) -> DataFrame:
    """Successful requests per pipeline and minute."""
    return (
        events.where(F.col("status") < 400)
        .groupBy("pipeline", minute_bucket(F.col("ts_ms")).alias("minute"))
        .agg(F.count(F.lit(1)).alias("processed"))
    )


def rolling_sum(counts: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Sum over the last minutes, the current one included; one row per minute with data.

    A group holds one row per minute of a pipeline, however many requests it had.
    """
    frame = Window.partitionBy("pipeline").orderBy("minute").rangeBetween(-(minutes - 1), 0)
    return counts.withColumn("processed_window", F.sum("processed").over(frame)).withColumn(
        "throughput", round_half_up(F.col("processed_window") / minutes, 2)
    )


def _names(pipelines: list[str]) -> Column:
    return F.explode(F.array(*[F.lit(p) for p in pipelines])).alias("pipeline")


def throughput(events: DataFrame, as_of: Column, pipelines: list[str] = PIPELINES) -> DataFrame:
    """Requests per minute over the five minute buckets up to ``as_of`` (epoch ms); 0 without any."""
    now = minute_bucket(as_of)
    minute = minute_bucket(F.col("ts_ms"))
    recent = events.where((F.col("status") < 400) & minute.between(now - (WINDOW_MINUTES - 1), now))
    counts = recent.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))
    names = events.sparkSession.range(1).select(_names(pipelines))
    rate = round_half_up(F.coalesce(F.col("n"), F.lit(0)) / WINDOW_MINUTES, 2)
    return names.join(counts, "pipeline", "left").select("pipeline", rate.alias("throughput"))


def last_samples(events: DataFrame, n: int = SAMPLES, as_of: Column | None = None) -> DataFrame:
    """The latest ``n`` samples per pipeline; with ``as_of``, none of a pipeline idle for an hour."""
    kept = top_n_per_key(events, ["pipeline"], [F.desc("ts_ms"), F.desc("event_id")], n)
    if as_of is None:
        return kept
    last = F.max("ts_ms").over(Window.partitionBy("pipeline"))
    return kept.withColumn("_last", last).where(F.col("_last") > as_of - HOUR_MS).drop("_last")


def latency_of_samples(samples: DataFrame) -> DataFrame:
    """Nearest-rank percentiles and mean of bounded samples (see `last_samples`)."""
    picks = [
        F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency_ms)").alias(name)
        for name, p in PERCENTILES.items()
    ]
    found = samples.groupBy("pipeline").agg(*picks, F.avg("latency_ms").alias("avg"))
    return found.select("pipeline", *[round_half_up(F.col(c)).alias(c) for c in [*PERCENTILES, "avg"]])


def exact_percentiles(
    df: DataFrame, key: str, keys: list[str], value: str,
    probabilities: dict[str, float] = PERCENTILES, buckets: int = 1024, few: int = 50_000,
) -> DataFrame:
    """Nearest-rank percentiles and the mean of the named ``keys``, exact for groups of any size.

    Each wanted rank is narrowed down: a pass counts the values in equal buckets between
    two bounds, and the smallest and largest value of the bucket that holds the rank are
    the next bounds, until they are equal or at most ``few`` rows lie between them.  Only
    then are the distinct values left counted and ordered.  Every pass is one scan with
    partial aggregation; the bounds, one row per key and rank, go through the driver.
    A group has values from its first pass on, the mean too; keys without any are left out.
    """
    v = F.col("v")
    data = df.select(key, F.col(value).alias("v")).where(F.col(key).isin(keys) & ~F.isnan(value))
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1)).alias("rank"))
            for name, p in probabilities.items()
        ]
    )
    groups = data.groupBy(key).agg(
        F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean")
    )
    first = groups.select(key, F.inline(ranks), "low", "high", F.col("n").alias("rows"), "mean")
    schema = first.schema
    bounds, done = first.collect(), []

    def narrow(rows: list, bucket: Column) -> DataFrame:
        inside = data.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), key)
        inside = inside.where(v.between(F.col("low"), F.col("high")))
        counted = inside.groupBy(key, "name", "rank", "mean", bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        order = Window.partitionBy(key, "name").orderBy("bucket")
        upto = F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))
        before = F.col("upto") - F.col("c")
        hit = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (before < F.col("rank")))
        return hit.select(key, "name", (F.col("rank") - before).alias("rank"), "low", "high", F.col("c").alias("rows"), "mean")

    width = F.col("high") - F.col("low")
    share = F.when(width > 0, (v - F.col("low")) / width).otherwise(0.0)
    while bounds:
        done += [b for b in bounds if b["low"] == b["high"]]
        bounds = [b for b in bounds if b["low"] != b["high"]]
        wide = [b for b in bounds if b["rows"] > few]
        close = [b for b in bounds if b["rows"] <= few]
        bounds = narrow(close, v).collect() if close else []
        if wide:
            bounds += narrow(wide, F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("double")).collect()
    found = df.sparkSession.createDataFrame(done, schema)
    return found.groupBy(key).agg(
        *[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in probabilities],
        F.first("mean").alias("mean"),
    )


def latency_percentiles(events: DataFrame, pipelines: list[str] = PIPELINES) -> DataFrame:
    """Nearest-rank percentiles and mean over all samples of each named pipeline, as whole numbers.

    Pipelines that are not in the list are left out.
    """
    ranks = exact_percentiles(events, "pipeline", pipelines, "latency_ms").withColumnRenamed("mean", "avg")
    return ranks.select("pipeline", *[round_half_up(F.col(c)).alias(c) for c in [*PERCENTILES, "avg"]])


def request_metrics(events: DataFrame) -> DataFrame:
    """Successful requests are counted; latency is taken over all of them."""
    return events.groupBy("pipeline").agg(
        F.count_if(F.col("status") < 400).alias("processed"),
        F.count(F.lit(1)).alias("requests"),
        F.avg("latency_ms").alias("avg_latency"),
    )


def metrics_report(events: DataFrame, as_of: Column, pipelines: list[str] = PIPELINES) -> DataFrame:
    """Throughput and latency of every named pipeline, zeros where there is nothing."""
    rates = throughput(events, as_of, pipelines)
    latency = latency_of_samples(last_samples(events, as_of=as_of))
    zeros = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in [*PERCENTILES, "avg"]]
    return rates.join(latency, "pipeline", "left").select("pipeline", "throughput", *zeros)


def metrics_long(report: DataFrame) -> DataFrame:
    """Chart rows ``(pipeline, label, metric, value)``."""
    names = ["throughput", *PERCENTILES, "avg"]
    label = F.concat(F.upper(F.substring("pipeline", 1, 1)), F.expr("substring(pipeline, 2)"))
    doubles = [F.col(c).cast("double").alias(c) for c in names]
    return report.select("pipeline", label.alias("label"), *doubles).unpivot(
        ["pipeline", "label"], names, "metric", "value"
    )
