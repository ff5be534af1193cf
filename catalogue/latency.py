"""Throughput and latency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import query, r9, with_ctes
from tapewire.operators import metrics
from tapewire.plans import driver_tables as tables
from tapewire.plans.driver_tables import PIPELINES_EXAMPLE

_HALF = "CAST(floor({} + 0.5) AS BIGINT)"


def _ev(spark, d):
    return tables.metric_events(spark, d)


_MIN = """, mc AS (SELECT pipeline, ts_ms // 60000 AS minute, count(*) AS processed FROM ev WHERE status < 400 GROUP BY ALL)"""


@query(with_ctes("ev", _MIN + " SELECT pipeline, minute, processed FROM mc"))
def minute_counts(spark, d):
    return metrics.minute_counts(_ev(spark, d))


@query(with_ctes("ev", _MIN + """, w AS (SELECT pipeline, minute, processed, (sum(processed) OVER (PARTITION BY pipeline ORDER BY minute
    RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))::BIGINT AS processed_window FROM mc)
    SELECT pipeline, minute, processed, processed_window, floor(processed_window / 5 * 100 + 0.5) / 100 AS throughput FROM w"""))
def throughput_5min(spark, d):
    return metrics.rolling_sum(metrics.minute_counts(_ev(spark, d)))


_NAMES = ", ".join(f"('{p}')" for p in PIPELINES_EXAMPLE)
_RATE = f"""names AS (SELECT * FROM (VALUES {_NAMES}) t(pipeline)), now AS (SELECT max(ts_ms) // 60000 AS m FROM ev),
    rate AS (SELECT names.pipeline, floor(count(e.event_id) / 5 * 100 + 0.5) / 100 AS throughput FROM names LEFT JOIN
      (SELECT * FROM ev, now WHERE status < 400 AND ts_ms // 60000 BETWEEN m - 4 AND m) e ON e.pipeline = names.pipeline GROUP BY 1)"""


def _as_of(events):
    return events.agg(F.max("ts_ms")).scalar()


@query(with_ctes("ev", f", {_RATE} SELECT pipeline, throughput FROM rate"))
def throughput_as_of(spark, d):
    events = _ev(spark, d)
    return metrics.throughput(events, _as_of(events), PIPELINES_EXAMPLE)


def _latency(source: str) -> str:
    picks = ", ".join(f"{_HALF.format(f'quantile_disc(latency_ms, {p})')} AS {n}" for n, p in metrics.PERCENTILES.items())
    return f"SELECT pipeline, {picks}, {_HALF.format('avg(latency_ms)')} AS avg FROM {source} GROUP BY pipeline"


@query(with_ctes("ev", _latency("ev")))
def latency_percentiles(spark, d):
    return metrics.latency_percentiles(_ev(spark, d), PIPELINES_EXAMPLE)


_LAST = """last1000 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY ts_ms DESC, event_id DESC) <= 1000)"""


@query(with_ctes("ev", f", {_LAST} " + _latency("last1000")))
def latency_last_1000(spark, d):
    return metrics.latency_of_samples(metrics.last_samples(_ev(spark, d)))


@query(with_ctes("ev", f", {_LAST} SELECT pipeline, event_id, ts_ms, latency_ms FROM last1000"))
def last_samples(spark, d):
    return metrics.last_samples(_ev(spark, d)).select("pipeline", "event_id", "ts_ms", "latency_ms")


@query(with_ctes("ev", """SELECT pipeline, count(*) FILTER (status < 400) AS processed, count(*) AS requests,
    round(avg(latency_ms), 9) AS avg_latency FROM ev GROUP BY pipeline"""))
def request_metrics(spark, d):
    return metrics.request_metrics(_ev(spark, d)).withColumn("avg_latency", r9("avg_latency"))


_REPORT = f""", {_RATE}, {_LAST}, alive AS (SELECT * FROM last1000 WHERE pipeline IN (
      SELECT pipeline FROM ev GROUP BY pipeline HAVING max(ts_ms) > (SELECT max(ts_ms) FROM ev) - 3600000)),
    lat AS ({_latency('alive')}),
    report AS (SELECT rate.pipeline, throughput, coalesce(p50, 0) AS p50, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99,
      coalesce(avg, 0) AS avg FROM rate LEFT JOIN lat USING (pipeline))"""


@query(with_ctes("ev", _REPORT + " SELECT * FROM report"))
def metrics_report(spark, d):
    events = _ev(spark, d)
    return metrics.metrics_report(events, _as_of(events), PIPELINES_EXAMPLE)


@query(with_ctes("ev", _REPORT + """ SELECT pipeline, upper(left(pipeline, 1)) || substring(pipeline, 2) AS label, metric, value FROM (
    UNPIVOT (SELECT pipeline, throughput::DOUBLE AS throughput, p50::DOUBLE AS p50, p95::DOUBLE AS p95, p99::DOUBLE AS p99,
      avg::DOUBLE AS avg FROM report) ON throughput, p50, p95, p99, avg INTO NAME metric VALUE value)"""))
def metrics_long(spark, d):
    events = _ev(spark, d)
    return metrics.metrics_long(metrics.metrics_report(events, _as_of(events), PIPELINES_EXAMPLE))
