"""Registry of queries and the SQL that checks them.

A query is a function ``(spark, sf_dir) -> DataFrame``; its check is one SQL text over
the same parquet tables.  ``with_ctes`` puts the shared table expressions in front.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewire.fixed_values import IMPACT_SCORES, MA_WORDS, RISK_WORDS
from tapewire.functions.patterns import quote
from tapewire.plans.driver_tables import COMMODITY_EXAMPLE, MA_EXAMPLE_EXTRA

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with its check if there is one."""

    def register(fn: Query) -> Query:
        name = fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r9(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def alternation(words) -> str:
    """Flat pattern, longest word first: what the prefix tree has to be equal to."""
    ordered = sorted({w.lower() for w in words}, key=lambda w: (-len(w), w))
    return "|".join(quote(w) for w in ordered)


def cases(column: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {v if not isinstance(v, str) else text(v)}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {default} END"


SPACE = r"\s\x{85}\x{a0}"
STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^[{SPACE}]+', ''), '[{SPACE}]+$', '')"

_PUB = """CASE n % 6
    WHEN 0 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.123456Z'
    WHEN 1 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S') || 'Z'
    WHEN 2 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+05:00'
    WHEN 3 THEN strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.123+00:00'
    WHEN 4 THEN strftime(moment, '%Y-%m-%d %H:%M:%S')
    ELSE strftime(moment, '%Y-%m-%d') END"""


def parse_ms(pub: str) -> str:
    stamp = f"epoch_ms(CAST(left(replace({pub}, 'T', ' '), 19) AS TIMESTAMP))"
    offset = f"(CAST(substring(right({pub}, 6), 2, 2) AS BIGINT) * 60 + CAST(right({pub}, 2) AS BIGINT)) * 60000"
    return (
        f"CASE WHEN length({pub}) < 19 THEN NULL"
        f" WHEN regexp_matches({pub}, '\\+\\d\\d:\\d\\d$') THEN {stamp} - {offset}"
        f" ELSE {stamp} END"
    )


def _sent(n: str) -> str:
    return f"CAST(({n}) * 37 % 201 - 100 AS DOUBLE) / 100e0"


def _conf(n: str) -> str:
    return f"CAST(({n}) * 53 % 131 AS DOUBLE)"


_ALARM = text(alternation([*RISK_WORDS, *COMMODITY_EXAMPLE]))
_DEAL = text(alternation([*MA_WORDS, *MA_EXAMPLE_EXTRA]))

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), """SELECT doc_id AS n, text, source, lang,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7 AS BIGINT)) AS moment FROM documents"""),
    "msg": (("docs",), f"""SELECT n, substring(text, 1, 80) AS title, substring(text, 1, 200) AS description,
        text AS content, {_PUB} AS pub, source,
        CASE WHEN n % 19 <> 0 THEN {_sent('n')} END AS sentiment,
        CASE WHEN n % 23 <> 0 THEN {_conf('n')} END AS confidence,
        'https://news.example/' || n AS link,
        array_to_string(list_slice(list_filter(string_split_regex(substring(text, 1, 200), '[^\\p{{L}}\\p{{N}}]+'),
            lambda w: w <> ''), 1, 3), ', ') AS key_phrases,
        nullif(substring('ABCDEFGHIJKLMN', n % 15 + 1, 1), '') AS category,
        substring(text, 1, 60) AS summary,
        CASE WHEN n % 3 > 0 THEN 'S' || (n % 10) END AS symbol,
        CASE WHEN n % 3 > 0 THEN 'Company ' || (n % 10) END AS entity_name
        FROM docs"""),
    "filled": (("msg",), """SELECT * REPLACE (coalesce(sentiment, 0e0) AS sentiment,
        CASE WHEN coalesce(confidence, 0e0) > 1 THEN confidence / 100e0 ELSE coalesce(confidence, 0e0) END AS confidence,
        coalesce(symbol, '') AS symbol) FROM msg"""),
    "levels": (("filled",), f"""SELECT *,
        CASE WHEN confidence <= 0 THEN 0e0 ELSE ln(1 + confidence) / ln(2e0) END AS conf_norm,
        CASE WHEN sentiment < 0 AND (regexp_matches(lower(content), {_ALARM}) OR regexp_matches(lower(title), {_ALARM}))
               THEN 'high_risk'
             WHEN sentiment > 0.2 AND (regexp_matches(lower(content), {_DEAL}) OR regexp_matches(lower(title), {_DEAL}))
               THEN 'medium_risk'
             WHEN sentiment < 0 THEN 'moderate_risk' ELSE 'low_risk' END AS risk_level,
        CASE WHEN confidence < 0.2 THEN 'NEUTRAL' WHEN sentiment >= 0.7 THEN 'BULLISH'
             WHEN sentiment >= 0.4 THEN 'POSITIVE' WHEN sentiment >= 0.1 THEN 'SLIGHTLY POSITIVE'
             WHEN sentiment <= -0.7 THEN 'BEARISH' WHEN sentiment <= -0.4 THEN 'NEGATIVE'
             WHEN sentiment <= -0.1 THEN 'SLIGHTLY NEGATIVE' ELSE 'NEUTRAL' END AS impact_sentiment,
        sha256(concat_ws('_', symbol, coalesce(source, ''), title, coalesce(pub, 'default'))) AS doc_id,
        {parse_ms('pub')} AS "publishedAt"
        FROM filled"""),
    "impacts": (("levels",), """SELECT *, CASE risk_level WHEN 'high_risk' THEN 0.9e0 WHEN 'moderate_risk' THEN 0.7e0
             WHEN 'medium_risk' THEN 0.5e0 ELSE 0.1e0 END AS risk_raw,
        CASE WHEN risk_level = 'high_risk' AND sentiment < 0 THEN 'HIGH RISK'
             WHEN risk_level = 'high_risk' THEN 'RISKY BULLISH'
             WHEN risk_level IN ('moderate_risk', 'medium_risk') AND sentiment < 0 THEN 'MODERATE RISK'
             ELSE impact_sentiment END AS impact_assessment FROM levels"""),
    "scored": (("impacts",), f"""SELECT *, score * conf_norm - risk_raw * (1 - conf_norm) AS final_score,
        sentiment * conf_norm AS sentiment_confidence_score,
        risk_raw * 0.8e0 + risk_raw * conf_norm * 0.2e0 AS risk_adj, score AS impact_score,
        'unknown' AS content_quality, CAST(NULL AS VARCHAR) AS image_url
        FROM (SELECT *, CAST({cases('impact_assessment', IMPACT_SCORES, '0')} AS DOUBLE) AS score FROM impacts)"""),
    "raw": (("docs",), f"""SELECT n, substring(text, 1, 80) AS title, substring(text, 1, 200) AS description,
        text AS snippet, {_PUB} AS published_at, source, lang, 'https://news.example/' || n AS url,
        sha256(substring(text, 1, 80) || text) AS doc_id,
        CASE n % 3 WHEN 0 THEN [] WHEN 1 THEN ['S' || (n % 10)] ELSE ['S' || (n % 10), 'S' || ((n + 0) % 7)] END AS symbols,
        CASE WHEN n % 3 > 0 THEN {_sent('n')} END AS api_sentiment,
        CASE WHEN n % 3 > 0 AND n % 23 <> 0 THEN {_conf('n')} END AS api_confidence
        FROM docs"""),
    "archive": (("raw",), "SELECT DISTINCT r.doc_id FROM raw r JOIN labels l ON l.doc_id = r.n"),
    "model": ((), """SELECT doc_id AS n, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'POSITIVE'
        ELSE 'neutral' END AS label, 0.9e0 AS score FROM labels"""),
    "ev": ((), """SELECT event_id, event_type AS pipeline, epoch_us(ts) // 1000 AS ts_ms, value AS latency_ms,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 500 ELSE 200 END AS status FROM events"""),
}


def chain(*names: str) -> str:
    """The named shared tables alone, to follow a table of another origin."""
    return ",\n".join(f"{name} AS ({CTES[name][1]})" for name in names)


def with_ctes(names: str, body: str) -> str:
    """``WITH`` clause of the named shared tables and everything they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in CTES[name][0]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    clauses = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in order)
    rest = body.strip()
    if rest.startswith(","):  # further tables of the body itself
        return f"WITH {clauses}{rest}"
    return f"WITH {clauses}\n{rest}"
