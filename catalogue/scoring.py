"""Scoring, identity, dedup and sentiment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogue.base import query, r9, with_ctes
from tapewire.functions import bands, identity
from tapewire.functions.text import iso_date
from tapewire.operators import dedup
from tapewire.operators.topn import latest_per_id
from tapewire.plans import driver_tables as tables
from tapewire.plans.enrich import with_ids, with_sentiment
from tapewire.schemas import SCORED
from tapewire.sources import sentiment_audit

FLOATS = {
    "sentiment", "confidence", "conf_norm", "risk_raw", "risk_adj", "impact_score", "final_score",
    "sentiment_confidence_score",
}
SCORED_SQL = ", ".join(f'round({c}, 9) AS {c}' if c in FLOATS else f'"{c}"' for c in SCORED.names)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r9(c).alias(c) if c in FLOATS else F.col(c) for c in df.columns])


@query(with_ctes("scored", f"SELECT {SCORED_SQL} FROM scored"))
def score_articles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tables.scored(spark, d))


@query(with_ctes("scored", """SELECT CAST(n AS VARCHAR) AS extract_id, doc_id, impact_sentiment, impact_assessment,
    risk_level, round(risk_raw, 9) AS risk_raw, round(risk_adj, 9) AS risk_score FROM scored"""))
def score_detail(spark, d):
    return tables.scored_detail(spark, d).select(
        "extract_id", "doc_id", "impact_sentiment", "impact_assessment", "risk_level",
        r9("risk_raw").alias("risk_raw"), r9("risk_score").alias("risk_score"),
    )


@query(with_ctes("scored", """SELECT risk_level, count(*) AS n, round(avg(risk_adj), 9) AS avg_risk,
    round(min(final_score), 9) AS lowest, round(max(final_score), 9) AS highest FROM scored GROUP BY risk_level"""))
def risk_level_counts(spark, d):
    return tables.scored(spark, d).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"),
        r9(F.avg("risk_adj")).alias("avg_risk"),
        r9(F.min("final_score")).alias("lowest"),
        r9(F.max("final_score")).alias("highest"),
    )


@query(with_ctes("scored", """SELECT impact_assessment, impact_sentiment, count(*) AS n,
    round(sum(final_score), 6) AS total FROM scored GROUP BY ALL"""))
def impact_distribution(spark, d):
    return tables.scored_detail(spark, d).groupBy("impact_assessment", "impact_sentiment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("final_score"), 6).alias("total")
    )


@query(with_ctes("msg", """SELECT n, confidence AS raw, round(c, 9) AS confidence,
    round(CASE WHEN c IS NULL OR c <= 0 THEN 0 ELSE ln(1 + c) / ln(2e0) END, 9) AS conf_norm,
    round(least(CASE WHEN c IS NULL OR c <= 0 THEN 0 ELSE ln(1 + c) / ln(2e0) END, 1), 9) AS clamped
    FROM (SELECT n, confidence, CASE WHEN confidence > 1 THEN confidence / 100e0 ELSE confidence END AS c FROM msg)"""))
def confidence_normalised(spark, d):
    from tapewire.functions.scoring import conf_norm, rescale_confidence

    c = rescale_confidence(F.col("confidence"))
    return tables.messages(spark, d).select(
        F.col("doc_id").cast("bigint").alias("n"),
        F.col("confidence").alias("raw"),
        r9(c).alias("confidence"),
        r9(conf_norm(c)).alias("conf_norm"),
        r9(conf_norm(c, clamp=True)).alias("clamped"),
    )


# --- identity and time ------------------------------------------------------------------------


@query(with_ctes("raw", "SELECT n AS ingest_seq, doc_id FROM raw"))
def extract_ids(spark, d):
    return with_ids(tables.raw_articles(spark, d)).select("ingest_seq", "doc_id")


_MS = "(CASE WHEN n % 6 = 5 THEN NULL ELSE epoch_ms(moment) - CASE WHEN n % 6 = 2 THEN 5 * 3600000 ELSE 0 END END)"


@query(with_ctes("msg docs", f"""SELECT m.n, pub AS text, {_MS.replace('n %', 'm.n %')} AS ms,
    epoch_ms(date_trunc('hour', epoch_ms({_MS.replace('n %', 'm.n %')}))) AS hour,
    strftime(date_trunc('hour', epoch_ms({_MS.replace('n %', 'm.n %')})), '%Y-%m-%d %H:00') AS label,
    CAST({_MS.replace('n %', 'm.n %')} // 60000 AS BIGINT) AS minute,
    CAST((1735689600000 - {_MS.replace('n %', 'm.n %')}) // 60000 AS BIGINT) AS age
    FROM msg m JOIN docs USING (n)"""))
def time_parsing(spark, d):
    ms = identity.to_epoch_ms(F.col("publishedAt"))
    return tables.messages(spark, d).select(
        F.col("doc_id").cast("bigint").alias("n"), F.col("publishedAt").alias("text"), ms.alias("ms")
    ).withColumns(
        {
            "hour": identity.hour_bucket(F.col("ms")),
            "label": identity.hour_label(F.col("ms")),
            "minute": identity.minute_bucket(F.col("ms")),
            "age": identity.article_age(F.col("ms"), F.lit(1735689600000)),
        }
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch_ms(date_trunc('day', ts)) AS day_ms,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
    ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END AS iso FROM events""")
def iso_dates(spark, d):
    ts = F.col("ts").cast("timestamp")
    day = F.date_format(ts, "yyyy-MM-dd")
    return tables.table(spark, d, "events").select(
        "event_id", day.alias("day"), identity.date_to_ms(day).alias("day_ms"), iso_date(ts).alias("iso")
    )


# --- dedup --------------------------------------------------------------------------------------


def _incoming(spark, d):
    return with_ids(tables.raw_articles(spark, d))


def _archive(spark, d):
    labelled = tables.table(spark, d, "labels").select(F.col("doc_id").alias("ingest_seq"))
    return _incoming(spark, d).select("ingest_seq", "doc_id").join(labelled, "ingest_seq")


@query(with_ctes("raw archive", """SELECT doc_id, max(n) AS ingest_seq FROM raw
    WHERE doc_id NOT IN (SELECT doc_id FROM archive) GROUP BY doc_id"""))
def new_articles_anti_join(spark, d):
    narrow = _incoming(spark, d).select("doc_id", "ingest_seq")
    return dedup.new_articles(narrow, _archive(spark, d), "ingest_seq")


@query(with_ctes("raw archive", """SELECT doc_id, count(*) AS copies FROM raw
    WHERE doc_id IN (SELECT doc_id FROM archive) GROUP BY doc_id"""))
def seen_articles(spark, d):
    return dedup.seen_articles(_incoming(spark, d), _archive(spark, d))


@query(with_ctes("raw archive", """SELECT count(*) AS fetched,
    count(DISTINCT doc_id) FILTER (doc_id NOT IN (SELECT doc_id FROM archive)) AS new_articles,
    count(*) FILTER (doc_id IN (SELECT doc_id FROM archive)) AS skipped FROM raw"""))
def batch_summary(spark, d):
    return dedup.batch_summary(_incoming(spark, d), _archive(spark, d))


@query(with_ctes("raw", """SELECT doc_id, n AS ingest_seq, title, source, published_at FROM raw
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1"""))
def latest_per_doc_id(spark, d):
    df = _incoming(spark, d).select("doc_id", "ingest_seq", "title", "source", "published_at")
    return latest_per_id(df, "doc_id", ["ingest_seq"])


@query(with_ctes("archive", "SELECT doc_id FROM archive"))
def archived_ids(spark, d):
    return dedup.archived_ids(_archive(spark, d))


@query("SELECT count(*) AS rows FROM documents")
def batch_size(spark, d):
    return dedup.batch_size(tables.table(spark, d, "documents"))


@query(with_ctes("raw", """, pairs AS (SELECT doc_id, n, unnest(symbols) AS s, generate_subscripts(symbols, 1) AS p FROM raw),
    firsts AS (SELECT doc_id, s, min(n * 10 + p) AS seen FROM pairs GROUP BY ALL)
    SELECT doc_id, string_agg(s, ',' ORDER BY seen, s) AS symbols FROM firsts GROUP BY doc_id"""))
def merge_tickers(spark, d):
    df = dedup.unpack_entities(_incoming(spark, d).select("doc_id", "ingest_seq", "entities"))
    return dedup.merge_tickers(df, "ingest_seq").select("doc_id", F.array_join("symbols", ",").alias("symbols"))


@query(with_ctes("raw", """SELECT n AS ingest_seq, array_to_string(symbols, ',') AS symbols,
    array_to_string(list_transform(symbols, lambda s: 'Company ' || substring(s, 2)), ',') AS names,
    api_sentiment, api_confidence FROM raw"""))
def unpack_entities(spark, d):
    return dedup.unpack_entities(tables.raw_articles(spark, d)).select(
        "ingest_seq", F.array_join("symbols", ",").alias("symbols"),
        F.array_join("entity_names", ",").alias("names"), "api_sentiment", "api_confidence",
    )


# --- sentiment ----------------------------------------------------------------------------------

def fused_ctes(source: str = "raw", join: str = "LEFT JOIN model USING (n)") -> str:
    return f""", pair AS (SELECT n, api_sentiment AS a, api_confidence AS ac,
      CASE WHEN length(snippet) >= 10 THEN CASE lower(label) WHEN 'positive' THEN score WHEN 'negative' THEN -score
        ELSE CASE WHEN label IS NOT NULL THEN 0e0 END END END AS m,
      CASE WHEN length(snippet) >= 10 THEN score END AS mc FROM {source} {join}),
    fused AS (SELECT *, CASE WHEN a IS NOT NULL AND m IS NOT NULL AND a * m >= 0 AND abs(a - m) < 0.5 THEN 'HYBRID_AGREEMENT'
      WHEN a IS NOT NULL AND m IS NOT NULL AND coalesce(mc, 0) > coalesce(ac, 0) THEN 'FINBERT_DOMINANT'
      WHEN a IS NOT NULL AND m IS NOT NULL THEN 'MARKETAUX_DOMINANT'
      WHEN a IS NOT NULL THEN 'MARKETAUX_ONLY' WHEN m IS NOT NULL THEN 'FINBERT_FALLBACK'
      ELSE 'NO_SENTIMENT' END AS sentiment_source,
      coalesce(nullif(ac, 0), 0.5) AS wa, coalesce(nullif(mc, 0), 0.5) AS wm FROM pair),
    chosen AS (SELECT n, sentiment_source, a, ac, m, mc,
      CASE sentiment_source WHEN 'HYBRID_AGREEMENT' THEN (a * wa + m * wm) / (wa + wm)
        WHEN 'FINBERT_DOMINANT' THEN m WHEN 'FINBERT_FALLBACK' THEN m ELSE a END AS sentiment,
      CASE sentiment_source WHEN 'HYBRID_AGREEMENT' THEN (wa + wm) / 2
        WHEN 'FINBERT_DOMINANT' THEN mc WHEN 'FINBERT_FALLBACK' THEN mc ELSE ac END AS confidence FROM fused)"""


def fused_sql(body: str) -> str:
    return with_ctes("raw model", fused_ctes() + "\n" + body)


def _fused(spark, d):
    raw = dedup.unpack_entities(tables.raw_articles(spark, d)).withColumnRenamed("ingest_seq", "doc_id")
    model = tables.model_sentiment(spark, d).withColumnRenamed("ingest_seq", "doc_id")
    return with_sentiment(raw, model)


@query(fused_sql("""SELECT n AS doc_id, sentiment_source, round(sentiment, 9) AS sentiment,
    round(confidence, 9) AS confidence FROM chosen"""))
def sentiment_fusion(spark, d):
    return _fused(spark, d).select(
        "doc_id", "sentiment_source", r9("sentiment").alias("sentiment"), r9("confidence").alias("confidence")
    )


@query(fused_sql("""SELECT sentiment_source, count(*) AS n, round(avg(sentiment), 9) AS avg_sentiment,
    round(avg(confidence), 9) AS avg_confidence FROM chosen GROUP BY sentiment_source"""))
def sentiment_source_counts(spark, d):
    return _fused(spark, d).groupBy("sentiment_source").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("sentiment")).alias("avg_sentiment"),
        r9(F.avg("confidence")).alias("avg_confidence"),
    )


@query(fused_sql("""SELECT n AS doc_id, sentiment_source, a AS api_sentiment, ac AS api_confidence, m AS model_sentiment,
    mc AS model_confidence, round(abs(a - m), 9) AS diff, round(sentiment, 9) AS sentiment,
    round(confidence, 9) AS confidence FROM chosen"""))
def sentiment_decisions(spark, d):
    df = _fused(spark, d).withColumnRenamed("model_sentiment_confidence", "model_confidence")
    return sentiment_audit(df).withColumns({c: r9(c) for c in ("diff", "sentiment", "confidence")})


@query(with_ctes("model", """SELECT n AS doc_id, label,
    CASE lower(label) WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0e0 END AS sentiment FROM model"""))
def signed_model_sentiment(spark, d):
    from tapewire.functions.sentiment import signed_sentiment

    return tables.model_sentiment(spark, d).select(
        F.col("ingest_seq").alias("doc_id"), "label", signed_sentiment(F.col("label"), F.col("score")).alias("sentiment")
    )


# --- bands --------------------------------------------------------------------------------------


@query(with_ctes("scored", """SELECT doc_id,
    CASE category WHEN 'A' THEN 'Earnings' WHEN 'B' THEN 'Analyst Ratings & Recommendations'
      WHEN 'C' THEN 'Mergers, Acquisitions & Deals' WHEN 'D' THEN 'Regulatory & Legal Developments'
      WHEN 'E' THEN 'Economic Data & Federal Reserve' WHEN 'F' THEN 'Corporate Actions & Leadership'
      WHEN 'G' THEN 'Market Trends & Sector Analysis' WHEN 'H' THEN 'IPO & New Listings'
      WHEN 'I' THEN 'Product Launches & Innovation' WHEN 'J' THEN 'General Business & Industry News'
      ELSE 'General News' END AS category_name,
    CASE WHEN risk_adj < 0.33 THEN 'low_risk' WHEN risk_adj < 0.67 THEN 'medium_risk' ELSE 'high_risk' END AS risk_band,
    upper(replace(risk_level, '_', ' ')) AS risk_text,
    CASE WHEN sentiment > 0.1 THEN 'positive' WHEN sentiment < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_band,
    CASE WHEN impact_assessment IN ('POSITIVE', 'SLIGHTLY POSITIVE', 'BULLISH') THEN 'positive'
      WHEN impact_assessment IN ('HIGH RISK', 'MODERATE RISK') THEN lower(impact_assessment) ELSE 'neutral' END AS impact_group,
    CASE WHEN conf_norm >= 0.7 THEN 'high' WHEN conf_norm >= 0.4 THEN 'medium' WHEN conf_norm >= 0.2 THEN 'low'
      ELSE 'very low' END AS confidence_band,
    CASE WHEN final_score > 0.5 THEN 'buy' WHEN final_score < -0.5 THEN 'sell' ELSE 'hold' END AS signal,
    CASE WHEN final_score >= 1.5 THEN 'strong buy' WHEN final_score >= 0.5 THEN 'buy' WHEN final_score >= 0 THEN 'weak buy'
      WHEN final_score >= -0.5 THEN 'weak sell' WHEN final_score >= -1.5 THEN 'sell' ELSE 'strong sell' END AS signal_detail
    FROM scored"""))
def display_bands(spark, d):
    score = F.col("final_score")
    return tables.scored(spark, d).select(
        "doc_id",
        bands.category_name(F.col("category")).alias("category_name"),
        bands.risk_band(F.col("risk_adj")).alias("risk_band"),
        bands.risk_display(F.col("risk_level")).alias("risk_text"),
        bands.sentiment_band(F.col("sentiment")).alias("sentiment_band"),
        bands.impact_group(F.col("impact_assessment")).alias("impact_group"),
        bands.confidence_band(F.col("conf_norm")).alias("confidence_band"),
        bands.signal_band(score).alias("signal"),
        bands.signal_band(score, detailed=True).alias("signal_detail"),
    )
