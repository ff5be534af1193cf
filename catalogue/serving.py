"""Filter, rollup and series queries over scored articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import query, r9, with_ctes
from catalogue.scoring import SCORED_SQL, rounded
from tapewire.fixed_values import CATEGORY_NAMES, OTHER_CATEGORY_NAME
from tapewire.functions.bands import trend_band
from tapewire.operators import filters, rollups, search
from tapewire.operators.search_spec import SearchSpec
from tapewire.plans import driver_tables as tables
from tapewire.plans.scoring import score_where
from tapewire.sources import look_up, upsert, where_requested, work_dir
from tapewire.sources.history import read_history, write_history

_HOUR = 'epoch_ms(date_trunc(\'hour\', epoch_ms("publishedAt")))'
_NAME = "CASE category " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_NAMES.items()
) + f" ELSE '{OTHER_CATEGORY_NAME}' END"


# --- filters ------------------------------------------------------------------------------------


@query(with_ctes("scored", """SELECT count(*) FILTER (sentiment > 0) AS server_positive,
    count(*) FILTER (sentiment < 0) AS server_negative, count(*) FILTER (sentiment BETWEEN -0.05 AND 0.05) AS server_neutral,
    count(*) FILTER (sentiment > 0.1) AS client_positive, count(*) FILTER (sentiment < -0.1) AS client_negative,
    count(*) FILTER (abs(sentiment) <= 0.1) AS client_neutral FROM scored"""))
def sentiment_filters(spark, d):
    counts = [
        F.count_if(filters.sentiment_condition(band, bands)).alias(f"{bands}_{band}")
        for bands in ("server", "client")
        for band in ("positive", "negative", "neutral")
    ]
    return tables.scored(spark, d).agg(*counts)


_SHOWN = """CASE WHEN conf_norm <> 0 THEN conf_norm WHEN confidence <> 0 AND confidence <= 1 THEN confidence
    WHEN confidence <> 0 THEN confidence / 100 ELSE 0.8 END * 100"""


# One query per filter: the condition as SQL and the operator call.
_FILTERS = {
    "category": ("category = 'C'", lambda df: filters.where_category(df, "c")),
    "source": ("source = 'src3'", lambda df: filters.where_source(df, "src3")),
    "risk_level": ("risk_level = 'medium_risk'", lambda df: filters.where_risk_level(df, "medium_risk")),
    "impact": ("impact_assessment = 'BULLISH'", lambda df: filters.where_impact(df, "BULLISH")),
    "symbol": ("symbol = 'S4'", lambda df: filters.where_symbol(df, " s4 ")),
    "published": (
        '"publishedAt" BETWEEN 1704110400000 AND 1704240000000',
        lambda df: filters.where_published(df, 1704110400000, 1704240000000),
    ),
    "risk_score": ("risk_adj BETWEEN 0.5 AND 0.65", lambda df: filters.where_risk_between(df, 0.5, 0.65)),
    "confidence": (f"{_SHOWN} BETWEEN 40 AND 75", lambda df: filters.where_confidence_between(df, 40, 75)),
    "has_ticker": ("symbol <> '' AND entity_name <> ''", filters.where_has_ticker),
    "valid_history": ('"publishedAt" IS NOT NULL', filters.valid_history),
}


def _register_filter(name, condition, apply):
    def run(spark, d):
        return apply(tables.scored(spark, d)).select("doc_id", "publishedAt")

    run.__name__ = f"filter_{name}"
    query(with_ctes("scored", f'SELECT doc_id, "publishedAt" FROM scored WHERE {condition}'))(run)


for _name, (_condition, _apply) in _FILTERS.items():
    _register_filter(_name, _condition, _apply)


@query(with_ctes("scored", f"""SELECT doc_id FROM scored WHERE sentiment > 0 AND category = 'D' AND risk_adj BETWEEN 0 AND 0.2
    AND "publishedAt" >= 1704067200000 AND "publishedAt" <= 1704499200000 AND {_SHOWN} BETWEEN 10 AND 100"""))
def combined_filter(spark, d):
    spec = SearchSpec.from_params({
        "sentiment": "positive", "category": "d", "source": "all", "riskScore": "[0, 0.2]", "confidence": "[10, 100]",
        "dateStart": "2024-01-01", "dateEnd": "2024-01-06",
    })
    return score_where(tables.messages(spark, d), spec, **tables.word_lists()).select("doc_id")


@query(with_ctes("scored", """SELECT doc_id FROM scored
    WHERE contains(lower(title || ' ' || key_phrases || ' ' || content), 'worthless')"""))
def substring_search(spark, d):
    return filters.where_contains(tables.scored(spark, d), "WORTHless").select("doc_id")


@query(with_ctes("raw", "SELECT n AS ingest_seq, source FROM raw WHERE lang = 'en'"))
def source_side_filter(spark, d):
    return where_requested(tables.raw_articles(spark, d), lang="en").select("ingest_seq", "source")


_FIRST = """(SELECT doc_id FROM scored ORDER BY "publishedAt" DESC NULLS LAST, doc_id LIMIT 1)"""


def _latest_id(df) -> str:
    """Id of the newest article."""
    return df.orderBy(F.desc_nulls_last("publishedAt"), "doc_id").select("doc_id").first()[0]


@query(with_ctes("scored", f"SELECT {SCORED_SQL} FROM scored WHERE doc_id = {_FIRST}"))
def get_article(spark, d):
    df = tables.scored(spark, d)
    return rounded(filters.get_article(df, _latest_id(df)))


@query(with_ctes("scored", f"""SELECT category, count(*) AS n FROM scored WHERE doc_id <> {_FIRST} GROUP BY category"""))
def all_but_one(spark, d):
    df = tables.scored(spark, d)
    return filters.where_not_self(df, _latest_id(df)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# --- facets and rollups -------------------------------------------------------------------------


@query(with_ctes("scored", """SELECT facet, value, n FROM (
      SELECT 'category' AS facet, category AS value, count(*) AS n FROM scored WHERE category IS NOT NULL GROUP BY category
      UNION ALL SELECT 'source', source, count(*) FROM scored WHERE source IS NOT NULL GROUP BY source)
    QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 50"""))
def facets(spark, d):
    return rollups.facets(tables.scored(spark, d), ["category", "source"])


_HOURLY = f"""SELECT {_HOUR} AS hour, min("publishedAt") AS time, round(avg(final_score), 9) AS final_score,
    round(avg(sentiment), 9) AS avg_sentiment, round(avg(risk_raw), 9) AS avg_risk, count(*) AS articles,
    strftime(epoch_ms(min("publishedAt")), '%Y-%m-%d %H:00') AS label
    FROM scored WHERE "publishedAt" IS NOT NULL GROUP BY 1"""


def _hours(df):
    return df.withColumns({c: r9(c) for c in ("final_score", "avg_sentiment", "avg_risk")})


@query(with_ctes("scored", f"{_HOURLY} ORDER BY hour DESC LIMIT 24"))
def hourly_sentiment(spark, d):
    return _hours(rollups.hourly_sentiment(tables.scored(spark, d)))


@query(with_ctes("scored", _HOURLY))
def hourly_sentiment_all(spark, d):
    return _hours(rollups.hourly_sentiment(tables.scored(spark, d), hours=None))


_PIVOT = ", ".join(
    f"""count(*) FILTER ({_NAME} = '{name}') AS "{name}\"""" for name in [*CATEGORY_NAMES.values(), OTHER_CATEGORY_NAME]
)


@query(with_ctes("scored", f"""SELECT {_HOUR} AS hour, {_PIVOT} FROM scored WHERE "publishedAt" IS NOT NULL
    GROUP BY 1 ORDER BY 1 DESC LIMIT 12"""))
def hourly_category_pivot(spark, d):
    return rollups.hourly_categories(tables.scored(spark, d))


_COUNTS = f""", c AS (SELECT {_HOUR} AS hour, {_NAME} AS category, count(*) AS n FROM scored
    WHERE "publishedAt" IS NOT NULL GROUP BY 1, 2)"""


@query(with_ctes("scored", _COUNTS + """ SELECT h.hour, k.category, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT hour FROM c) h CROSS JOIN (SELECT DISTINCT category FROM c) k
    LEFT JOIN c ON c.hour = h.hour AND c.category = k.category"""))
def hourly_category_grid(spark, d):
    return rollups.fill_hour_grid(rollups.hourly_category_counts(tables.scored(spark, d)))


@query(with_ctes("scored", _COUNTS + " SELECT hour, category, sum(n)::BIGINT AS n FROM c GROUP BY ROLLUP (hour, category)"))
def hourly_category_rollup(spark, d):
    return rollups.hourly_totals(tables.scored(spark, d))


@query(with_ctes("scored", """SELECT symbol, entity_name, min("publishedAt") AS first_seen FROM scored
    WHERE symbol <> '' AND entity_name <> '' GROUP BY ALL"""))
def distinct_tickers(spark, d):
    return rollups.tickers(tables.scored(spark, d))


@query(with_ctes("scored", """SELECT 'impact_assessment' AS kind, impact_assessment AS value FROM scored GROUP BY 2
    UNION ALL SELECT 'category', category FROM scored WHERE category IS NOT NULL GROUP BY 2"""))
def distinct_values(spark, d):
    return rollups.distinct_values(tables.scored(spark, d), ["impact_assessment", "category"])


@query(with_ctes("scored", """SELECT count(*) AS articles, count(*) FILTER (symbol <> '') AS with_symbol,
    count(*) FILTER (coalesce(entity_name, '') <> '') AS with_entity,
    count(*) FILTER (symbol <> '' AND coalesce(entity_name, '') <> '') AS with_both FROM scored"""))
def coverage(spark, d):
    return rollups.coverage(tables.scored(spark, d))


@query(with_ctes("scored", """SELECT value, count(*) AS n, round(count(*) / (SELECT count(*) FROM scored), 9) AS share FROM (
    SELECT CASE WHEN sentiment > 0.1 THEN 'positive' WHEN sentiment < -0.1 THEN 'negative' ELSE 'neutral' END AS value FROM scored)
    GROUP BY value"""))
def sentiment_distribution(spark, d):
    return rollups.sentiment_distribution(tables.scored(spark, d)).withColumn("share", r9("share"))


@query(with_ctes("scored", """SELECT kind, value, count(*) AS n, round(avg(final_score), 9) AS avg_score, max("publishedAt") AS latest
    FROM (SELECT 'source' AS kind, source AS value, * FROM scored UNION ALL SELECT 'symbol', symbol, * FROM scored
      UNION ALL SELECT 'category', category, * FROM scored) WHERE value IS NOT NULL GROUP BY kind, value"""))
def breakdowns(spark, d):
    return rollups.breakdown(tables.scored(spark, d), ["source", "symbol", "category"]).withColumn("avg_score", r9("avg_score"))


# --- series -------------------------------------------------------------------------------------


@query(with_ctes("scored", """SELECT "publishedAt" AS ts, round(final_score, 9) AS final_score FROM (
    SELECT "publishedAt", final_score FROM scored WHERE symbol = 'S4' ORDER BY "publishedAt" NULLS LAST, doc_id LIMIT 100)
    WHERE "publishedAt" IS NOT NULL"""))
def symbol_history(spark, d):
    return rollups.symbol_history(tables.scored(spark, d), "s4").withColumn("final_score", r9("final_score"))


_SERIES = """SELECT symbol, doc_id, "publishedAt", final_score,
    row_number() OVER (PARTITION BY symbol ORDER BY "publishedAt", doc_id) - 1 AS position FROM scored
    WHERE symbol <> '' AND "publishedAt" IS NOT NULL"""


@query(with_ctes("scored", f"""SELECT symbol, doc_id, "publishedAt", round(final_score, 9) AS final_score,
    position::INTEGER AS position FROM ({_SERIES}) WHERE position < 200"""))
def symbol_series(spark, d):
    return rollups.symbol_series(tables.scored(spark, d)).withColumn("final_score", r9("final_score"))


@query(with_ctes("scored", f"""SELECT symbol, round(m, 9) AS mean_score,
    CASE WHEN m > 0.5 THEN 'up' WHEN m < -0.5 THEN 'down' ELSE 'flat' END AS trend
    FROM (SELECT symbol, avg(final_score) AS m FROM ({_SERIES}) WHERE position < 2000 GROUP BY symbol)"""))
def symbol_trend(spark, d):
    means = rollups.series_mean(rollups.symbol_series(tables.scored(spark, d), 2000), ["symbol"])
    return means.select("symbol", r9("mean_score").alias("mean_score"), trend_band(F.col("mean_score")).alias("trend"))


@query(with_ctes("scored", """SELECT category, doc_id, "publishedAt", round(final_score, 9) AS final_score,
    (row_number() OVER (PARTITION BY category ORDER BY "publishedAt", doc_id) - 1)::INTEGER AS position FROM (
      SELECT * FROM scored WHERE "publishedAt" IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY category ORDER BY "publishedAt" DESC, doc_id DESC) <= 10)"""))
def last_related(spark, d):
    return rollups.last_related(tables.scored(spark, d), ["category"]).withColumn("final_score", r9("final_score"))


_CARD = {
    "newest": '"publishedAt" DESC NULLS LAST', "oldest": '"publishedAt" ASC NULLS FIRST', "risk": "risk_adj DESC",
    "sentiment": "sentiment DESC", "confidence": f"{_SHOWN} / 100 DESC", "final_score": "final_score DESC",
}


def _register_sort(name, order):
    def run(spark, d):
        return rollups.sort_articles(tables.scored(spark, d), name).limit(20).select("doc_id", "publishedAt")

    run.__name__ = f"sort_{name}"
    query(with_ctes("scored", f'SELECT doc_id, "publishedAt" FROM scored ORDER BY {order}, doc_id LIMIT 20'))(run)


for _name, _order in _CARD.items():  # the first page of each card order
    _register_sort(_name, _order)


@query(with_ctes("scored", """SELECT doc_id, "publishedAt", round(risk_adj, 9) AS risk_adj FROM scored WHERE sentiment < 0
    ORDER BY risk_adj DESC, "publishedAt" DESC NULLS LAST, doc_id LIMIT 15 OFFSET 30"""))
def paged_sort(spark, d):
    spec = SearchSpec.from_params({"sentiment": "negative", "sortBy": "risk", "page": 3, "limit": 15})
    rows, _ = search.search(tables.scored(spark, d), None, spec)
    return rows.select("doc_id", "publishedAt", r9("risk_adj").alias("risk_adj"))


@query(with_ctes("scored", """SELECT count(*) AS total, 3::BIGINT AS page, 15::BIGINT AS page_size,
    ceil(count(*) / 15)::BIGINT AS total_pages FROM scored WHERE sentiment < 0"""))
def page_totals(spark, d):
    spec = SearchSpec.from_params({"sentiment": "negative", "sortBy": "risk", "page": 3, "limit": 15})
    return search.page_totals(search.ranked_hits(tables.scored(spark, d), None, spec), spec)


@query(with_ctes("scored", """SELECT doc_id, "publishedAt", round(risk_adj, 9) AS risk_adj FROM scored WHERE sentiment < 0
    ORDER BY risk_adj DESC, "publishedAt" DESC NULLS LAST, doc_id LIMIT 15 OFFSET 30"""))
def keyset_page(spark, d):
    """The third page, reached by the cursors of the two before it."""
    spec, last = SearchSpec.from_params({"sentiment": "negative", "sortBy": "risk", "limit": 15}), None
    hits = search.ranked_hits(tables.scored(spark, d), None, spec)
    for _ in range(2):
        rows = search.next_page(hits, spec, last).collect()  # one page
        last = search.cursor(rows[-1], spec) if len(rows) == spec.page_size else last
    return search.next_page(hits, spec, last).select("doc_id", "publishedAt", r9("risk_adj").alias("risk_adj"))


_DAYS = (1704153600000, 1704326399999)


@query(with_ctes("scored", f"""SELECT doc_id, "publishedAt", symbol FROM scored WHERE "publishedAt" BETWEEN {_DAYS[0]} AND {_DAYS[1]}"""))
def published_by_day(spark, d):
    """Two days of the article table by day and symbol: the scan reads their folders only."""
    path = work_dir(spark, "history")
    write_history(tables.scored(spark, d), path)
    return filters.where_published(read_history(spark, path), *_DAYS).select("doc_id", "publishedAt", "symbol")


@query(with_ctes("scored", f"""SELECT "publishedAt" AS ts, round(final_score, 9) AS final_score FROM scored
    WHERE symbol = 'S4' AND "publishedAt" BETWEEN {_DAYS[0]} AND {_DAYS[1]} AND final_score IS NOT NULL ORDER BY "publishedAt", doc_id LIMIT 100"""))
def symbol_history_by_day(spark, d):
    path = work_dir(spark, "history")
    write_history(tables.scored(spark, d), path)
    return rollups.symbol_history(read_history(spark, path), "s4", 100, *_DAYS).withColumn("final_score", r9("final_score"))


@query(with_ctes("scored", 'SELECT doc_id, title, "publishedAt" FROM scored WHERE "publishedAt" IS NOT NULL ORDER BY "publishedAt" DESC, doc_id LIMIT 1'))
def look_up_by_id(spark, d):
    """An article of the keyed table: the scan reads the folder of its bucket."""
    path, df = work_dir(spark, "keyed"), tables.scored(spark, d)
    upsert(df, path, 0, ("publishedAt",))
    return look_up(spark, path, _latest_id(df)).select("doc_id", "title", "publishedAt")


@query("SELECT count(*) AS n FROM (SELECT * FROM documents LIMIT 1)")
def sample_row(spark, d):
    docs = tables.table(spark, d, "documents")
    return rollups.sample(docs).join(docs, docs.columns, "left_semi").agg(F.count(F.lit(1)).alias("n"))  # a row that is there
