"""Keyword, classification and dictionary queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalogue.base import STRIP, alternation, query, r9, text, with_ctes
from tapewire.fixed_values import CATEGORY_LABELS, CATEGORY_LETTERS, CATEGORY_NAMES
from tapewire.functions.bands import category_name
from tapewire.functions.text import classification_text
from tapewire.operators import classify, keywords
from tapewire.operators.model_hooks import score_with
from tapewire.plans import driver_tables as tables
from tapewire.plans.driver_tables import DICTIONARY_EXAMPLE
from tapewire.plans.enrich import category_requests
from tapewire.sources import export_keywords, work_dir
from tapewire.sources.sinks import stored

_HITS = ", ".join(
    f"{{c: '{c}', k: {len(set(words))}, m: regexp_extract_all(low, {text(alternation(words))}, 0)}}"
    for c, words in DICTIONARY_EXAMPLE.items()
)

# Per document and category with a match: counts and the keyword score.
KEYWORDS = f""", body AS (SELECT n, confidence, CASE WHEN regexp_replace(coalesce(nullif(content, ''), description), '<[^>]+>', '', 'g') <> ''
      THEN regexp_replace(coalesce(nullif(content, ''), description), '<[^>]+>', '', 'g') ELSE title END AS text FROM msg),
    hits AS (SELECT n, unnest([{_HITS}]) AS h FROM (SELECT n, lower(text) AS low FROM body)),
    stats AS (SELECT n, h.c AS category, len(list_distinct(h.m)) AS unique_matches, len(h.m) AS occurrences,
      h.k AS dictionary_size, list_avg(list_transform(list_distinct(h.m),
        lambda w: least(0.2e0 * len(string_split(trim(w), ' ')), 1e0))) AS specificity FROM hits WHERE len(h.m) > 0),
    kw AS (SELECT *, least(unique_matches / dictionary_size
      + least(specificity + least(occurrences * 0.1e0, 0.5e0), 0.5e0), 1e0) AS score FROM stats)"""

_LABELS = ", ".join(f"{{label: {text(v)}, c: '{k}', i: {i}}}" for i, (k, v) in enumerate(CATEGORY_LABELS.items()))

MODEL = f""", labels15 AS (SELECT unnest([{_LABELS}, {{label: 'something else', c: 'J', i: 14}}]) AS l),
    ms AS (SELECT n, l.label AS label, l.c AS category, CAST((n * (l.i * 2 + 3) + l.i * 13) % 97 AS DOUBLE) / 100e0 AS score
      FROM docs, labels15),
    top3 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, label) AS rank FROM ms
      QUALIFY rank <= 3),
    ml AS (SELECT n, category, sum(score) / CASE WHEN any_value(total) > 0 THEN any_value(total) ELSE 1 END AS share
      FROM (SELECT *, sum(score) OVER (PARTITION BY n) AS total FROM top3) GROUP BY n, category)"""


def _texts(spark, d):
    body = classification_text(F.col("content"), F.col("description"), F.col("title"))
    return tables.messages(spark, d).select(F.col("doc_id").cast("bigint").alias("doc_id"), "confidence", body.alias("text"))


@query(with_ctes("msg", KEYWORDS + """ SELECT n AS doc_id, category, unique_matches, occurrences,
    CAST(dictionary_size AS BIGINT) AS dictionary_size, round(specificity, 9) AS specificity FROM stats"""))
def keyword_stats(spark, d):
    stats = keywords.keyword_stats(_texts(spark, d), DICTIONARY_EXAMPLE, "text")
    return stats.withColumn("specificity", r9("specificity"))


@query(with_ctes("msg", KEYWORDS + " SELECT n AS doc_id, category, round(score, 9) AS score FROM kw"))
def keyword_scores(spark, d):
    scores = keywords.keyword_scores(_texts(spark, d), DICTIONARY_EXAMPLE, "text")
    return scores.withColumn("score", r9("score"))


@query(with_ctes("msg", KEYWORDS + """ SELECT category, count(*) AS docs, sum(occurrences)::BIGINT AS occurrences
    FROM stats GROUP BY category"""))
def keyword_hits_by_category(spark, d):
    return keywords.keyword_stats(_texts(spark, d), DICTIONARY_EXAMPLE, "text").groupBy("category").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("occurrences").alias("occurrences")
    )


@query(with_ctes("msg", KEYWORDS + """ SELECT b.n AS doc_id, coalesce(min(s.category), 'J') AS category
    FROM body b LEFT JOIN stats s USING (n) GROUP BY b.n"""))
def first_category(spark, d):
    return _texts(spark, d).select("doc_id", keywords.first_category(F.col("text"), DICTIONARY_EXAMPLE).alias("category"))


@query(with_ctes("docs", MODEL + " SELECT n AS doc_id, CAST(rank AS INTEGER) AS rank, label, score FROM top3"))
def top_labels(spark, d):
    return classify.top_labels(tables.model_scores(spark, d)).select("doc_id", "rank", "label", "score")


@query(with_ctes("docs", MODEL + " SELECT n AS doc_id, category, round(share, 9) AS share FROM ml"))
def ml_top3_normalised(spark, d):
    return classify.normalised_top_labels(tables.model_scores(spark, d)).withColumn("share", r9("share"))


@query(with_ctes("docs", MODEL + """ SELECT label, category, count(*) AS n, round(avg(score), 9) AS avg_score FROM ms GROUP BY ALL"""))
def label_categories(spark, d):
    category = classify.label_to_category(F.col("label")).alias("category")
    return tables.model_scores(spark, d).groupBy("label", category).agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("score")).alias("avg_score")
    )


DECISION = f""", letters AS (SELECT unnest(string_split('{''.join(CATEGORY_LETTERS)}', '')) AS category),
    grid AS (SELECT b.n, b.confidence, l.category, coalesce(kw.score, 0) AS kw,
        CASE WHEN length(b.text) >= 15 THEN coalesce(ml.share * b.confidence, 0) ELSE 0 END AS mls
      FROM body b CROSS JOIN letters l LEFT JOIN kw ON kw.n = b.n AND kw.category = l.category
      LEFT JOIN ml ON ml.n = b.n AND ml.category = l.category),
    comb AS (SELECT *, 0.7e0 * mls + 0.3e0 * kw AS combined FROM grid),
    bestkw AS (SELECT n, category AS kc, kw AS ks FROM comb QUALIFY row_number() OVER (PARTITION BY n ORDER BY kw DESC, category) = 1),
    best AS (SELECT n, category AS bc, combined AS bs, mls AS bm, kw AS bk FROM comb
      QUALIFY row_number() OVER (PARTITION BY n ORDER BY combined DESC, category) = 1),
    firstkw AS (SELECT n, min(category) AS fc FROM stats GROUP BY n),
    decided AS (SELECT b.n, b.confidence, kc, ks, bc, bs, bm, bk, length(b.text) >= 15 AS usable,
      CASE WHEN b.confidence IS NULL THEN 'KEYWORD_FALLBACK' WHEN ks >= 0.6 THEN 'REDIS_RULE_OVERRIDE'
        WHEN bs >= 0.4 AND bm > 0.6 THEN 'WEIGHTED_ML_DOMINANT' WHEN bs >= 0.4 AND bk > 0.7 THEN 'WEIGHTED_KEYWORD_DOMINANT'
        WHEN bs >= 0.4 THEN 'WEIGHTED_BALANCED' ELSE 'DEFAULT_LOW_CONFIDENCE' END AS method,
      CASE WHEN b.confidence IS NULL THEN coalesce(fc, 'J') WHEN ks >= 0.6 THEN kc WHEN bs >= 0.4 THEN bc ELSE 'J' END AS category,
      CASE WHEN b.confidence IS NULL THEN NULL WHEN ks >= 0.6 THEN ks WHEN bs >= 0.4 THEN bs ELSE 0.3 END AS category_confidence
      FROM body b JOIN bestkw USING (n) JOIN best USING (n) LEFT JOIN firstkw USING (n))"""


def _classified(spark, d):
    model = classify.model_table(tables.model_scores(spark, d))
    return classify.classify(_texts(spark, d), DICTIONARY_EXAMPLE, model)


@query(with_ctes("docs msg", KEYWORDS + MODEL + DECISION + """ SELECT n AS doc_id, category, method,
    round(category_confidence, 9) AS category_confidence FROM decided"""))
def weighted_category(spark, d):
    return _classified(spark, d).select("doc_id", "category", "method", r9("category_confidence").alias("category_confidence"))


@query(with_ctes("docs msg", KEYWORDS + MODEL + DECISION + """ SELECT method, category, count(*) AS n,
    round(avg(category_confidence), 9) AS confidence FROM decided GROUP BY method, category"""))
def classification_counts(spark, d):
    return _classified(spark, d).groupBy("method", "category").agg(
        F.count(F.lit(1)).alias("n"), r9(F.avg("category_confidence")).alias("confidence")
    )


@query(with_ctes("docs msg", KEYWORDS + MODEL + DECISION + """,
    tops AS (SELECT n, string_agg(category || '=' || printf('%.9f', combined), ' ' ORDER BY combined DESC, category) AS t FROM (
      SELECT * FROM comb QUALIFY row_number() OVER (PARTITION BY n ORDER BY combined DESC, category) <= 3) GROUP BY n)
    SELECT n AS doc_id, round(CASE WHEN ks >= 0.6 THEN 0 ELSE bm END, 9) AS ml_score,
      round(CASE WHEN ks >= 0.6 THEN ks ELSE bk END, 9) AS keyword_score,
      round(CASE WHEN ks >= 0.6 THEN ks ELSE bs END, 9) AS combined_score,
      round(CASE WHEN ks >= 0.6 OR NOT usable THEN 0 ELSE s.score END, 9) AS model_confidence,
      confidence AS api_confidence,
      CASE WHEN ks >= 0.6 THEN kc || '=' || printf('%.9f', ks) ELSE t END AS top_3
    FROM decided JOIN tops USING (n) JOIN (SELECT n, score FROM top3 WHERE rank = 1) s USING (n) WHERE confidence IS NOT NULL"""))
def score_breakdown(spark, d):
    b = F.col("breakdown")
    shown = F.transform(b["top_3_combined"], lambda e: F.concat(e["category"], F.lit("="), F.format_string("%.9f", e["score"])))
    return _classified(spark, d).where(b.isNotNull()).select(
        "doc_id", r9(b["ml_score"]).alias("ml_score"), r9(b["keyword_score"]).alias("keyword_score"),
        r9(b["combined_score"]).alias("combined_score"), r9(b["model_confidence"]).alias("model_confidence"),
        b["api_confidence"].alias("api_confidence"), F.array_join(shown, " ").alias("top_3"),
    )


@query(with_ctes("msg", KEYWORDS + """, lead AS (SELECT n, max(score) AS s FROM kw GROUP BY n)
    SELECT b.n AS doc_id FROM body b LEFT JOIN lead USING (n) WHERE coalesce(s, 0) < 0.6 AND length(b.text) >= 15"""))
def needs_model(spark, d):
    return classify.needs_model(_texts(spark, d), DICTIONARY_EXAMPLE).select("doc_id")


_T, _D, _X = STRIP("m.title"), STRIP("m.description"), STRIP("b.text")
# The label scores of the stand-in model below, which sees only the length of its input.
_HOOK = MODEL.replace(
    "FROM docs, labels15",
    f"""FROM (SELECT m.n AS id, length(substring(concat_ws(' ', CASE WHEN length({_T}) > 5 THEN {_T} END,
      CASE WHEN length({_D}) > 10 THEN {_D} END, CASE WHEN length({_X}) > 10 THEN {_X} END), 1, 512)) AS size
      FROM msg m JOIN body b ON b.n = m.n) lens, labels15""",
).replace("SELECT n, l.label", "SELECT lens.id AS n, l.label").replace("CAST((n *", "CAST((size *")


@query(with_ctes("docs msg", KEYWORDS + _HOOK + DECISION + """ SELECT n AS doc_id, category, method,
    round(category_confidence, 9) AS category_confidence FROM decided"""))
def classify_with_model_hook(spark, d):
    """Only articles that keywords leave undecided go through the model."""
    labels = [*CATEGORY_LABELS.values(), "something else"]

    def label_scorer():
        """A stand-in model: scores for all labels from the length of the text."""

        def score(batch):
            size = batch["text"].str.len()
            parts = [
                batch[["doc_id"]].assign(label=label, score=(size * (i * 2 + 3) + i * 13) % 97 / 100.0)
                for i, label in enumerate(labels)
            ]
            return pd.concat(parts)

        return score

    body = classification_text(F.col("content"), F.col("description"), F.col("title"))
    articles = tables.messages(spark, d).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "confidence", "title", "description", body.alias("text")
    )
    # Both ways go on from one scan of the texts.
    articles = stored(classify.with_keyword_scores(articles, DICTIONARY_EXAMPLE), "keyword_scores")
    scores = score_with(
        category_requests(articles, DICTIONARY_EXAMPLE, scores="keyword_scores"), label_scorer, "doc_id bigint, label string, score double"
    )
    decided = classify.classify(articles, DICTIONARY_EXAMPLE, classify.model_table(scores), scores="keyword_scores")
    return decided.select("doc_id", "category", "method", r9("category_confidence").alias("category_confidence"))


_SHOWN = ", ".join(f"printf('%.3f', {c})" for c in ("category_confidence", "ml_score", "keyword_score", "model_confidence", "confidence"))


@query(with_ctes("docs msg", KEYWORDS + MODEL + DECISION + f""",
    shown AS (SELECT n, method, category, category_confidence, confidence, CASE WHEN ks >= 0.6 THEN 0 ELSE bm END AS ml_score,
      CASE WHEN ks >= 0.6 THEN ks ELSE bk END AS keyword_score, CASE WHEN ks >= 0.6 OR NOT usable THEN 0 ELSE s.score END AS model_confidence
      FROM decided JOIN (SELECT n, score FROM top3 WHERE rank = 1) s USING (n) WHERE confidence IS NOT NULL)
    SELECT n AS doc_id, concat_ws(',', 'CLASSIFICATION', method, category, {_SHOWN}) AS line FROM shown"""))
def classification_audit(spark, d):
    return classify.classification_audit(_classified(spark, d))


_NAMES = " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in CATEGORY_NAMES.items())


@query(with_ctes("msg", f"""SELECT CASE category {_NAMES} ELSE 'General News' END AS rollup_name,
    CASE coalesce(category, 'J') {_NAMES} ELSE 'General News' END AS card_name, count(*) AS n FROM msg GROUP BY ALL"""))
def category_names(spark, d):
    c = F.col("category")
    return tables.messages(spark, d).groupBy(
        category_name(c).alias("rollup_name"), category_name(c, missing_as_default=True).alias("card_name")
    ).agg(F.count(F.lit(1)).alias("n"))


# --- dictionary upkeep --------------------------------------------------------------------------


def _words(source: str, number: str, expression: str) -> str:
    return f"""SELECT DISTINCT substring('ABCDEFGHIJKLMN', {number} % 14 + 1, 1) AS category, w AS keyword
      FROM (SELECT {number}, unnest(string_split_regex({expression}, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source}) WHERE length(w) > 3"""


_DICT = f"""WITH existing AS ({_words('benchmark', 'item_id', 'lower(text)')}),
    offered AS ({_words('conversations', 'conv_id', 'text')}),
    diff AS (SELECT category, keyword, NOT EXISTS (SELECT 1 FROM existing e
      WHERE e.category = o.category AND lower(e.keyword) = lower(o.keyword)) AS is_new FROM offered o)
    """


@query(_DICT + "SELECT category, count(*) AS keywords FROM existing GROUP BY ROLLUP (category)")
def keyword_counts(spark, d):
    return keywords.keyword_counts(tables.keyword_tables(spark, d)[0])


_MERGED = """, merged AS (SELECT category, keyword FROM existing UNION SELECT category, keyword FROM diff WHERE is_new)"""


def _merged(spark, d):
    return keywords.merge_keywords(*tables.keyword_tables(spark, d), dry_run=False)


@query(_DICT + _MERGED + """, words AS (SELECT DISTINCT category, lower(keyword) AS w, left(lower(keyword), 4) AS lead FROM merged),
    texts AS (SELECT row_number() OVER () AS n, lower(text) AS low FROM documents),
    places AS (SELECT n, unnest(range(1, length(low) + 1)) AS pos, low FROM texts),
    windows AS (SELECT n, pos, substring(low, pos, (SELECT max(length(w)) FROM words)) AS win FROM places),
    begun AS (SELECT n, pos, win, left(win, k) AS lead FROM windows, (SELECT DISTINCT length(lead) AS k FROM words) WHERE length(win) >= k),
    hits AS (SELECT n, category, pos, max(length(w)) AS size FROM begun JOIN words USING (lead) WHERE starts_with(win, w) GROUP BY ALL),
    lists AS (SELECT n, category, list({'pos': pos, 'fin': pos + size, 'k': 0} ORDER BY pos) AS hs FROM hits GROUP BY ALL),
    found AS (SELECT category, list_reduce(hs, lambda a, h: CASE WHEN h.pos >= a.fin THEN {'pos': h.pos, 'fin': h.fin, 'k': a.k + 1} ELSE a END,
        {'pos': 0::BIGINT, 'fin': 0::BIGINT, 'k': 0}).k AS k FROM lists)
    SELECT category, count(*) AS docs, sum(k)::BIGINT AS occurrences FROM found GROUP BY category""")
def dictionary_table_hits(spark, d):
    """Matching with a dictionary that is itself a table, the merged one."""
    texts = tables.messages(spark, d).select("doc_id", F.col("content").alias("text"))
    return keywords.table_keyword_stats(texts, _merged(spark, d), "text").groupBy("category").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("occurrences").alias("occurrences")
    )


@query(_DICT + "SELECT category, keyword, is_new FROM diff")
def keyword_additions(spark, d):
    return keywords.keyword_diff(*tables.keyword_tables(spark, d))


@query(_DICT + """SELECT category, coalesce(any_value(existing), 0) AS existing, count(*) FILTER (is_new) AS added,
    count(*) FILTER (NOT is_new) AS duplicates FROM diff
    LEFT JOIN (SELECT category, count(DISTINCT lower(keyword)) AS existing FROM existing GROUP BY category) USING (category)
    GROUP BY category""")
def keyword_merge_dry_run(spark, d):
    return keywords.merge_keywords(*tables.keyword_tables(spark, d), dry_run=True)


@query(_DICT + """SELECT category, keyword FROM existing UNION SELECT category, keyword FROM diff WHERE is_new""")
def keyword_merge(spark, d):
    return keywords.merge_keywords(*tables.keyword_tables(spark, d), dry_run=False)


@query(_DICT + _MERGED + "SELECT category, count(*) AS keywords FROM merged GROUP BY ROLLUP (category)")
def keyword_export(spark, d):
    return export_keywords(_merged(spark, d), work_dir(spark, "keywords"))


@query(_DICT + "SELECT category FROM existing UNION SELECT category FROM offered")
def all_categories(spark, d):
    return classify.all_categories(*tables.keyword_tables(spark, d))
