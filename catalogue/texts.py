"""Text preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import STRIP, query, r9, with_ctes
from tapewire.functions import text
from tapewire.operators.model_hooks import score_with
from tapewire.plans import driver_tables as tables
from tapewire.plans.enrich import generation_requests as enrich_requests
from tapewire.plans.enrich import sentiment_requests


@query("SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g') AS text FROM pages")
def strip_tags(spark, d):
    return tables.table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


_T, _S = STRIP("title"), STRIP("substring(text, 1, 200)")
_LONG = """coalesce(nullif(CASE WHEN n % 4 = 0 THEN '' WHEN n % 4 = 1 THEN NULL ELSE text END, ''), nullif(substring(text, 1, 200), ''), title)"""


def _parts(spark, d):
    """Documents with the body missing or empty in half of the rows."""
    n = F.col("doc_id")
    kind = F.pmod(n, F.lit(4))
    return tables.table(spark, d, "documents").select(
        "doc_id",
        F.substring("text", 1, 80).alias("title"),
        F.substring("text", 1, 200).alias("description"),
        F.when(kind == 0, "").when(kind >= 2, F.col("text")).alias("snippet"),
        "text",
    )


@query(f"""SELECT n AS doc_id, regexp_replace({_LONG}, '<[^>]+>', '', 'g') AS article_text,
    coalesce(nullif(regexp_replace({_LONG.replace(', title)', ')')}, '<[^>]+>', '', 'g'), ''), title) AS classification_text
    FROM (SELECT doc_id AS n, text, substring(text, 1, 80) AS title FROM documents)""")
def article_texts(spark, d):
    return _parts(spark, d).select(
        "doc_id",
        text.article_text(F.col("snippet"), F.col("description"), F.col("title")).alias("article_text"),
        text.classification_text(F.col("snippet"), F.col("description"), F.col("title")).alias("classification_text"),
    )


@query(f"""SELECT n AS doc_id, substring(CASE WHEN {_S} <> '' THEN {_T} || '. ' || substring({_S}, 1, 200) ELSE {_T} END, 1, 400)
    AS extraction_text FROM (SELECT doc_id AS n, text, substring(text, 1, 80) AS title FROM documents)""")
def extraction_text(spark, d):
    return _parts(spark, d).select(
        "doc_id", text.extraction_text(F.col("title"), F.col("description")).alias("extraction_text")
    )


_B = STRIP("text")


@query(f"""SELECT n AS doc_id, substring(concat_ws(' ', CASE WHEN length({_T}) > 5 THEN {_T} END,
      CASE WHEN length({_S}) > 10 THEN {_S} END, CASE WHEN length({_B}) > 10 THEN {_B} END), 1, 512) AS model_input,
    length({_B}) >= 10 AS for_sentiment, length({_B}) >= 15 AS for_category
    FROM (SELECT doc_id AS n, text, substring(text, 1, 80) AS title FROM documents)""")
def model_input_text(spark, d):
    body = F.col("text")
    return _parts(spark, d).select(
        "doc_id",
        text.model_input(body, F.col("title"), F.col("description")).alias("model_input"),
        text.long_enough(body, 10).alias("for_sentiment"),
        text.long_enough(body, 15).alias("for_category"),
    )


_CLEAN = STRIP(f"regexp_replace(regexp_replace(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '<[^>]+>', '', 'g'), '[\\s\\x{{85}}\\x{{a0}}]+', ' ', 'g')")
_LETTER = r"regexp_extract(text, '(?:^|[^\p{L}\p{N}_])([ABCDE])(?:$|[^\p{L}\p{N}_])', 1)"
_LISTED = r"regexp_extract(text, '(?i)(?:entities|phrases):\s*(.+)', 1)"
_SENTENCE = "list_filter(regexp_extract_all(text, '[A-Z][^.!?]*[.!?]'), lambda s: length(s) > 5 AND length(s) < 150)"


@query(f"""SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'N/A'
    WHEN cleaned = '' OR length(cleaned) > 200 THEN CASE
      WHEN letter <> '' THEN letter
      WHEN contains(upper(text), 'POSITIVE') THEN 'POSITIVE' WHEN contains(upper(text), 'NEGATIVE') THEN 'NEGATIVE'
      WHEN contains(upper(text), 'NEUTRAL') THEN 'NEUTRAL'
      WHEN contains(text, ',') AND listed <> '' AND length({STRIP('listed')}) < 500 THEN {STRIP('listed')}
      WHEN len(sentences) > 0 THEN {STRIP('sentences[1]')}
      WHEN cleaned <> '' THEN cleaned ELSE 'N/A' END
    ELSE cleaned END AS cleaned
    FROM (SELECT conv_id, turn, text, {_CLEAN} AS cleaned, {_LETTER} AS letter, {_LISTED} AS listed,
      {_SENTENCE} AS sentences FROM conversations)""")
def clean_generated(spark, d):
    return tables.table(spark, d, "conversations").select(
        "conv_id", "turn", text.clean_generated(F.col("text")).alias("cleaned")
    )


@query(f"""WITH pairs AS (SELECT a.conv_id, a.turn, a.text AS phrases, u.text AS source FROM conversations a
      JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1),
    parts AS (SELECT *, list_transform(string_split(phrases, ','), lambda p: {STRIP('p')}) AS ps FROM pairs)
    SELECT conv_id, turn, coalesce(nullif(array_to_string(list_filter(ps, lambda p: length(p) >= 2 AND lower(p) <> 'n/a' AND
      len(list_filter(string_split_regex(lower(p), '\\s+'), lambda w: length(w) > 3 AND contains(lower(source), w))) > 0), ', '), ''), 'N/A')
      AS key_phrases FROM parts""")
def validate_phrases(spark, d):
    turns = tables.table(spark, d, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    return turns.join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.validate_phrases(F.col("text"), F.col("source")).alias("key_phrases")
    )


@query(f"""SELECT conv_id, turn, array_to_string(list_transform(list_slice(string_split(text, ','), 1, 3), lambda p: {STRIP('p')}), '|')
    AS phrases FROM conversations""")
def top_phrases(spark, d):
    return tables.table(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(text.top_phrases(F.col("text")), "|").alias("phrases")
    )


@query(with_ctes("scored", """SELECT doc_id, coalesce(nullif(title, ''), 'No Title') AS title,
    coalesce(nullif(summary, ''), nullif(description, ''), substring(content, 1, 150) || '...') AS summary,
    coalesce(nullif(source, ''), 'Unknown Source') AS source, "publishedAt", sentiment, risk_raw AS risk,
    round(CASE WHEN conf_norm <> 0 THEN conf_norm
      WHEN confidence <> 0 AND confidence <= 1 THEN confidence WHEN confidence <> 0 THEN confidence / 100 ELSE 0.8 END, 9) AS confidence,
    coalesce(category, 'J') AS category,
    array_to_string(list_transform(list_slice(string_split(nullif(key_phrases, ''), ','), 1, 3), lambda p: trim(p)), '|') AS phrases
    FROM scored"""))
def display_view(spark, d):
    shown = text.display_view(tables.scored(spark, d))
    joined = F.when(F.size("phrases") > 0, F.array_join("phrases", "|"))
    return shown.withColumns({"confidence": r9("confidence"), "phrases": joined})


@query(f"""SELECT n AS doc_id, CASE WHEN length(m) % 2 = 0 THEN 'positive' ELSE 'negative' END AS label, length(m) / 512e0 AS score
    FROM (SELECT doc_id AS n, substring(CASE WHEN length({_B}) > 10 THEN {_B} ELSE '' END, 1, 512) AS m
      FROM documents WHERE length({_B}) >= 10)""")
def sentiment_model_hook(spark, d):
    # A function inside a function travels to the workers by value, not by import.
    def length_scorer():
        """A stand-in model: label by parity of the length, score by its size."""

        def score(batch):
            size = batch["text"].str.len()
            label = (size % 2).map({0: "positive", 1: "negative"})
            return batch[["doc_id"]].assign(label=label, score=size / 512.0)

        return score

    requests = sentiment_requests(_parts(spark, d).withColumn("snippet", F.col("text")))
    return score_with(requests, length_scorer, "doc_id bigint, label string, score double")


@query(f"""SELECT n AS doc_id, length(substring(CASE WHEN {_S} <> '' THEN {_T} || '. ' || substring({_S}, 1, 200) ELSE {_T} END, 1, 400))
    AS size FROM (SELECT doc_id AS n, text, substring(text, 1, 80) AS title FROM documents)""")
def generation_requests(spark, d):
    return enrich_requests(_parts(spark, d)).select("doc_id", F.length("text").cast("bigint").alias("size"))
