"""Text preparation as Column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as blank at the ends of a text; plain trim() only knows the space.
WHITESPACE = (
    " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def non_empty(c: Column) -> Column:
    """Null when the text is null or empty."""
    return F.nullif(c, F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols])


def clean_text(c: Column) -> Column:
    """Delete every tag; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")


def article_text(snippet: Column, description: Column, title: Column) -> Column:
    return clean_text(first_non_empty(snippet, description, title))


def classification_text(content: Column, description: Column, title: Column) -> Column:
    body = clean_text(first_non_empty(content, description))
    return F.coalesce(non_empty(body), title, F.lit(""))


def extraction_text(title: Column, description: Column) -> Column:
    head = strip(F.coalesce(title, F.lit("")))
    tail = strip(F.coalesce(description, F.lit("")))
    joined = F.when(tail != "", F.concat(head, F.lit(". "), F.substring(tail, 1, 200))).otherwise(head)
    return F.substring(joined, 1, 400)


def model_input(text: Column, title: Column | None = None, description: Column | None = None) -> Column:
    """Parts that are long enough, joined by a blank and cut to 512 characters."""
    parts = [(title, 5), (description, 10), (text, 10)]
    kept = [F.when(F.length(strip(c)) > n, strip(c)) for c, n in parts if c is not None]
    return F.substring(F.concat_ws(" ", *kept), 1, 512)


def long_enough(text: Column, n: int) -> Column:
    """Gate before a model call: 10 characters for sentiment, 15 for categories."""
    return F.coalesce(F.length(strip(text)) >= n, F.lit(False))


def clean_generated(c: Column) -> Column:
    """Reduce the raw answer of a text generator to one usable value.

    ``(?U)`` makes blanks and word edges follow Unicode, ``(?d)`` lets ``.`` stop
    at line feeds only.
    """
    without_thought = F.regexp_replace(c, "(?s)<think>.*?</think>", "")
    without_tags = F.regexp_replace(without_thought, "<[^>]+>", "")
    cleaned = strip(F.regexp_replace(without_tags, r"(?U)\s+", " "))
    letter = F.regexp_extract(c, r"(?U)\b([ABCDE])\b", 1)
    listed = F.regexp_extract(c, r"(?iUd)(?:entities|phrases):\s*(.+)", 1)
    sentence = F.get(
        F.filter(
            F.regexp_extract_all(c, F.lit("[A-Z][^.!?]*[.!?]"), F.lit(0)),
            lambda s: (F.length(s) > 5) & (F.length(s) < 150),
        ),
        F.lit(0),
    )
    rescued = F.when(letter != "", letter)
    for word in ("POSITIVE", "NEGATIVE", "NEUTRAL"):
        rescued = rescued.when(F.contains(F.upper(c), F.lit(word)), F.lit(word))
    rescued = (
        rescued.when(
            F.contains(c, F.lit(",")) & (listed != "") & (F.length(strip(listed)) < 500),
            strip(listed),
        )
        .when(sentence.isNotNull(), strip(sentence))
        .otherwise(F.coalesce(non_empty(cleaned), F.lit("N/A")))
    )
    unusable = (cleaned == "") | (F.length(cleaned) > 200)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", F.lit("N/A"))
        .when(unusable, rescued)
        .otherwise(cleaned)
    )


def validate_phrases(phrases: Column, source: Column) -> Column:
    """Keep the phrases of which some word longer than 3 letters occurs in the source."""
    haystack = F.lower(source)
    trimmed = F.transform(F.split(phrases, ","), strip)

    def grounded(p: Column) -> Column:
        low = F.lower(p)
        return (
            (F.length(low) >= 2)
            & (low != "n/a")
            & F.exists(
                F.split(low, r"(?U)\s+"),
                lambda w: (F.length(w) > 3) & F.contains(haystack, w),
            )
        )

    kept = F.array_join(F.filter(trimmed, grounded), ", ")
    return F.coalesce(non_empty(kept), F.lit("N/A"))


def top_phrases(c: Column, n: int = 3) -> Column:
    return F.transform(F.slice(F.split(non_empty(c), ","), 1, n), strip)


def iso_date(c: Column) -> Column:
    """Timestamp to ISO text; the fraction is shown only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micro = F.date_format(c, "SSSSSS")
    return F.when(micro == "000000", whole).otherwise(F.concat(whole, F.lit("."), micro))


def _truthy(c: Column) -> Column:
    """Null when the number is null, zero or not a number."""
    return F.when((c != 0) & ~F.isnan(c), c)


def display_confidence(conf_norm: Column, confidence: Column) -> Column:
    scaled = F.when(confidence <= 1, confidence).otherwise(confidence / 100.0)
    return F.coalesce(_truthy(conf_norm), _truthy(scaled), F.lit(0.8))


def display_view(df: DataFrame) -> DataFrame:
    """The article card: every shown field with its fallback."""
    teaser = F.when(F.col("content").isNotNull(), F.concat(F.substring("content", 1, 150), F.lit("...")))
    return df.select(
        "doc_id",
        F.coalesce(non_empty(F.col("title")), F.lit("No Title")).alias("title"),
        F.coalesce(
            non_empty(F.col("summary")), non_empty(F.col("description")), teaser,
            F.lit("No summary available"),
        ).alias("summary"),
        F.coalesce(non_empty(F.col("source")), F.lit("Unknown Source")).alias("source"),
        F.col("publishedAt"),
        F.coalesce(F.col("sentiment"), F.lit(0.0)).alias("sentiment"),
        F.coalesce(_truthy(F.col("risk_raw")), F.lit(0.0)).alias("risk"),
        display_confidence(F.col("conf_norm"), F.col("confidence")).alias("confidence"),
        F.coalesce(non_empty(F.col("category")), F.lit("J")).alias("category"),
        F.coalesce(top_phrases(F.col("key_phrases")), F.array().cast("array<string>")).alias("phrases"),
    )
