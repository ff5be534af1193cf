"""Ids and times as Column expressions.

Every time function works on epoch milliseconds or on text and reads a missing
zone as UTC, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
MINUTE_MS = 60_000

# The shapes that are read as a publication date, and no others.
_DATE_SHAPES = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:T\d{2}:\d{2}:\d{2}(?:\.\d{6}Z|(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2}))"
    r"| \d{2}:\d{2}:\d{2})$"
)


def extract_doc_id(title: Column, snippet: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))), 256)


def index_doc_id(symbol: Column, source: Column, title: Column, published: Column) -> Column:
    return F.sha2(
        F.concat_ws(
            "_",
            F.coalesce(symbol, F.lit("")),
            F.coalesce(source, F.lit("")),
            title,
            F.coalesce(published, F.lit("default")),
        ),
        256,
    )


def first_or_null(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def to_epoch_ms(c: Column) -> Column:
    """Publication text to epoch milliseconds at whole seconds; null for other shapes.

    One shape test and one native cast per row.  Trying a pattern list instead
    throws inside the JVM for each miss, which is what costs at scale.
    """
    zoned = F.when(F.length(c) == 19, F.concat(c, F.lit("Z"))).otherwise(c)
    return F.when(c.rlike(_DATE_SHAPES), F.unix_seconds(zoned.try_cast("timestamp")) * F.lit(1000))


def date_to_ms(c: Column) -> Column:
    """ISO date or date-time text to epoch milliseconds; a bare date is UTC midnight."""
    has_zone = c.rlike(r"(?:Z|[+-]\d{2}:\d{2})$") & (F.length(c) > 10)
    full = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00Z"))).when(
        ~has_zone, F.concat(c, F.lit("Z"))
    ).otherwise(c)
    return F.unix_millis(full.try_cast("timestamp"))


def hour_bucket(ms: Column) -> Column:
    """Epoch milliseconds of the start of the UTC hour."""
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def hour_label(ms: Column) -> Column:
    """``yyyy-MM-dd HH:00`` of the UTC hour, in any session time zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(24 * HOUR_MS)).cast("int"))
    hour = F.floor(F.pmod(ms, F.lit(24 * HOUR_MS)) / F.lit(HOUR_MS)).cast("string")
    return F.concat(day.cast("string"), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":00"))


def minute_bucket(ms: Column) -> Column:
    return F.floor(ms / F.lit(MINUTE_MS)).cast("bigint")


def article_age(ms: Column, now_ms: Column) -> Column:
    """Whole minutes between publication and ``now_ms``."""
    return F.floor((now_ms - ms) / F.lit(MINUTE_MS)).cast("bigint")
