"""WARC derivatives: of every response a metadata record and a plain-text conversion record.

Both name their response in ``WARC-Refers-To`` and keep its target, date and payload digest; the
metadata record also keeps its headers.  Records are rows; `write_warc` and `read_warc` turn
them into files and back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, payload_digest string, block_digest string, content_length bigint, block string"
)

# Elements whose content is no text, elements that end a line, named entities.
SILENT = ("script", "style", "noscript", "template")
LINES = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|"
    "li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·",
    "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "euro": "€", "bull": "•", "trade": "™",
}


def urn(c: Column) -> Column:
    """A record id that depends on a text only."""
    h = F.md5(c.cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def sha256(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def _letter(part: Column) -> Column:
    """``123;rest`` or ``x7b;rest``, what follows ``&#``, with the character of that number."""
    hexed, decimal = F.regexp_extract(part, "^[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(part, "^([0-9]{1,7});", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(decimal != "", decimal).cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(valid, F.concat(letter, F.regexp_replace(part, "^[xX]?[0-9a-fA-F]+;", ""))).otherwise(F.concat(F.lit("&#"), part))


def _named(part: Column) -> Column:
    """What follows ``&``, with the character of a named entity at its beginning."""
    name = F.substring_index(part, ";", 1)
    names = F.create_map(*[F.lit(x) for pair in [*ENTITIES.items(), ("amp", "&")] for x in pair])
    letter = F.when(F.contains(part, F.lit(";")), F.element_at(names, name))
    return F.when(letter.isNotNull(), F.concat(letter, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))


def _behind(c: Column, sign: str, read: Callable[[Column], Column]) -> Column:
    """``c``, looked at once, with everything between two signs, and behind the last, read anew."""
    return F.array_join(F.transform(F.split(c, sign, -1), lambda p, i: F.when(i == 0, p).otherwise(read(p))), "")


def unescaped(c: Column) -> Column:
    """Entities as their characters: numbers first, then names, each ampersand read once."""
    return _behind(_behind(c, "&#", _letter), "&", _named)


def plain_text(html: Column) -> Column:
    """The text of a page: no comments, scripts or tags, a line per block, single spaces."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in SILENT:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?({LINES})\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"</?[a-zA-Z!][^>]*>", "")
    out = unescaped(out)
    out = F.regexp_replace(out, r"[ \t\x0B\f\r]+", " ")
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)
    return F.btrim(F.regexp_replace(unescaped(F.regexp_replace(raw, r"</?[a-zA-Z!][^>]*>", "")), r"\s+", " "))


def links(html: Column) -> Column:
    """The distinct targets of links, in the order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1)), unescaped))


def responses(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Response records of a table of pages, with ``http_headers`` and ``payload``.

    Null pages have an empty payload, null addresses an empty target.  The record id depends on
    id, address and payload, so it is the same in every run.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    uri = F.coalesce(F.col(url_col), F.lit(""))
    name = F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), uri, F.md5(payload.cast("binary")))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n")
    )
    return pages.select(
        F.col(id_col).alias("source_id"), urn(name).alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"),
        headers.alias("http_headers"), payload.alias("payload"),
    )


def derivatives(of: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A metadata and a conversion record for every row of ``of`` (see `responses`).

    ``of`` has ``record_id``, ``target_uri``, ``date``, ``http_headers`` and ``payload`` (HTML); columns
    named in ``keep`` are carried along, all others ignored.  The metadata block has one field per
    line: the status, each header of the response as ``http-<name>``, the payload's digest, title and
    ``outlink`` lines, and the conversion record's id.  Null headers, payload or address count as
    empty; an empty payload gives an empty conversion.  Repeated rows give repeated records.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    source = of.select(
        *keep, F.col("record_id").alias("_of"), empty("target_uri").alias("_uri"), empty("date").alias("_date"),
        empty("http_headers").alias("_http"), empty("payload").alias("_html"),
    )
    known = source.select("*", sha256(F.col("_html")).alias("_digest"), plain_text(F.col("_html")).alias("_text"))
    lines = F.filter(F.split(F.regexp_replace("_http", r"\r\n[ \t]+", " "), "\r\n"), lambda x: x.rlike("^[^:\\s]+:"))
    fields = F.transform(lines, lambda x: F.concat(F.lit("http-"), F.lower(F.substring_index(x, ":", 1)), F.lit(": "), F.btrim(F.regexp_replace(x, "^[^:]*:", ""))))
    status = F.regexp_extract("_http", r"^HTTP/\S+\s+(\d+)", 1)
    converted = urn(F.concat_ws("|", F.lit("conversion"), "_of"))
    block = F.concat_ws(
        "\r\n",
        F.concat(F.lit("http-status: "), status), fields, F.concat(F.lit("source-payload-digest: "), "_digest"),
        F.concat(F.lit("title: "), title(F.col("_html"))), F.concat(F.lit("conversion: "), converted),
        F.transform(links(F.col("_html")), lambda x: F.concat(F.lit("outlink: "), x)), F.lit(""),
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("t"), urn(F.concat_ws("|", F.lit("metadata"), "_of")).alias("i"), F.lit("application/warc-fields").alias("c"), block.alias("b")),
        F.struct(F.lit("conversion").alias("t"), converted.alias("i"), F.lit("text/plain; charset=UTF-8").alias("c"), F.col("_text").alias("b")),
    )
    each = known.withColumn("_r", F.explode(two))
    body = F.col("_r.b")
    return each.select(
        *keep, F.col("_r.t").alias("record_type"), F.col("_r.i").alias("record_id"), F.col("_of").alias("refers_to"),
        F.col("_uri").alias("target_uri"), F.col("_date").alias("date"), F.col("_r.c").alias("content_type"),
        F.col("_digest").alias("payload_digest"), sha256(body).alias("block_digest"),
        F.octet_length(body).cast("bigint").alias("content_length"), body.alias("block"),
    )


# --- files ------------------------------------------------------------------------------------------

_HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest",
    "content_length": "Content-Length",
}


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes records as WARC files, one per partition."""
    header = [
        F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) for c, name in _HEADERS.items()
    ]
    text = F.concat(F.concat_ws("\r\n", F.lit(VERSION), *header), F.lit("\r\n\r\n"), F.coalesce("block", F.lit("")))
    writer = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n")
    (writer.option("compression", compression) if compression else writer).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of text blocks, and whether each is ``intact``, as its length says.

    Files are split at lines that begin a record; a block that holds such a line comes out in
    parts that are not intact.  Missing headers are null.
    """
    parts = spark.read.option("lineSep", f"{VERSION}\r\n").text(path).where("trim(value) <> ''")
    cut = F.locate("\r\n\r\n", F.col("value"))
    head = F.when(cut > 0, F.substring("value", F.lit(1), cut - 1)).otherwise(F.lit(""))
    body = F.when(cut > 0, F.substring(F.col("value"), cut + 4, F.length("value"))).otherwise(F.col("value"))
    rows = parts.select(head.alias("head"), F.regexp_replace(body, r"\r\n\r\n$", "").alias("block"))
    named = [F.nullif(F.regexp_extract("head", rf"(?im)^{name}: ?(.*?)\r?$", 1), F.lit("")).alias(c) for c, name in _HEADERS.items()]
    out = rows.select(*named, "block").withColumn("content_length", F.col("content_length").cast("bigint"))
    intact = F.coalesce(F.octet_length("block") == F.col("content_length"), F.lit(False))
    return out.withColumn("intact", intact & F.coalesce(sha256(F.col("block")) == F.col("block_digest"), F.lit(True)))
