import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewire.functions import identity, text
from tapewire.functions.patterns import collisions, keyword_flag, word_pattern


def clean_generated(response):
    """The rule, written out row by row."""
    if not response:
        return "N/A"
    cleaned = re.sub(r"(?s)<think>.*?</think>", "", response)
    cleaned = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", cleaned)).strip()
    if cleaned and len(cleaned) <= 200:
        return cleaned
    letter = re.search(r"\b([ABCDE])\b", response)
    if letter:
        return letter.group(1)
    for word in ("POSITIVE", "NEGATIVE", "NEUTRAL"):
        if word in response.upper():
            return word
    listed = re.search(r"(?i)(?:entities|phrases):\s*(.+)", response)
    if "," in response and listed and len(listed.group(1).strip()) < 500:
        return listed.group(1).strip()
    fitting = [s for s in re.findall(r"[A-Z][^.!?]*[.!?]", response) if 5 < len(s) < 150]
    return fitting[0].strip() if fitting else cleaned or "N/A"


LONG = "word, " * 60
ANSWERS = [
    None, "", "   ", "plain answer", "<think>secret\nthought</think> done", "<b>tag</b>\n\n two", "<think></think>",
    "the answer is B <br>" + LONG, "rather positive " + LONG, "it is NEUTRAL but negative " + LONG,
    "Entities: Acme, Foo\nmore " + LONG, "Key phrases:   \n  one, two\n" + LONG, LONG + "Entities: " + "x" * 600 + " Ok then.",
    "x" * 250, LONG.replace(",", "") + "Then it ended. Ah!", "éA " + LONG + " Bé", "<p>" * 80, "a" * 200, "a" * 201,
]


def test_clean_generated(column):
    assert column(text.clean_generated, ANSWERS) == [clean_generated(a) for a in ANSWERS]


def validate(raw, source):
    if not raw or raw.strip().lower() == "n/a":
        return "N/A"
    kept = []
    for p in (p.strip() for p in raw.split(",")):
        words = [w for w in p.lower().split() if len(w) > 3]
        if len(p) >= 2 and p.lower() != "n/a" and any(w in source.lower() for w in words):
            kept.append(p)
    return ", ".join(kept) or "N/A"


@pytest.mark.parametrize(
    "raw", [None, "", " n/a ", "Acme Corp, ghosts, ACME,  oil", "x, an, n/a", "fell sharply,Acme", ",,", "none such"]
)
def test_validate_phrases(spark, raw):
    source = "Acme Corp fell Sharply on oil worries"
    df = spark.createDataFrame([(raw, source)], "raw string, source string")
    assert df.select(text.validate_phrases(F.col("raw"), F.col("source"))).first()[0] == validate(raw, source)


def test_text_choices(spark):
    rows = [("s", "d", "t"), ("", "d<br>", "t"), (None, "", "t"), ("<p>", "d", "t"), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, d string, t string")
    s, d, t = F.col("s"), F.col("d"), F.col("t")
    got = df.select(text.article_text(s, d, t), text.classification_text(s, d, t)).collect()
    assert [tuple(r) for r in got] == [("s", "s"), ("d", "d"), ("t", "t"), ("", "t"), ("", "")]


def test_extraction_and_model_input(spark):
    df = spark.createDataFrame([(" T ", "  " + "d" * 300), ("T", " "), (None, None)], "t string, d string")
    got = [r[0] for r in df.select(text.extraction_text(F.col("t"), F.col("d"))).collect()]
    assert got == ["T. " + "d" * 200, "T", ""]
    parts = df.select(text.model_input(F.lit("x" * 600), F.lit("short"), F.lit("long enough here"))).first()[0]
    assert parts == ("long enough here " + "x" * 600)[:512]
    assert df.select(text.model_input(F.lit("too short"))).first()[0] == ""


def test_small_text_columns(column):
    assert column(text.clean_text, ["a<b c>d", "1 < 2", None]) == ["ad", "1 < 2", ""]
    assert column(text.top_phrases, ["a, b ,c,d", "", None]) == [["a", "b", "c"], None, None]
    assert column(lambda x: text.long_enough(x, 10), ["  123456789 ", "1234567890", None]) == [False, True, False]


TIMES = [
    ("2026-03-18T07:20:00.000000Z", 1773818400), ("2026-03-18T07:20:00.123456Z", 1773818400),
    ("2026-03-18T07:20:00Z", 1773818400), ("2026-03-18T07:20:00.123+00:00", 1773818400),
    ("2026-03-18 07:20:00", 1773818400), ("2026-03-18T07:20:00+05:00", 1773800400), ("junk", None), (None, None),
    ("2026-03-18", None), ("2026-02-30T07:20:00Z", None), ("2026-03-18T07:20:00", None), ("2026-03-18T07:20:00.12Z", None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_publication_times(spark, column, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(identity.to_epoch_ms, [t for t, _ in TIMES])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [None if s is None else s * 1000 for _, s in TIMES]


def test_time_buckets(column):
    ms = [1773818400123, -1, None]
    assert column(identity.hour_bucket, ms, "bigint") == [1773817200000, -3600000, None]
    assert column(identity.hour_label, ms, "bigint") == ["2026-03-18 07:00", "1969-12-31 23:00", None]
    assert column(identity.minute_bucket, ms, "bigint") == [29563640, -1, None]
    assert column(identity.date_to_ms, ["2024-01-02", "2024-01-02T00:00:01", "2024-01-02T00:00:00+01:00", "x"]) == [
        1704153600000, 1704153601000, 1704150000000, None]


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("t", "s"), (None, "s"), ("t", None)], "t string, s string")
    got = [r[0] for r in df.select(identity.extract_doc_id(F.col("t"), F.col("s"))).collect()]
    assert got == [hashlib.sha256(k.encode()).hexdigest() for k in ("ts", "s", "t")]
    c = df.select(identity.index_doc_id(F.lit(None), F.lit("src"), F.lit("T"), F.lit(None))).first()[0]
    assert c == hashlib.sha256(b"_src_T_default").hexdigest()


words = st.lists(st.text(alphabet="abc é&+-", min_size=1, max_size=5), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(words, st.text(alphabet="abc é&+-", max_size=40))
def test_prefix_tree_equals_longest_first_alternation(ws, sample):
    flat = "|".join(re.escape(w) for w in sorted(set(ws), key=lambda w: (-len(w), w)))
    assert re.findall(word_pattern(ws), sample) == re.findall(flat, sample)


@settings(max_examples=100, deadline=None)
@given(words, st.text(alphabet="abc é&+-", max_size=40))
def test_collisions_are_found(ws, sample):
    at = [[w for w in set(ws) if sample.startswith(w, i)] for i in range(len(sample))]
    overlap = any(at[j] for i in range(len(sample)) for w in at[i] for j in range(i + 1, min(i + len(w), len(sample))))
    assert overlap == any(text in sample for text in collisions(ws))


def test_keyword_flag(column):
    hits = column(lambda x: keyword_flag(["m&a", "opec+", "cut"], x), ["big M&A deal", "OPEC+ met", "shortCUTs", "opec", None])
    assert hits == [True, True, True, False, None]
    assert column(lambda x: keyword_flag([], x), ["any"]) == [False]
