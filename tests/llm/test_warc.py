import hashlib

import pytest

from tapewire.llm import warc
from tapewire.sources.sinks import work_dir

PAGES = [
    (1, "http://a/1", "<html><head><title> A &amp; B </title><script>var x='<p>';</script></head><body><p>One<br>two&nbsp;&#233;&#x1F600;</p><!-- no --><a class=x href=\"/l?a=1&amp;b=2\">link</a> 3 < 4</body></html>"),
    (2, "http://a/2", ""), (3, None, None), (4, "http://a/4", "plain &lt;b&gt; &#0; &#xD800; &#9999999; &# ; text"), (4, "http://a/4", "plain"),
    (None, "http://a/5", "<p>unclosed <b>x"), (6, "http://a/6", "<p>" + "long text " * 100_000),
]


@pytest.fixture
def found(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' AS block", "'y' AS record_type")
    return warc.responses(pages)


def test_two_linked_records_for_each_response(found):
    rows = warc.derivatives(found, keep=("source_id",)).collect()
    assert len(rows) == 2 * len(PAGES)
    sources = {r.record_id: r for r in found.collect()}
    for r in rows:
        source = sources[r.refers_to]
        assert r.target_uri == source.target_uri and r.date == source.date
        assert r.payload_digest == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode())
    assert len({r.record_id for r in rows}) == 2 * len(sources)
    converted = {r.refers_to: r.record_id for r in rows if r.record_type == "conversion"}
    for r in rows:
        if r.record_type == "metadata":
            assert f"conversion: {converted[r.refers_to]}\r\n" in r.block
            assert "http-status: 200\r\nhttp-content-type: text/html; charset=UTF-8\r\n" in r.block


def test_text_title_and_links(found):
    rows = {(r.source_id, r.record_type): r.block for r in warc.derivatives(found, keep=("source_id",)).collect()}
    assert rows[1, "conversion"] == "A & B\nOne\ntwo é😀\nlink 3 < 4"
    assert "title: A & B\r\n" in rows[1, "metadata"] and "outlink: /l?a=1&b=2\r\n" in rows[1, "metadata"]
    assert rows[2, "conversion"] == "" and rows[3, "conversion"] == ""
    assert len(rows[6, "conversion"]) == 999_999


def test_unescaped_numbers(spark):
    df = spark.createDataFrame([("a&#65;&#x42;c&amp;#67; &#0;&#xD800;&#;&lt;",)], "x string")
    from pyspark.sql import functions as F

    assert df.select(warc.unescaped(F.col("x"))).first()[0] == "aABc&#67; &#0;&#xD800;&#;<"


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_files_round_trip(spark, found, compression):
    records = warc.derivatives(found)
    path = work_dir(spark, "warc")
    warc.write_warc(records, path, compression)
    back = warc.read_warc(spark, path)
    assert back.where("intact").count() == back.count() == records.count()
    key = lambda r: (r.record_id, r.block, r.refers_to, r.target_uri or None, r.content_length)
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, records.collect()), key=str)


def test_nothing(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.derivatives(warc.responses(pages)).collect() == []
    bare = spark.createDataFrame([("<a>", None, None, None, None)], "record_id string, target_uri string, date string, http_headers string, payload string")
    assert [r.block for r in warc.derivatives(bare).orderBy("record_type").collect()][0] == ""
