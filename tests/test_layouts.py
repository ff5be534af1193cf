"""The keyed table, the table by day and symbol, cursors of pages."""

import random

import pytest
from pyspark.sql import functions as F

from tapewire.operators import filters, rollups, search
from tapewire.operators.search_spec import DAY_MS, SearchSpec
from tapewire.operators.topn import latest_per_id
from tapewire.sources import look_up, read_upserted, sinks, upsert
from tapewire.sources.history import read_history, write_history
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

KIND = StructType([StructField("doc_id", StringType()), StructField("version", IntegerType()), StructField("title", StringType())])


def rows(spark, ids, version):
    return spark.createDataFrame([(f"d{i}", version, f"title {i}") for i in ids], KIND)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def current(spark, path):
    return {r["doc_id"]: r["version"] for r in read_upserted(spark, path, schema=KIND).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert(rows(spark, range(100), 0), path, 0, ("version",), buckets=8)
    files = lambda: {str(p): p.parent.name for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    upsert(rows(spark, [3], 1), path, 1, ("version",))
    gone = {before[name] for name in before.keys() - files().keys()}
    assert len(gone) == 1 and len(set(files().values())) == 8
    assert current(spark, path) == {f"d{i}": int(i == 3) for i in range(100)}
    for k in range(2, 5):
        upsert(rows(spark, range(10), k), path, k, ("version",))
    assert len(files()) <= len(before)  # what is read does not grow with the batches


@pytest.mark.parametrize("when", ["before any folder", "after the folders"])
def test_a_batch_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch, when):
    path = str(tmp_path / "t")
    upsert(rows(spark, range(20), 0), path, 0, ("version",), writer="a")
    settle, calls = sinks._settle, []

    def cut(*args):
        calls.append(1)
        if len(calls) == 2:  # the batch is staged
            if when == "after the folders":
                settle(*args)
                spark.createDataFrame([("a", 1)], sinks.STAGED).write.mode("overwrite").parquet(f"{path}/_staged/ready")
            raise RuntimeError("lost")
        return settle(*args)

    monkeypatch.setattr(sinks, "_settle", cut)
    with pytest.raises(RuntimeError):
        upsert(rows(spark, range(10, 30), 1), path, 1, ("version",), writer="a")
    monkeypatch.setattr(sinks, "_settle", settle)
    upsert(rows(spark, [0], 2), path, 0, ("version",), writer="b")  # another writer finishes it first
    upsert(rows(spark, range(10, 30), 1), path, 1, ("version",), writer="a")  # the retry changes nothing
    assert current(spark, path) == {f"d{i}": 2 if i == 0 else int(i >= 10) for i in range(30)}


def test_look_up_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    assert look_up(spark, path, "d1", schema=KIND).collect() == []
    upsert(rows(spark, range(50), 0), path, 0, ("version",), buckets=8)
    found = look_up(spark, path, "d7", schema=KIND)
    assert [r["title"] for r in found.collect()] == ["title 7"]
    assert "bucket" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    assert len(found.inputFiles()) >= 1 and found.select(F.input_file_name()).distinct().count() == 1
    assert look_up(spark, path, "none", schema=KIND).collect() == []


def test_latest_rows_move_once(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "z"), ("a", 1, "y"), ("b", None, None), (None, 2, "n"), (None, 3, "m")], KIND)
    assert sorted(map(tuple, latest_per_id(df, "doc_id", ["version"]).collect()), key=str) == [("a", 1, "y"), ("b", None, None), (None, 3, "m")]
    assert plan(latest_per_id(df, "doc_id", ["version"])).count("Exchange") == 1


def test_days_and_symbols_are_folders(spark, tmp_path):
    path, rng = str(tmp_path / "h"), random.Random(1)
    made = [(f"d{i}", rng.choice((None, rng.randrange(10 * DAY_MS))), rng.choice(("S1", "S2", "", None)), float(i)) for i in range(300)]
    kinds = {"doc_id": StringType(), "publishedAt": LongType(), "symbol": StringType(), "final_score": DoubleType()}
    schema = StructType([StructField(*f) for f in kinds.items()])
    df = spark.createDataFrame(made, schema)
    write_history(df, path)
    table = read_history(spark, path, schema)
    assert sorted(map(str, table.select(*schema.names).collect())) == sorted(map(str, df.collect()))
    for low, high in ((2 * DAY_MS, 4 * DAY_MS - 1), (5 * DAY_MS + 7, None), (None, 11), (-5, -1)):
        wanted = filters.where_published(table, low, high)
        assert {r["doc_id"] for r in wanted.collect()} == {r["doc_id"] for r in filters.where_published(df, low, high).collect()}
        assert "day" in plan(wanted).split("PartitionFilters: [")[1].split("]")[0]
    two_days = filters.where_published(table, 2 * DAY_MS, 4 * DAY_MS - 1).select(F.input_file_name().alias("f")).distinct().collect()
    assert two_days and all("day=1970-01-03" in r["f"] or "day=1970-01-04" in r["f"] for r in two_days)
    assert filters.where_symbol(table, "s1").select("slot").distinct().count() == 1
    got = rollups.symbol_history(table, "S1", 50, DAY_MS, 8 * DAY_MS).collect()
    assert got and got == rollups.symbol_history(df, "S1", 50, DAY_MS, 8 * DAY_MS).collect()


@pytest.mark.parametrize("sort_by, order", [("risk", "desc"), ("date", "asc"), ("date", "desc"), ("sentiment", "asc"), ("relevance", "desc")])
def test_cursors_reach_the_pages_of_offsets(spark, sort_by, order):
    rng = random.Random(sort_by + order)
    some = lambda: rng.choice((None, 0.0, 0.5, rng.random()))
    made = [(f"d{i:03}", rng.choice((None, 5, i)), some(), some(), some(), rng.choice((1.0, 2.0, 4.5))) for i in range(60)]
    hits = spark.createDataFrame(made, "doc_id string, publishedAt bigint, sentiment double, risk_adj double, confidence double, score double").cache()
    spec, last = SearchSpec(sort_by=sort_by, sort_order=order, page_size=7), None
    for number in range(1, 10):
        rows = search.next_page(hits, spec, last).collect()
        assert rows == search.page(hits, spec.with_page(number)).collect()
        last = search.cursor(rows[-1], spec) if rows else last
    assert not search.next_page(hits, spec, last).collect()


def test_a_cursor_bounds_the_scan(spark, tmp_path):
    spec = SearchSpec(sort_by="risk")
    spark.createDataFrame([("a", 1, 0.5, 1.0)], "doc_id string, publishedAt bigint, risk_adj double, score double").write.parquet(str(tmp_path / "p"))
    rows = search.after(spark.read.parquet(str(tmp_path / "p")), spec, {"risk_adj": 0.4, "publishedAt": 3, "score": 1.0, "doc_id": "x"})
    assert "LessThan" in plan(rows).split("PushedFilters: [")[1].split("\n")[0]
