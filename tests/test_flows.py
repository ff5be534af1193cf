import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.test_scoring import articles

from tapewire.operators import keywords
from tapewire.operators.dedup import archived_ids
from tapewire.operators.model_hooks import score_with
from tapewire.plans.scoring import score_articles
from tapewire.schemas import PAYLOAD, SCORED
from tapewire.sources import (
    append_archive,
    checkpoint_id,
    compact,
    decode_articles,
    ensure_table,
    export_keywords,
    malformed,
    publish,
    read_archive,
    read_category_commands,
    read_category_json,
    read_keywords,
    read_raw_articles,
    read_upserted,
    run_number,
    stream_articles,
    to_messages,
    upsert,
    work_dir,
)
from tapewire.streaming import jobs


def payloads(spark, ids, **fields):
    rows = [tuple({"doc_id": i, "title": f"é {i}", **fields}.get(f.name) for f in PAYLOAD.fields) for i in ids]
    return spark.createDataFrame(rows, PAYLOAD)


def test_archive(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert read_archive(spark, path).count() == 0
    append_archive(payloads(spark, ["1", "2"], sentiment=0.5, symbols=["S"]), path)
    append_archive(payloads(spark, ["3"]), path)
    with open(os.path.join(path, "part-hand.json"), "w") as f:
        f.write('{"doc_id": "4", "sentiment": 0}\nnot json\n{"title": "no id"}\n{"doc_id": "5", "title": \n')
    rows = {r["doc_id"]: r for r in read_archive(spark, path).collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert {r["doc_id"] for r in archived_ids(read_archive(spark, path)).collect()} == set(rows)
    assert rows["1"]["title"] == "é 1" and rows["1"]["symbols"] == ["S"] and rows["4"]["sentiment"] == 0.0
    assert any("é" in line for name in os.listdir(path) if name.endswith(".json") for line in open(os.path.join(path, name), encoding="utf-8"))


def test_raw_responses(spark, tmp_path):
    path = tmp_path / "raw"
    path.mkdir()
    (path / "1.json").write_text(json.dumps({"meta": {}, "data": [{"title": "a", "entities": [{"symbol": "S", "match_score": 3}]}, {"title": "b"}]}, indent=1))
    (path / "2.json").write_text('{"error": "limit"}')
    (path / "3.json").write_text("<html>busy</html>")
    rows = read_raw_articles(spark, str(path)).orderBy("title").collect()
    assert [r["title"] for r in rows] == ["a", "b"]
    assert rows[0]["entities"][0]["match_score"] == 3.0 and rows[1]["entities"] is None


def test_malformed_messages(spark):
    df = spark.createDataFrame([('{"title": "a", "symbols": ["S"], "sentiment": 1}',), ("no json",), ('{"title": "cut',)], "value string")
    rows = decode_articles(df).collect()
    assert len(rows) == 3 and [r["symbol"] for r in rows if r["title"]] == ["S"]
    assert sum(all(v is None for v in r) for r in rows) == 2
    assert decode_articles(df, on_malformed="quarantine").count() == 1
    assert malformed(df).count() == 2
    with pytest.raises(ValueError):
        decode_articles(df, on_malformed="ignore")


def test_dictionaries(spark, tmp_path):
    commands = tmp_path / "commands"
    commands.write_text('SADD category_keywords_A eps "net income" m&a "net income"\nSADD category_keywords_B spin-off\n\nPING\n')
    table = read_category_commands(spark, str(commands))
    assert {tuple(r) for r in table.collect()} == {("A", "eps"), ("A", "net income"), ("A", "m&a"), ("B", "spin-off")}
    path = str(tmp_path / "export")
    counts = dict(export_keywords(table, path).collect())
    assert counts == {"A": 3, "B": 1, None: 4}
    assert {tuple(r) for r in read_category_json(spark, path).collect()} == {tuple(r) for r in table.collect()}
    lines = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part")).splitlines()
    assert [json.loads(x) for x in lines] == [{"A": ["eps", "m&a", "net income"]}, {"B": ["spin-off"]}]
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps({"category_keywords_A": ["eps", "net income"]}, indent=1))
    assert {tuple(r) for r in read_category_json(spark, str(whole), one_per_line=False).collect()} == {("A", "eps"), ("A", "net income")}
    words = tmp_path / "words"
    words.write_text("# header\n Crash \n\nTail-Risk\ncrash\n")
    assert read_keywords(spark, str(words)) == ["crash", "tail-risk"]
    assert read_keywords(spark, str(tmp_path / "missing")) == ["risk", "loss", "default", "bankruptcy", "crash"]
    assert keywords.to_dictionary(table)["B"] == ["spin-off"]


def scored(spark, ids, score=0.0):
    rows = [dict(title=str(i), content="x", sentiment=score, confidence=50.0, publishedAt="2024-01-01 00:00:00") for i in ids]
    return score_articles(articles(spark, rows))


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    assert read_upserted(spark, path).count() == 0
    first = scored(spark, range(6))
    order = ("sentiment",)
    upsert(first.unionByName(first), path, 0, order)
    for _ in range(2):
        upsert(scored(spark, [4, 5, 6], 0.5).unionByName(scored(spark, [4], 0.1)), path, 1, order)
        rows = {r["title"]: r["sentiment"] for r in read_upserted(spark, path).collect()}
        assert rows == {**{str(i): 0.0 for i in range(4)}, **{str(i): 0.5 for i in (4, 5, 6)}}
    upsert(scored(spark, [6, 7], 0.9), path, 2, order)
    compact(spark, path, path + "2")
    one, two = read_upserted(spark, path), read_upserted(spark, path + "2")
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 8
    upsert(scored(spark, [0], -0.5), path + "2", 0, order)  # a batch number lower than the old ones
    assert {r["title"]: r["sentiment"] for r in read_upserted(spark, path + "2").collect()}["0"] == -0.5


def test_ensure_table(spark):
    assert ensure_table(spark, "articles_t") == "created"
    assert ensure_table(spark, "articles_t") == "exists"
    assert ensure_table(spark, "no_such_schema.t") == "failed"
    assert spark.table("articles_t").columns == SCORED.names


def test_work_dir_follows_the_session(spark):
    a, b = work_dir(spark, "x"), work_dir(spark, "x")
    assert a != b and a.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "local-cluster[2,1,1024]"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        work_dir(Session(), "x")


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    topic, table, state = (str(tmp_path / n) for n in ("topic", "table", "state"))
    rows = [dict(title=str(i), content="crash" if i % 3 else "", sentiment=(i - 20) / 20, confidence=float(i)) for i in range(40)]
    df = articles(spark, rows)
    messages = to_messages(df.drop("symbol", "entity_name"))
    publish(df.drop("symbol", "entity_name").where("sentiment < 0"), "files", topic)

    def run():
        stream = decode_articles(stream_articles(spark, "files", topic, maxFilesPerTrigger="1"))
        jobs.start_scoring(stream, table, state).awaitTermination()

    run()
    publish(df.drop("symbol", "entity_name").where("sentiment >= 0"), "files", topic)
    run()
    run()
    want = sorted(score_articles(decode_articles(messages)).collect())
    assert sorted(read_upserted(spark, table).collect()) == want


@pytest.mark.parametrize("with_ids", [False, True])
def test_ingest_skips_what_is_archived(spark, tmp_path, with_ids):
    archive, inbox, state, ids = (str(tmp_path / n) for n in ("archive", "inbox", "state", "ids"))
    append_archive(payloads(spark, ["old"]), archive)
    if with_ids:
        jobs.seed_ids(read_archive(spark, archive), ids)

    def poll():
        stream = spark.readStream.schema(PAYLOAD).json(inbox)
        jobs.start_ingest(stream, archive, state, "title", every=None, ids_path=ids if with_ids else None).awaitTermination()

    append_archive(payloads(spark, ["old", "a", "a", "b"]), inbox)
    poll()
    append_archive(payloads(spark, ["b", "c"]), inbox)
    poll()
    assert sorted(r["doc_id"] for r in read_archive(spark, archive).collect()) == ["a", "b", "c", "old"]


def test_a_new_checkpoint_keeps_what_is_there(spark, tmp_path):
    topic, table = str(tmp_path / "topic"), str(tmp_path / "table")
    for k in range(3):
        rows = [dict(title=str(i), content="x", sentiment=0.1 * k, publishedAt="2024-01-01 00:00:00") for i in range(10 * k, 10 * k + 15)]
        publish(articles(spark, rows).drop("symbol", "entity_name"), "files", f"{topic}{k}")
        for _ in range(2):
            stream = decode_articles(stream_articles(spark, "files", f"{topic}{k}"))
            jobs.start_scoring(stream, table, str(tmp_path / f"state{k}")).awaitTermination()
    current = {r["title"]: round(r["sentiment"], 1) for r in read_upserted(spark, table).collect()}
    assert current == {str(i): 0.1 * min(2, i // 10) for i in range(35)}
    numbers = {run_number(spark, table, checkpoint_id(spark, str(tmp_path / f"state{k}"))) for k in range(3)}
    assert numbers == {1, 2, 3} and run_number(spark, table, "another") == 4


def test_two_runs_with_one_number_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    run_number(spark, path, "a")
    spark.createDataFrame([("b", 1)], "run_id string, run bigint").write.mode("append").parquet(f"{path}/_runs")
    with pytest.raises(RuntimeError):
        run_number(spark, path, "a")


def test_an_empty_batch_writes_nothing(spark, tmp_path):
    write = jobs.upsert_batch(str(tmp_path / "t"), str(tmp_path / "state"))
    write(scored(spark, []), 0)
    assert not os.path.exists(tmp_path / "t")


def test_failing_batch_is_not_swallowed(spark, tmp_path):
    topic = str(tmp_path / "topic")
    publish(articles(spark, [dict(title="a")]).drop("symbol", "entity_name"), "files", topic)
    (tmp_path / "file").write_text("in the way")
    stream = decode_articles(stream_articles(spark, "files", topic))
    with pytest.raises(Exception):
        jobs.start_scoring(stream, str(tmp_path / "file" / "table"), str(tmp_path / "state")).awaitTermination()


def test_unknown_places_are_refused(spark):
    with pytest.raises(ValueError):
        stream_articles(spark, "carrier pigeon", "x")
    with pytest.raises(ValueError):
        publish(spark.range(1), "carrier pigeon", "x")


def test_model_is_loaded_once_per_task(spark):
    def factory():
        loaded = []

        def score(batch: pd.DataFrame) -> pd.DataFrame:
            loaded.append(1)
            return batch.assign(n=len(loaded))[["id", "n"]]

        return score

    df = spark.range(0, 30, 1, 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = score_with(df, factory, "id long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 30 and max(r["n"] for r in rows) == 3
    assert F is not None


def test_a_table_is_followed_as_one_file_or_a_folder(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(i, f"text {i % 7} of {i % 7}", "en", "src0", 9) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    df.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    df.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name, n in (("folder", 7), ("file", 7), ("none", 0)):
        assert entry.queries()["stream_dedup"](spark, str(tmp_path / name)).count() == n
