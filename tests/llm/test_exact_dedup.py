import hashlib
import re

from tapewire.llm.exact_dedup import DigestIndex, deduplicate, fingerprints, keep_first
from tapewire.sources.sinks import work_dir
from tests.llm.conftest import table


def plain(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def index(spark):
    return DigestIndex(spark, work_dir(spark, "index"), buckets=3)


def test_every_row_against_a_dictionary(spark, docs):
    rows = docs.collect()
    groups = {}
    for r in rows:
        if r.doc_id is not None:
            groups.setdefault(plain(r.text), []).append(r.doc_id)
    got = deduplicate(docs, index(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.keep_id, r.group_size, r.kept) == (None, None, True)
        else:
            ids = groups[r.text_sha256]
            assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))


def test_index_remembers_earlier_batches_and_offers_may_be_repeated(spark):
    seen = index(spark)
    first = table(spark, ["one", "two", "two"], [10, 11, 12])
    deduplicate(first, seen)
    size = seen.rows().count()
    again = {r.doc_id: r.keep_id for r in deduplicate(first, seen).collect()}
    assert seen.rows().count() == size == 2 and again[12] == 11
    later = {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(table(spark, ["two", "three"], [1, 2]), seen).collect()}
    assert later[1] == (11, False) and later[2] == (2, True)
    reopened = DigestIndex(spark, seen.path, buckets=3)
    assert sorted(r.keep_id for r in reopened.rows().collect()) == [2, 10, 11]
    assert reopened.compact(work_dir(spark, "index")).rows().count() == 3


def test_index_is_joined_without_moving_it(spark):
    seen = index(spark)
    deduplicate(table(spark, ["one", "two"]), seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = fingerprints(table(spark, ["one"])).repartition(3, "digest")
        plan = batch.join(seen.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(digest") == 1


def test_kept_rows_are_whole(spark, docs, nothing):
    got = keep_first(docs, index(spark))
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids))
    want = {}
    for r in docs.collect():
        if r.doc_id is not None:
            want[plain(r.text)] = min(want.get(plain(r.text), r.doc_id), r.doc_id)
    assert {i for i in ids if i is not None} == set(want.values()) and None in ids
    assert keep_first(nothing, index(spark)).collect() == []
    assert deduplicate(nothing, index(spark)).collect() == []


def test_texts_of_one_id_are_decided_one_by_one(spark):
    texts, ids = ["copy", "first", "second", "copy", "third", "third"], [1, 7, 7, 8, 8, 8]
    got = sorted((r.doc_id, r.text) for r in keep_first(table(spark, texts, ids), index(spark)).collect() if r.doc_id is not None)
    assert got == [(1, "copy"), (7, "first"), (7, "second"), (8, "third")]
