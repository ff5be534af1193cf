import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewire.llm import suffix_dedup
from tapewire.llm.suffix_dedup import remove_repeats
from tapewire.llm.suffix_merge import common, decode, front_code, merge
from tests.llm.conftest import table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=20), max_size=9))
def test_merge_is_a_sort_that_knows_its_prefixes(lists):
    runs = [sorted(set(x)) for x in lists]
    got = list(merge([decode(*front_code(r)) for r in runs]))
    assert [s for _, s, _ in got] == sorted(s for r in runs for s in r)
    last = b""
    for share, string, run in got:
        assert share == common(last, string) and string in runs[run]
        last = string


def brute(rows, length):
    """Per row: what is removed; rows in ascending id, those of one id together."""
    seen, out = set(), []
    for doc_id in sorted({i for i, _ in rows if i is not None}):
        new = []
        for text in (t for i, t in rows if i == doc_id):
            data = (text or "").encode()
            covered = bytearray(len(data))
            for i in range(len(data) - length + 1):
                if data[i : i + length] in seen:
                    covered[i : i + length] = b"\1" * length
                new.append(data[i : i + length])
            runs = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
            rest = bytes(b for b, c in zip(data, covered) if not c)
            out.append((doc_id, len(data), sum(covered), runs, hashlib.sha256(rest).hexdigest()))
        seen.update(new)
    return sorted(out)


@pytest.mark.parametrize("length,seed,block", [(50, 16, 4000), (50, 24, 1 << 20), (20, 8, 3000), (120, 32, 2000)])
def test_against_every_string(spark, texts, monkeypatch, length, seed, block):
    shorter = [t[:30_000] if t else t for t in texts]
    docs = table(spark, shorter, [(i * 37) % 1009 for i in range(len(shorter))])
    got = remove_repeats(docs, length=length, seed=seed, block_bytes=block, part_anchors=500).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r)[:5] for r in got if r.doc_id is not None) == brute(rows, length)
    null = [r for r in got if r.doc_id is None]
    assert len(null) == 1 and null[0].n_removed == 0


def test_runs_of_one_letter_and_kept_text(spark):
    texts = ["a" * 500 + "b", "a" * 300, "x" + "ab" * 100, "ab" * 200 + "é" * 60, "y" + "é" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = remove_repeats(df, length=50, seed=16, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == brute(list(enumerate(texts)), 50)
    assert {r.doc_id: r.kept_text for r in got}[4] == "y"


def test_a_very_long_text_and_nothing(spark, texts, nothing):
    long = max((t for t in texts if t), key=len)
    df = spark.createDataFrame([(1, long), (2, "start " + long[:200] + " end")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= 200
    assert remove_repeats(nothing).collect() == []
    assert suffix_dedup.BLOCK_BYTES > 0
