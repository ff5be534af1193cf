import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewire.llm import packing
from tapewire.llm.packing import nnls, pack, plan, word_ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 511), max_size=300))
def test_plan_places_every_token_once(lengths):
    seen, sequences = {}, {}
    for doc, start, n, sequence, offset in plan(np.asarray(lengths, np.int64), 512):
        seen.setdefault(doc, []).append((start, n))
        sequences.setdefault(sequence, []).append((offset, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen[doc]):
            assert start == at and size > 0
            at += size
        assert at == n
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 512


def test_little_padding():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 5000).astype(int) + 1, 4095)
    pieces = plan(lengths, 4096)
    sequences = len({s for _, _, _, s, _ in pieces})
    assert lengths.sum() / sequences / 4096 > 0.99
    assert len(pieces) < 1.2 * len(lengths)


def test_least_squares_against_projected_steps():
    rng = np.random.default_rng(2)
    a, b = rng.random((12, 30)), rng.random(12) * 10
    x = nnls(a, b)
    y = np.zeros(30)
    for _ in range(200_000):
        y = np.maximum(0, y - 0.002 * (a.T @ (a @ y - b)))
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-3


@pytest.mark.parametrize("text", [
    "Plain words, isn't it?", "ÉTÉ naïve  \x1c a\x1fb c d", "a<|endoftext|>b 'S 'll 12 3.5%", "日本 é é ́x ﬁ", "", "  \n",
    "ΣΑΣ ΟΔΟΣ İ", "tab\tnew\r\nline\x85end", "<|startoftext|> x", "foo\x00bar \x07",
])
def test_word_ids_are_the_library_s(vocabulary, text):
    path = vocabulary("word_bpe_49k.json")
    words = word_ids(path)
    assert words.encode(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_of_documents(spark, docs, nothing, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    rows = pack(docs, path, end_id=2, window=256, with_ids=True).collect()
    tokenizer = word_ids(path).tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    copies = {0: 2}  # a repeated row
    for d in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        n = copies.get(d.doc_id, 1)
        assert sum(r.length for r in by_doc[d.doc_id]) == n * len(ids)
        assert all(r.doc_tokens == len(ids) and r.ids == ids[r.start : r.start + r.length] for r in by_doc[d.doc_id])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert pack(nothing, path, end_id=2).collect() == []


def test_latin_letters_go_to_the_merges_run_by_run(vocabulary, monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    words = packing.WordIds(path)
    text = "Été, l'ÉTÉ naïve: don't STRASSE straße 12 øx ÿ'S \t a-'ll"
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(words, "tokenizer", None)
    monkeypatch.setattr(packing, "WORDS", 3)  # whatever is remembered
    assert words.encode(text).tolist() == want and words.encode(text).tolist() == want
