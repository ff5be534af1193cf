"""Keywords of a dictionary table against a plain search of every text."""

import random
import re

from tapewire.operators import keywords, word_filter
from tapewire.operators.word_filter import candidate_places


def texts_and_words(seed):
    rng = random.Random(seed)
    letters = "abcé日𝒳 "
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))).lower() for _ in range(60)} - {""})
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["", None, words[0], "ABC" * 50, words[3] * 30]
    return texts, words


def test_every_keyword_is_a_candidate_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(word_filter, "PIECE", 64)
    texts, words = texts_and_words(1)
    table = spark.createDataFrame([(w,) for w in words], "word string")
    found = word_filter.word_filter(table)
    for text in filter(None, texts):
        low = text.lower()
        want = {(i, len(w)) for w in words for i in range(len(low)) if low.startswith(w, i)}
        got = list(found.places(low))
        assert want <= set(got) and len(got) == len(set(got)) and len(got) <= len(want) + 2
    df = spark.createDataFrame(list(enumerate(t.lower() if t else t for t in texts)), "id int, low string").repartition(3)
    rows = candidate_places(df, found, "low", "id").collect()
    assert all((texts[r["id"]].lower())[r["pos"] :].startswith(r["word"]) for r in rows)


def test_table_hits_equal_patterns(spark):
    texts, words = texts_and_words(2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    table = [("AB"[i % 2], w.upper() if i % 3 else w) for i, w in enumerate(words)] + [("C", ""), ("A", words[0])]
    got = {(r["doc_id"], r["category"]): r["matches"] for r in keywords.table_hits(df, spark.createDataFrame(table, "category string, keyword string"), "text").collect()}
    want = {}
    for c in "AB":
        own = sorted({w.lower() for k, w in table if k == c}, key=lambda w: -len(w))
        pattern = re.compile("|".join(map(re.escape, own)))
        for i, t in enumerate(texts):
            if t and pattern.search(t.lower()):
                want[i, c] = pattern.findall(t.lower())
    assert got == want


def test_a_very_long_text_and_an_empty_dictionary(spark):
    df = spark.createDataFrame([(1, "ab " * 300_000)], "doc_id int, text string")
    none = spark.createDataFrame([], "category string, keyword string")
    assert keywords.table_hits(df, none, "text").collect() == []
    table = spark.createDataFrame([("A", "b ab a"), ("A", "zz")], "category string, keyword string")
    (row,) = keywords.table_hits(df, table, "text").collect()
    assert len(row["matches"]) == 149_999


def test_hits_move_once(spark):
    from tapewire.operators import keywords

    words = spark.createDataFrame([("A", "ab"), ("A", "abcd"), ("A", "cd"), ("B", "b")], "category string, keyword string")
    texts = spark.createDataFrame([(1, "abcd ab cd abc")], "doc_id int, text string")
    hits = keywords.table_hits(texts, words, "text")
    assert {r["category"]: r["matches"] for r in hits.collect()} == {"A": ["abcd", "ab", "cd", "ab"], "B": ["b"] * 3}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def brute_matches(text, words):
    kept, at = [], 0
    while at < len(text):
        here = max((w for w in words if text.startswith(w, at)), key=len, default="")
        kept += [here] if here else []
        at += len(here) or 1
    return kept


def test_words_are_found_where_texts_are_read(monkeypatch):
    """Several texts at once, in pieces that cut through words; spans that chain over many steps too."""
    import pyarrow as pa

    from tapewire.operators import word_lookup

    monkeypatch.setattr(word_lookup, "PIECE", 64)
    monkeypatch.setattr(word_lookup, "STEPS", 2)
    texts, words = texts_and_words(4)
    texts, words = [t.lower() for t in texts if t] + ["\0a\0", "a"], [*words, "\0", "aa", "a"]
    masks = [1 + 2 * (i % 3 == 0) for i in range(len(words))]
    rows = pa.table({"word": words, "mask": pa.array(masks, pa.int64()), "share": [0.2] * len(words)})
    table = word_lookup.word_table(rows, ["A", "B"], True)
    batch = pa.RecordBatch.from_pydict({"key": list(range(len(texts))), "text": texts})
    got = {(r["key"], r["category"]): r["matches"] for found in word_lookup.lists(table, batch) for r in found.to_pylist()}
    want = {(i, c): m for i, t in enumerate(texts) for c, bit in (("A", 1), ("B", 2)) if (m := brute_matches(t, [w for w, k in zip(words, masks) if k & bit]))}
    assert got == want
    for found in word_lookup.counts(table, batch):
        for r in found.to_pylist():
            m = want[r["key"], r["category"]]
            assert (r["occurrences"], r["unique_matches"], round(r["total"], 9)) == (len(m), len(set(m)), round(0.2 * len(set(m)), 9))


def test_parts_of_a_dictionary_and_shared_keys(spark, monkeypatch):
    """Categories in several parts, one of them too large for a task, and two texts of one key: the same hits;
    no hit moves where the text is alone with its key."""
    words = [("A", "ab"), ("A", "cd ef"), ("B", "ab"), ("B", "b"), ("C", "a long one, of which a task holds nothing"), ("C", "cd")]
    table = spark.createDataFrame(words, "category string, keyword string")
    df = spark.createDataFrame([(1, "ab cd ef ab"), (2, "cd ab"), (2, "x ab"), (None, "b"), (None, "ab"), (3, None)], "doc_id int, text string")

    def found():
        hits = {(r["doc_id"], r["category"]): r["matches"] for r in keywords.table_hits(df, table, "text").collect()}
        stats = {(r["doc_id"], r["category"]): tuple(r)[2:] for r in keywords.table_keyword_stats(df, table, "text").collect()}
        assert stats.keys() == hits.keys() and all(stats[k][1] == len(hits[k]) for k in hits)
        return hits, stats

    whole = found()
    assert whole[0][1, "A"] == ["ab", "cd ef", "ab"] and whole[0][1, "C"] == ["cd"] and whole[1][1, "A"][:3] == (2, 3, 2)
    assert len([k for k in whole[0] if k[0] == 2]) == 3
    monkeypatch.setattr(keywords, "LOOKUP_BYTES", 90)
    assert found() == whole
    monkeypatch.undo()
    moved, inner = [], keywords.candidate_places
    monkeypatch.setattr(keywords, "candidate_places", lambda df, *more: moved.append(df.count()) or inner(df, *more))
    keywords.table_keyword_stats(df.where("doc_id = 1"), table, "text").collect()
    assert sum(moved) == 0
