import math
import random
from collections import Counter

import pytest

from tapewire.fixed_values import SIMILAR_BOOSTS
from tapewire.operators import search, similar

FIELDS = ("key_phrases", "title", "description")
KIND = "doc_id string, category string, publishedAt bigint, key_phrases string, title string, description string, rank int, gid string"


def articles(n, seed, hot=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]

    def some(k):
        return " ".join(rng.choice(words[: rng.choice((3, 10, 40))]) for _ in range(k))

    rows = []
    for i in range(n):
        phrases = rng.choice((some(1), some(3), some(2) + ", " + some(1), "the of", "", None))
        rows.append((f"d{i:03}", rng.choice(("A", "B", "C", None, "")), rng.choice((None, 5, i)), phrases, rng.choice((some(4), "the", None)), some(rng.randint(0, 12)) + " the", 1, "x"))
    return rows + [(f"h{i:03}", "A", 7, "w1, w2", "w1 the", "the w2", 1, "x") for i in range(hot)]


def brute(rows, n):
    """Every pair, with plain BM25 of each field."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    fields = {f: {r[0]: split(r[3 + i]) for r in rows if split(r[3 + i])} for i, f in enumerate(FIELDS)}
    counts = {f: {d: Counter(ts) for d, ts in docs.items()} for f, docs in fields.items()}
    df = {f: Counter(t for c in docs.values() for t in c) for f, docs in counts.items()}
    mean = {f: sum(map(len, docs.values())) / len(docs) for f, docs in fields.items()}

    def score(q, d):
        best = 0.0
        for f, boost in SIMILAR_BOOSTS.items():
            total = 0.0
            for t, times in Counter(split(q[3])).items():
                tf = counts[f].get(d[0], {}).get(t, 0)
                if tf:
                    idf = math.log(1 + (len(fields[f]) - df[f][t] + 0.5) / (df[f][t] + 0.5))
                    total += times * boost * idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len(fields[f][d[0]]) / mean[f]))
            best = max(best, total)
        return round(best, 6) + (1.0 if q[1] is not None and q[1] == d[1] else 0.0)

    out = {}
    for q in rows:
        found = [(score(q, d), d) for d in rows if d[0] != q[0]]
        found = sorted((x for x in found if x[0] > 0), key=lambda x: (-round(x[0], 6), -(x[1][2] if x[1][2] is not None else -1), x[1][0]))
        out[q[0]] = [(d[0], round(s, 5)) for s, d in found[:n]]
    return out


def result(spark, rows, n):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    index = search.build_index(df, FIELDS, ())
    found = {r[0]: [] for r in rows}
    for r in sorted(similar.similar_to_all(df, index, n).collect()):
        found[r["doc_id"]].append((r["similar_id"], round(r["score"], 5)))
    return found


@pytest.mark.parametrize("seed, n, hot", [(1, 3, 0), (2, 20, 0), (3, 5, 60)])
def test_equals_all_pairs(spark, seed, n, hot):
    rows = articles(90, seed, hot)
    assert result(spark, rows, n) == brute(rows, n)


def test_one_at_a_time_finds_the_same(spark):
    rows = articles(60, 5)
    df = spark.createDataFrame(rows, KIND)
    index = search.build_index(df, FIELDS, ())
    every = result(spark, rows, 4)
    for doc_id in ("d001", "d017", "d044"):
        one = search.similar_articles(df, index, doc_id, 4).collect()
        assert [r["doc_id"] for r in one] == [d for d, _ in every[doc_id]]


def test_no_articles(spark):
    df = spark.createDataFrame([], KIND)
    assert similar.similar_to_all(df, search.build_index(df, FIELDS, ()), 5).collect() == []


def test_only_blocks_that_can_matter_are_read(spark, monkeypatch):
    """A common word beside a rare one names next to nothing, and nothing is joined without a key."""
    named = {}
    inner = similar._named

    def watched(asked, groups, impacts, top, floors):
        found = inner(asked, groups, impacts, top, floors)
        named["kept"], named["all"] = found.count(), asked.join(impacts, "term").select("gid", "doc_id").distinct().count()
        named["plan"] = found._jdf.queryExecution().executedPlan().toString()
        return found

    monkeypatch.setattr(similar, "_named", watched)
    # Every ninth article has a word of its own, which eight others have in their titles.
    rows = [(f"d{i:04}", None, i, f"the r{i // 9}", f"r{i // 9} the x{i % 7}", "the and the " * (i % 5), 1, "x") for i in range(900)]
    assert len(result(spark, rows, 5)) == 900
    assert named["all"] >= 100 * 900 > 5 * named["kept"]
    assert "NestedLoop" not in named["plan"] and "Cartesian" not in named["plan"]


def test_what_leaves_a_shard_does_not_grow_with_the_pairs(spark, monkeypatch):
    """All articles share a word, each has one of its own: no more than the best few of each question are moved."""
    named, inner = [], similar._named
    monkeypatch.setattr(similar, "_named", lambda *args: (named.append(inner(*args)), named[-1])[1])
    rows = [(f"d{i:04}", "AB"[i % 2], i % 50, f"the u{i}", f"the u{i}", "the", 1, "x") for i in range(300)]
    assert result(spark, rows, 5) == brute(rows, 5)
    assert named[0].count() <= 300 * 6


def test_shards_and_questions_of_many_words(spark, monkeypatch):
    """Several shards, words that come twice, and questions of more words than are answered by parts."""
    monkeypatch.setattr(similar, "SHARD_POSTINGS", 300)
    rows = articles(90, 7)
    rows += [(f"l{i}", "B", i, f"w1 w2 w3 w4 w5 w{i}, w1 w7", f"w2 w{i} w3", "w4 w1 the", 1, "x") for i in range(12)]
    assert result(spark, rows, 4) == brute(rows, 4)


def test_rows_of_one_id_are_one_article(spark):
    rows = articles(40, 9)
    twice = [*rows, (*rows[3][:1], "C", *rows[3][2:]), rows[5]]
    df = spark.createDataFrame(twice, KIND)
    index = search.build_index(df, FIELDS, ())
    every = {}
    for r in similar.similar_to_all(df, index, 4).collect():
        every.setdefault(r["doc_id"], set()).add((r["similar_id"], round(r["score"], 5)))
    for doc_id in sorted(every.keys() - {"d003", "d005"})[:4]:
        best = {}
        for r in search.similar_articles(df, index, doc_id, 20).collect():
            best[r["doc_id"]] = max(best.get(r["doc_id"], 0.0), round(r["score"], 5))
        assert all(best[d] == s for d, s in every[doc_id]) and len(every[doc_id]) == 4
