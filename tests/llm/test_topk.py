import math
import random

from tapewire.llm.topk_search import top_k

KIND = "vec_id bigint, embedding array<float>, score string, rank string"


def brute(rows, wanted, k):
    out = {}
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in whole:
        if wanted(i):
            asks[i] = min(asks.get(i, v), v)
    for q, v in asks.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def check(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "s", "r") for i, v in rows], KIND).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in top_k(df.where("vec_id % 20 = 0"), df, k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: [(n, i, s) for n, (i, s) in enumerate(found, 1)] for q, found in brute(rows, lambda i: i % 20 == 0, k).items() if found}
    assert {q: sorted(f) for q, f in got.items()} == want


def test_against_all_products(spark, monkeypatch):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(i, list(v)) for (i, _), (_, v) in zip(rows[:100], rows[:100])]  # repeated rows
    rows += [(700 + i, rows[3][1]) for i in range(50)]  # ties
    rows += [(1000, None), (1020, [1.0, None] * 4), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(1100, [1.0, 2.0]), (1101, [2.0, 1.0]), (1120, []), (1121, []), (1140, [1e30] * 8), (1160, [0.0] * 8)]
    check(spark, [r for r in rows if r[0] != 1140])


def test_several_shards_and_blocks(spark, monkeypatch):
    from tapewire.llm import topk_search

    monkeypatch.setattr(topk_search, "SHARD", 64)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "BLOCKS", 2)
    rng = random.Random(2)
    check(spark, [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(500)], k=7)


def test_few_candidates_and_numbers_beyond_doubles(spark):
    check(spark, [(0, [1.0]), (20, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])
    check(spark, [(0, [3e7, 1.0]), (1, [3e7, 1.0]), (2, [3e7, 2.0])])
