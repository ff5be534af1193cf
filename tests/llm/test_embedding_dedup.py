import math

import numpy as np
import pytest

from tapewire.llm import cap_filters, embedding_dedup
from tapewire.llm.embedding_dedup import near_vectors

KIND = "vec_id bigint, embedding array<{}>, label int, key string, `size` int, v string, component_id int"


def table(spark, rows, kind="float"):
    """Extra columns are named like those the operator adds."""
    return spark.createDataFrame([(i, v, 1, "k", 2, "v", 3) for i, v in rows], KIND.format(kind)).repartition(3)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine, kind=np.float32):
    """All pairs; rows with one id are one node."""
    at = [i for i, (n, v) in enumerate(rows) if n is not None and usable(v)]
    vectors = {i: np.asarray(rows[i][1], kind).astype(float) for i in at}
    units = {i: v / np.abs(v).max() for i, v in vectors.items()}
    units = {i: v / np.sqrt(v @ v) for i, v in units.items()}
    links = {i: [j for j in at if j != i and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in at}
    up = {n: n for n, _ in rows if n is not None}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, others in links.items():
        for j in others:
            a, b = sorted((top(rows[i][0]), top(rows[j][0])))
            up[b] = a
    out = []
    for i, (n, _) in enumerate(rows):
        c = None if n is None else top(n)
        out.append((n, len(links.get(i, ())), c, n is not None and n == c))
    return sorted(out, key=str)


def result(df):
    assert df.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted((tuple(r) for r in df.collect()), key=str)


def groups(rng, n, width=64, spread=0.02):
    """Unrelated vectors, each with some near copies."""
    out = []
    for _ in range(n):
        v = rng.standard_normal(width) * 10.0 ** rng.integers(-3, 3)
        for _ in range(rng.choice((1, 1, 2, 5))):
            out.append((v + rng.standard_normal(width) * spread * np.linalg.norm(v)).tolist())
    return out


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = groups(rng, 120)
    vectors += [vectors[0], vectors[0], vectors[5], [x * 2 for x in vectors[7]], [-x for x in vectors[9]]]
    odd = [None, [], [0.0] * 64, [1.0, None] * 32, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [1.0], [3.0], [-3.0]]
    rows = list(enumerate(vectors + odd)) + [(3, vectors[3]), (None, vectors[3]), (None, None), (11, vectors[40]), (12, None), (2000, odd[0]), (4, [1.0, 2.0])]
    assert result(near_vectors(table(spark, rows))) == brute(rows, 0.9)


def test_blocks_and_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    v = rng.standard_normal(32)
    rows = list(enumerate([(v + 0.05 * rng.standard_normal(32)).tolist() for _ in range(150)] + groups(rng, 40, 32) + [v.tolist()] * 60))
    rng.shuffle(rows)
    assert result(near_vectors(table(spark, rows))) == brute(rows, 0.9)


def test_numbers_at_the_ends_of_their_range(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [5e-324, 5e-324]), (4, [1.7e308, 1.7e308]), (5, [-1e200, 1e200]), (6, [0.0, -0.0])]
    got = {r[0]: r[1:] for r in result(near_vectors(table(spark, rows, "double")))}
    assert all(got[i] == (3, 1, i == 1) for i in (1, 2, 3, 4))
    assert got[5] == (0, 5, True) and got[6] == (0, 6, True)


def test_no_rows(spark):
    assert result(near_vectors(table(spark, []))) == []
    assert result(near_vectors(table(spark, [(1, None)]))) == [(1, 0, 1, True)]


def pairs_at(cosine, n, width, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * y


@pytest.mark.parametrize("vectors", [300, 50_000, 3_000_000])
def test_pairs_at_the_threshold_share_a_filter(vectors):
    """Recall of the filters alone, for plans of three sizes of tables."""
    plan = cap_filters.Plan.of(vectors, 64, 0.9)
    sides = [cap_filters.filters(plan, v) for v in pairs_at(0.9, 500, 64, 3)]
    left, right = [{(r, f) for r, f in zip(*side)} for side in sides]
    found = {r for r, _ in left & right}
    assert len(found) >= 0.99 * 500
    assert len(left) / 500 < 150


def test_links_below_the_threshold_are_never_reported(spark):
    pairs = [(a, b) for c in (0.89, 0.8999, 0.9001, 0.91) for a, b in zip(*pairs_at(c, 30, 64, int(c * 1e4)))]
    rows = [(2 * i + k, v.tolist()) for i, pair in enumerate(pairs) for k, v in enumerate(pair)]
    got = {r[0]: r[1] for r in result(near_vectors(table(spark, rows, "double")))}
    want = {r[0]: r[1] for r in brute(rows, 0.9, float)}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_list_decoding_finds_every_filter_over_the_bar():
    plan = cap_filters.Plan(12, 3, 4, 0.3)
    code = cap_filters.codes(plan)[1]
    units = np.random.default_rng(0).standard_normal((40, 12))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    names = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    directions = np.array([np.concatenate([code.words[i][w] for i, w in enumerate(n)]) for n in names])
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    values = units @ code.turn @ directions.T
    got = {}
    for r, f in zip(*code.filters(units)):
        got.setdefault(int(r), []).append(int(f) - code.first)
    for r in range(40):
        bar = 0.3
        while (values[r] >= bar - 1e-12).sum() < cap_filters.LEAST:
            bar -= cap_filters.STEP
        assert got[r] == np.flatnonzero(values[r] >= bar - 1e-12).tolist()
