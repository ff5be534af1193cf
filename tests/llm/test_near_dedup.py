import math
import random
import re

import numpy as np
import pytest

from tapewire.llm import components as components_
from tapewire.llm import near_dedup
from tapewire.llm.components import components
from tapewire.llm.near_dedup import BANDS, ROWS, SLACK, near_groups, shingles, signature

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


class Union(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def brute(rows, width, percent=80):
    union, held = Union(), [(i, sets_of(t, width)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(held):
        union.top(i)
        for j, b in held[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                union.join(i, j)
    return union


@pytest.mark.parametrize("width", [2, 5])
def test_groups_against_all_pairs(spark, docs, width):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    union = brute(rows, width)
    got = near_groups(docs, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == union.top(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    sizes = {i: len(sets_of(t, width)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_chains_and_one_large_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):  # every one differs from all others, most pairs stand near the limit
        changed = list(words)
        for _ in range(rng.randint(1, 5)):
            changed[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(changed))
    chain = list(words)
    for i in range(30):
        chain[i] = f"c{i}"
        texts.append(" ".join(chain))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    union = brute(list(zip(ids, texts)), 1)
    assert {r.doc_id: r.component_id for r in near_groups(df, width=1).collect()} == {i: union.top(i) for i in ids}


def test_repeated_ids_and_empty_tables(spark, nothing):
    text = " ".join(map(str, range(20)))
    rows = [(1, text), (2, text + " x"), (2, "quite another one"), (3, ""), (4, "  "), (5, None)]
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 6 and len({r.component_id for r in got if r.doc_id == 2}) == 1
    assert sorted((r.component_id, r.n_shingles, r.kept) for r in got if r.doc_id > 2) == [(3, 0, True), (4, 0, True), (5, 0, True)]
    assert near_groups(nothing).collect() == []


def test_signature_estimates_similarity():
    a = shingles(" ".join(map(str, range(1000))), 2)
    b = shingles(" ".join(map(str, range(100, 1100))), 2)
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a, 2000) == signature(b, 2000)).mean() - want) < 0.05


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)]
    union = Union()
    for a, b in edges:
        union.join(a, b)
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r.node: r.component for r in got} == {n: union.top(n) for e in edges if e[0] != e[1] for n in e}
    assert len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_signatures_lose_less_than_one_link_in_a_million():
    n = BANDS * ROWS
    lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(n + 1) if k / n < 0.8 - SLACK)
    assert lost < 1e-6, lost


def test_an_id_with_two_texts_joins_what_both_are_linked_to(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (2, a + " word"), (2, b), (3, b + " word"), (4, "something else entirely"), (2, "and a third text"), (2, None)]
    got = near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 29, 1), (2, 0, 2), (2, 3, 1), (2, 29, 1), (2, 30, 1), (3, 30, 1), (4, 2, 4)]
    # Every class has the same smallest id.
    same = near_groups(spark.createDataFrame([(7, a), (7, b), (9, a + " x"), (8, b + " x")], "doc_id bigint, text string"), width=2).collect()
    assert {r.component_id for r in same} == {7}


def test_buckets_of_unlinked_members_give_out_no_pairs(spark, monkeypatch):
    """Many texts that share bands but no link, and two links among them, compared in blocks."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)  # all is left to the blocks
    monkeypatch.setattr(near_dedup, "BLOCK_CLASSES", 16)
    rng = random.Random(9)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join(common + [f"x{rng.randrange(10**9)}" for _ in range(40)]) for _ in range(80)]
    texts += [texts[3] + " more", texts[70] + " more words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sent = []
    met = near_dedup._met
    monkeypatch.setattr(near_dedup, "_met", lambda homes, *rest: sent.append(homes.select("cls").distinct().count()) or met(homes, *rest))
    got = {r.doc_id: r.component_id for r in near_groups(df, width=1).collect()}
    assert got == {i: {80: 3, 81: 70}.get(i, i) for i in range(82)}
    assert sent and max(sent) < 40


def test_small_tables_are_not_written_to_a_file_a_partition(spark, monkeypatch):
    """Each file costs the executor that writes it a process of its own on a local disk."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    texts += [" ".join([*t.split()[:-1], f"y{i}{k}"]) for i, t in enumerate(texts) for k in range(4)]
    rows = list(enumerate(texts))
    made = []
    for module in (near_dedup, components_):
        monkeypatch.setattr(module, "saved", lambda df, name, *rows, f=module.saved: made.append((name, f(df, name, *rows))) or made[-1][1])
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=1).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    union = brute(rows, 1)
    assert got == {i: union.top(i) for i in range(len(texts))} and len(set(got.values())) == 60
    files = {name: len(df.inputFiles()) for name, df in made if name != "signatures"}
    assert files["links"] and max(files.values()) <= 2 * spark.sparkContext.defaultParallelism, files
    # Links that are stars already take no further step.
    made.clear()
    assert len(components(spark.createDataFrame([(1, 5), (6, 1), (2, 3)], "u bigint, v bigint")).collect()) == 5
    assert len(made) == 1
