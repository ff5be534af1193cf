import hashlib
import random
import re
import zlib

import pytest

from tapewire.llm import prefix_trie as trie
from tapewire.llm.ordered import numbered, placed, running

KIND = "conv_id bigint, turn bigint, role string, text string, depth int, block int, t1 string, key string"


def table(spark, rows):
    """Extra columns are named like those the operator adds."""
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], KIND).repartition(3)


def brute(rows):
    """The contract by sets of members, walking every subtree."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        totals[p] = (sum(b[0] for b in below) or int(not below), sum(b[1] for b in below) + (len(members[p]) - 1) * words)
    out = []
    for p, mine in members.items():
        ends = ",".join(str(c) for c in sorted(mine) if len(built[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(mine), len(p), parent, len(mine), len(children.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in df.dtypes} == {"bigint", "string"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n=60, deepest=30):
    rng = random.Random(seed)
    texts = ["hello there", "hello  there", "a b\tc", "", None, "é ü x", "yes"]
    stems = [[(rng.choice(("user", "assistant", None)), rng.choice(texts)) for _ in range(deepest)] for _ in range(4)]
    rows = []
    for c in range(-25, n):
        turns = rng.choice(stems)[: rng.choice((0, 1, 2, 3, 8, 9, 16, 17, deepest))] + [("user", rng.choice(texts)) for _ in range(rng.choice((0, 0, 1, 2)))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_contract(spark, seed):
    rows = conversations(seed)
    extra = [(5, None, "first", "no turn"), (None, 0, "user", "nobody's"), (7, 0, "user", "same turn"), (7, 0, "user", "same turn"), rows[0], rows[0]]
    assert result(trie.prefix_trie(table(spark, rows + extra))) == brute(rows + extra)


def test_one_conversation_in_many_copies_and_one_of_many_turns(spark, monkeypatch):
    """Copies end in pieces of ids; the long one spans every sorted partition and many blocks."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(c, i, "user", f"turn {i}") for c in range(0, 4000, 20) for i in range(4)]
    rows += [(20_000, i, "user", "again and again") for i in range(300)] + [(20_001, 0, "user", "long " * 400_000)]
    assert result(trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_blocks_of_any_size_give_one_trie(spark, monkeypatch):
    rows = conversations(9, n=20, deepest=12)
    for size in (1, 3):
        monkeypatch.setattr(trie, "BLOCK", size)
        monkeypatch.setattr(trie, "_COLUMNS", [f"t{i}" for i in range(1, size + 1)])
        assert result(trie.prefix_trie(table(spark, rows))) == brute(rows)


def test_no_rows_and_no_turns_left(spark):
    assert result(trie.prefix_trie(table(spark, []))) == []
    assert result(trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []
    alone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    rows = [(alone, 0, "user", "taken away")]
    assert result(trie.prefix_trie(table(spark, rows))) == brute(rows)
    assert len(brute(rows)) == 1


def test_numbers_and_sums_inside_keys_that_span_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaab"), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    in_order = placed(df, ["k"], ["i"], "t")
    assert in_order.select("_part").distinct().count() > 2
    places, sums, want = {}, {}, []
    for k, i, v in rows:
        want.append((k, i, v, places.get(k, 0), sums.get(k, 0)))
        places[k], sums[k] = places.get(k, 0) + 1, sums.get(k, 0) + v
    n = {(r.k, r.i): r.n for r in numbered(in_order, ["k"], "n").collect()}
    s = {(r.k, r.i): r.s for r in running(in_order, ["k"], "v", "s").collect()}
    assert [(k, i, v, n[k, i], s[k, i]) for k, i, v in rows] == want
