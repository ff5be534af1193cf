import random
import re
from collections import Counter

import numpy as np
import pytest

from tapewire.llm import source_divergence
from tapewire.llm.source_divergence import TERM, _words, audit
from tapewire.llm.transducer import Transducer

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, least, top):
    """The contract, word by word, over (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [((a or ""), (b or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        stands = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in stands.items() if n >= least)
        groups = {s: Counter(w for d in own if d[1] == s for w in d[2] if stands[w] >= least) for s in {d[1] for d in own}}
        whole = sum(groups.values(), Counter())

        def share(counts, w):
            return 1 + 1_000_000_000 * (counts[w] + 5) // (sum(counts.values()) + 5 * len(kept))

        for s, counts in groups.items():
            pairs = [(sum(abs(share(counts, w) - share(other, w)) for w in kept), t) for t, other in groups.items() if t != s]
            terms = [(share(counts, w) - share(whole, w), w) for w in kept if counts[w]]
            for part, found, most in (("pair", pairs, None), ("term", [x for x in terms if x[0] > 0], top)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    """Extra columns are named like those the operator adds."""
    kind = "lang string, source string, text string, item string, n int, no bigint, `rank` int"
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], kind).repartition(3)


def result(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def corpus(n=150, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wal", "wal", "ré", "Ø", "日本", "x", "zz", "the") for b in ("", "d", "ds", "é", "q" * 12)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice((" ", "-", "\n", "1", "")) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(("en", "en", "fr", "", None)), rng.choice(("a", "a", "b", "c", "é", "", None)), rng.choice((text, text, None, ""))))
    return rows + rows[:7] + [("xx", "only", None), ("yy", "p", "one"), ("yy", "q", "two")]


def test_equals_the_contract(spark):
    rows = corpus()
    assert result(audit(table(spark, rows), least=4, top=5)) == brute(rows, 4, 5)


def test_small_blocks_parts_and_waves(spark, monkeypatch):
    """Many transducers and passes, many blocks of ordinals and sources: the same result."""
    rows = corpus(seed=4)
    for name, value in (("PART_TERMS", 3), ("WAVE_BYTES", 40_000), ("HELD", 5), ("WINDOW", 11), ("ORDINALS", 2), ("SOURCES", 2)):
        monkeypatch.setattr(source_divergence, name, value)
    machines = source_divergence._machines
    monkeypatch.setattr(source_divergence, "_machines", lambda df: machines(df.coalesce(1)))
    assert result(audit(table(spark, rows), least=3, top=4)) == brute(rows, 3, 4)


def test_many_sources_and_very_long_texts(spark):
    rng = random.Random(1)
    rows = [("en", f"s{rng.randrange(90)}", " ".join(rng.choice("abcdefgh") for _ in range(20))) for _ in range(300)]
    rows += [("en", "long", "a bb " * 300_000), ("en", "run", "z" * 1_500_000), ("en", "run", "Z" * 1_500_000)]
    assert result(audit(table(spark, rows), least=2, top=50)) == brute(rows, 2, 50)


def test_no_rows_and_no_terms(spark):
    assert result(audit(table(spark, []))) == []
    rows = [("en", "a", "one"), ("en", "b", "one"), ("fr", "a", None)]
    assert result(audit(table(spark, rows), least=3)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("seed", range(5))
def test_transducer_orders_its_words(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choice((97, 98, 195, 0, 255)) for _ in range(rng.randint(1, 9))) for _ in range(rng.choice((1, 5, 400)))})
    others = [bytes(rng.choice((97, 98, 195, 0, 255)) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    machine, asked = Transducer(words), words + others
    buffer = np.frombuffer(b"".join(asked), np.uint8)
    ends = np.cumsum([len(w) for w in asked])
    found = machine.ordinals(buffer, ends - [len(w) for w in asked], ends)
    place = {w: i for i, w in enumerate(words)}
    assert found.tolist() == [place.get(w, -1) for w in asked]
    assert machine.size == len(words)


def test_transducer_is_minimal():
    """No two states accept the same endings, and every state is on the way of a word."""
    words = sorted(a + b for a in (b"walk", b"talk", b"stalk", b"x") for b in (b"", b"s", b"ed", b"ing"))
    machine = Transducer(words)
    arcs = {}
    for key, target in zip(machine.keys.tolist(), machine.targets.tolist()):
        if key >= 0:
            arcs.setdefault(key >> 8, {})[key & 255] = target

    def endings(state):
        out = {b""} if machine.final[state] else set()
        return frozenset(out | {bytes([b]) + e for b, t in arcs.get(state, {}).items() for e in endings(t)})

    every = [endings(s) for s in range(len(machine.final))]
    assert len(set(every)) == len(every) and all(every)
    assert endings(machine.root) == set(words)


def test_terms_of_a_batch_keep_to_their_texts():
    import pyarrow as pa

    texts = [b"ab", b"cd EF", b"", b"g1h", "é".encode(), b"x" * 50]
    batch = pa.array([b"left out", *texts], pa.binary())[1:]
    got = [(int(r), bytes(buffer[a:b])) for buffer, starts, ends, rows in _words(batch) for a, b, r in zip(starts, ends, rows)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in TERM.findall(t.lower())]
    empty = pa.array([], pa.binary())
    assert list(_words(empty)) == []


def test_counts_are_summed_before_they_are_kept(spark, monkeypatch):
    kept, saved = [], source_divergence.saved
    monkeypatch.setattr(source_divergence, "saved", lambda df, name: kept.append(saved(df, name)) or kept[-1])
    rows = [(i, "the on ti", "en", f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").repartition(4)
    assert source_divergence.audit(docs, least=3, top=5).count() > 0
    counts = [df for df in kept if df.columns == ["lang", "source", "ordinal", "n"]]
    assert counts and all(df.count() == 6 for df in counts)
