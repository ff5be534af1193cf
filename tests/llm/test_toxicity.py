import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapewire.llm import toxicity
from tests.llm.conftest import prose, table

BAD = ("gribble", "snarkon", "wuzzleb")


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (10**6, 1)]
    docs = spark.createDataFrame([*rows, (None, "x"), (1000, None), (1001, "")], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    return docs, marks, toxicity.train(docs, marks, rows="{id} % 5 <> 0")


def test_held_out_rows(spark, learned):
    docs, marks, model = learned
    truth = {r.doc_id: r.toxic for r in marks.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, model).collect()}
    held = [i for i in range(0, 300, 5)]
    assert sum((got[i] >= 0.5) == bool(truth[i]) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[1000] < 0.5 and got[1001] < 0.5 and len(got) == 303


def test_disguised_words_score_like_plain_ones(spark, learned):
    scorer = toxicity.Scorer(learned[2])
    around = "the on ti er sha rer the ti on er "
    for hidden in ("gr1bble", "g r i b b l e", "griiiibble", "sn@rk0n", "s.n.a.r.k.o.n", "wu77leb wu22leb gr!bble"):
        assert scorer.score(around + hidden + " " + hidden) > 0.5, hidden
    assert scorer.score(around + "12 3 4 5 $$$ *** a b c") < 0.5


def test_decoding_prefers_likely_letters(learned):
    assert toxicity.decode("g r 1 b b l e", learned[2].letters) == "gribble"
    assert toxicity.decode("sn4rk0n", learned[2].letters) == "snarkon"


def test_letters_are_counted_over_everything(spark):
    df = spark.createDataFrame([(1, "ab ab"), (2, "AB"), (3, None), (4, "")], "doc_id int, text string").repartition(2)
    counts = {r.code: r.n for r in toxicity.letter_counts(df).collect()}
    edge = toxicity._EDGE
    assert counts[(edge * toxicity.SYMBOLS + 0) * toxicity.SYMBOLS + 1] == 3  # a word that begins with ab
    model = toxicity.letter_model(counts)
    assert model[edge, 0, 1] > model[edge, 0, 2]


def test_without_labels_or_documents(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, none)
    assert all(r.score < 1e-6 for r in toxicity.score(spark, docs, model).collect())
    assert toxicity.score(spark, nothing, toxicity.train(nothing, none)).collect() == []
    odd = table(spark, ["a " * 10, None, ""]).withColumnRenamed("keep_id", "score")
    assert toxicity.score(spark, odd, model).columns == ["doc_id", "score"]


def test_words_of_few_labelled_documents_count(spark):
    rng = random.Random(11)
    rows, labels, planted = [], [], {"gribble": 5, "snarkon": 5, "wuzzleb": 4, "plomquid": 3}
    toxic = [w for w, n in planted.items() for _ in range(n)]
    for i in range(80):
        words = prose(rng, rng.randint(20, 80)).split()
        if i < len(toxic):
            words.insert(rng.randrange(len(words)), toxic[i])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i < len(toxic))))
    for i in range(100, 140):  # without labels
        rows.append((i, prose(rng, 40) + " " + list(planted)[i % 4] if i < 120 else prose(rng, 40)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, model).collect()}
    assert all(got[i] >= 0.5 for i in range(100, 120)) and sum(got[i] < 0.5 for i in range(120, 140)) >= 19


def test_every_disguise_enters_the_lattice(learned):
    restore = toxicity.Restorer(learned[2].letters)
    for hidden in ("gribb13", "6r1bb13", '"6r1bb13"', "the,6r1bb13", "g  r  i  b  b  l  e", "g. r. i. b. b. l. e", "ggrriibbllee!", "(gr1bble", "gribbl3"):
        assert toxicity._WORD.findall(restore(hidden))[-1] in ("gribble", "grible"), hidden
    assert toxicity._WORD.findall(restore("5n4rk0n/wuzz13b")) == ["snarkon", "wuzzleb"]
    assert toxicity._WORD.findall(restore("the! (on) *ti* sha!!! 2023")) == ["the", "on", "ti", "sha"]


def test_patterns_take_time_in_proportion():
    for text in ("*" * 100_000, "i" + " *" * 100_000 + "ab", "* " * 100_000 + "aa", "ab" * 100_000 + "!", "x1" * 100_000):
        began = time.process_time()
        toxicity.DISGUISED.sub("", text)
        assert time.process_time() - began < 2


def test_long_runs_are_taken_whole(learned):
    model = learned[2]
    scorer, restore = toxicity.Scorer(model), toxicity.Restorer(model.letters)
    run = "the" * 40
    assert scorer.features(run + "snarkongribble")[0] == scorer.features("snarkongribble")[0] > scorer.features(run)[0]
    assert scorer.score("the on ti er " * 5 + run + "snarkon") > scorer.score("the on ti er " * 5 + run)
    assert restore("gr1bble" + "!" * 100).split() == ["gribble"]
    assert {w.replace("gribble", "") for w in restore(" ".join("gribble" * 20)).split()} == {""}
    assert "".join(toxicity.decode("5n4rk0n" * 2000, model.letters).split()) == "snarkon" * 2000


def test_documents_that_share_a_passage_are_all_learned_from(spark):
    rng = random.Random(12)
    passage = prose(rng, 400)  # holds the lowest shingle of nearly all rows
    texts = [f"{passage} {prose(rng, 6)}" for _ in range(20)] + ["the on " * 9, "The  on " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(22)], "doc_id bigint, toxic int")
    got = toxicity._labelled(docs, marks, "doc_id", "text", "toxic", "true")
    assert got.count() == 21


def test_distinct_words_are_those_of_the_restored_text(learned):
    restore = toxicity.Restorer(learned[2].letters)
    for text in ("The gr1bble, g r i b b l e; sn@rk0n/wuzzleb ON on 12 3 !!", "a b c!the snake_case s_n_a_r_k_o_n é3é", "", "***", "ab" * 3000 + " cc1"):
        assert restore.words(text) == set(toxicity._WORD.findall(restore(text))), text


def test_decoding_against_all_readings(learned):
    """The Viterbi path is the best of all readings of a short span: each sign read as a letter, as
    the letter before said again, or standing for itself."""
    model, edge, code = learned[2].letters, toxicity._EDGE, toxicity._CODE

    def cost(span, reads):
        a = b = edge
        word, total = "", 0.0
        for c, r in zip(span, reads):
            sign = c not in code
            if r == " ":  # a sign that stands for itself ends a word
                total += toxicity.PLAIN
                if b != edge:
                    total, a, b, word = total + model[a, b, edge], b, edge, word + " "
            elif r.isupper():
                if b != code[r.lower()]:
                    return None
                total += toxicity.AGAIN + toxicity.SWAP * sign
            else:
                total, a, b, word = total + model[a, b, code[r]], b, code[r], word + r
        return total + (model[a, b, edge] if b != edge else 0.0), word.strip()

    for span in ("gr1bble", "4n1", "0n7h3", "1l1", "5n4rk0n", "33"):
        ways = [[c, c.upper()] if c in code else [" ", *toxicity.LOOKALIKES[c], *toxicity.LOOKALIKES[c].upper()] for c in span]
        best = max(filter(None, (cost(span, reads) for reads in itertools.product(*ways))))
        assert toxicity.decode(span, model) == best[1], span


def test_parts_are_counted_once_a_document_whatever_is_gathered(monkeypatch):
    docs = [(["gribble", "gribbles", "on"], 3), (["gribble"], 5), ([], 7), ([f"w{i}x" for i in range(50)], 11)]
    schema = pa.schema([("words", pa.list_(pa.string())), *((c, pa.int64()) for c in toxicity._ADDS)])
    batch = pa.RecordBatch.from_pylist([{"words": w, **dict.fromkeys(toxicity._ADDS, n)} for w, n in docs], schema)
    want = Counter()
    for words, n in docs:
        for p in set().union(*map(toxicity.parts, words)):
            want[p] += n
    for gathered, at_once in ((10**6, 10**6), (1, 1), (20, 7)):
        monkeypatch.setattr(toxicity, "GATHERED", gathered)
        monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", at_once)
        got = Counter()
        for out in toxicity._count_parts(iter([batch])):
            for row in out.to_pylist():
                assert len({row[c] for c in toxicity._ADDS}) == 1
                got[row["part"]] += row["c0"]
        assert got == want


def test_counts_and_evidence_against_plain_counts():
    rng = random.Random(6)
    rows = [(f"text {i}", int(rng.random() < 0.3)) for i in range(200)]
    total = [sum(c) for c in zip(*(toxicity._adds(t, y, 0.3) for t, y in rows))]
    batch = pa.RecordBatch.from_arrays([pa.array([n]) for n in total], names=toxicity._ADDS)
    n, yes, deals = toxicity._counts(batch)
    folds = [toxicity._fold(t) for t, _ in rows]
    assert n[0].tolist() == [folds.count(k) for k in range(toxicity.FOLDS)]
    assert yes[0].tolist() == [sum(y for (_, y), f in zip(rows, folds) if f == k) for k in range(toxicity.FOLDS)]
    assert all(30 < d < 95 for d in deals[0])
    docs = np.array([[400.0] * 6, [100.0] * 6])
    chance = np.full(len(toxicity.RATIOS) + 1, 0.5)
    bad, every = sum(y for _, y in rows), len(rows)
    odds = math.log((bad + 0.5) / (every - bad + 0.5)) - math.log(100 / 300)
    assert toxicity._evidence(batch, docs, chance)[0, 0] == pytest.approx(max(odds, 0) * 0.25)


def test_two_runs_score_alike_and_copies_do_not_matter(spark, learned):
    docs, marks, model = learned
    copies = docs.where("doc_id % 7 = 0").selectExpr("doc_id", "upper(text) as text")
    for df in (docs.repartition(5), docs.union(docs.limit(40))):
        again = toxicity.train(df, marks, rows="{id} % 5 <> 0")
        assert again.evidence == model.evidence and np.array_equal(again.letters, model.letters) == (df.count() == docs.count())
    # Copies that differ in case: the smallest text is learned from, in every run.
    mixed = docs.union(copies)
    first, second = (toxicity.train(df, marks, rows="{id} % 5 <> 0") for df in (mixed, mixed.repartition(7)))
    assert first.evidence == second.evidence and np.array_equal(first.curve, second.curve)


def test_doubled_letters_are_settled_without_decoding(learned, monkeypatch):
    model, rng = learned[2], random.Random(21)
    spans = ["".join(rng.choice("abeelloté") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    spans = [s for s in spans if all(len(list(run)) < 3 or c == "é" for c, run in itertools.groupby(s))]
    want = {s: {toxicity.decode(s, model.letters)} if toxicity._SUSPECT.search(s) else {s} for s in spans}
    assert sum(w != {s} for s, w in want.items()) > 50
    monkeypatch.setattr(toxicity, "decode", lambda *_: pytest.fail("a doubled letter went through the decoder"))
    restore = toxicity.Restorer(model.letters)
    assert all(restore.words(s) == w for s, w in want.items())


def test_words_of_texts_that_stand_together_are_looked_up_once(learned, monkeypatch):
    rng = random.Random(22)
    texts = [prose(rng, rng.randint(0, 40)) + rng.choice([" gr1bble", " snarkon", ""]) for _ in range(60)] + ["", "the" * 40]
    model, calls, hashed = learned[2], [], toxicity.part_hashes
    want = [toxicity.Scorer(model).score(t) for t in texts]
    monkeypatch.setattr(toxicity, "part_hashes", lambda words: calls.append(len(words)) or hashed(words))
    assert toxicity.Scorer(model).scores(texts) == want and len(calls) == 1
    monkeypatch.setattr(toxicity, "WORDS", 50)  # whatever is remembered
    monkeypatch.setattr(toxicity, "TOGETHER", 300)
    assert toxicity.Scorer(model).scores(texts) == want


def test_spans_are_read_once_for_all_texts_and_endings_once_a_state(learned, monkeypatch):
    rng, read, behind = random.Random(23), [], toxicity._behind
    odd = ("gr1bble", "g r i b b l e", "a b c!", "ssseven", "thé–on", "İé ΑΣ", "s_n_a", "on$$$", "\x1cti\xa0er", "²x", "áb", "\0", "* a *b")
    texts = [" ".join([prose(rng, rng.randint(0, 20)), *rng.choices(odd, k=3), prose(rng, 4)]) for _ in range(80)] + ["", "the on on"]
    plain = toxicity.Restorer(learned[2].letters)
    want = [sorted(set(toxicity._WORD.findall(plain(t)))) for t in texts]
    monkeypatch.setattr(toxicity, "_behind", lambda *a: read.append(a[:3]) or behind(*a))
    assert list(toxicity.Restorer(learned[2].letters).each(texts)) == want
    assert len(read) == len(set(read)) < 60
    read.clear()
    words = [f"{w}ti$$$" for w in set(prose(rng, 300).split()) if not re.search(r"([a-z])\1", w + "ti")]
    restore = toxicity.Restorer(learned[2].letters)
    assert all(restore.words(w) == {toxicity.decode(w, learned[2].letters)} for w in words) and len(words) > 50
    assert len(read) == len(words) + 1


def test_what_letters_kept_apart_end_with_is_found_first():
    rng = random.Random(24)
    for _ in range(20_000):
        text = "".join(rng.choice("aab  .-_*~1!é,") for _ in range(rng.randint(0, 14)))
        assert toxicity._LONELY.search(text) or not toxicity._KEPT_APART.search(text), text


def test_frequent_parts_leave_a_task_once(monkeypatch):
    docs = [(f"gribble snarkon w{i}x", i + 1) for i in range(40)]
    schema = pa.schema([("words", pa.string()), *((c, pa.int64()) for c in toxicity._ADDS)])
    batch = pa.RecordBatch.from_pylist([{"words": w, **dict.fromkeys(toxicity._ADDS, n)} for w, n in docs], schema)
    want = Counter()
    for words, n in docs:
        for p in set().union(*map(toxicity.parts, words.split())):
            want[p] += n
    monkeypatch.setattr(toxicity, "GATHERED", 100)
    for counted in (10**6, 40, 0):
        monkeypatch.setattr(toxicity, "COUNTED", counted)
        found = [(row["part"], row["c0"]) for out in toxicity._count_parts(iter([batch])) for row in out.to_pylist()]
        got = Counter()
        for part, n in found:
            got[part] += n
        assert got == want
        if counted > 40:
            assert all([p for p, _ in found].count(part) == 1 for part in toxicity.parts("gribble"))


def test_parts_that_share_low_bits_are_told_apart(monkeypatch):
    keys = np.array([7 + (k << 40) for k in range(5)] + [1 << 20, 9, -3])
    weights = np.arange(1.0, 9.0)
    asked = np.array([*keys, 7 + (9 << 40), 8, -3 - (1 << 50), 7 + (4 << 40)])
    owners = np.append(np.arange(len(asked) - 1), 0)  # the last is a further part of the first word
    monkeypatch.setattr(toxicity, "part_hashes", lambda words: (asked, owners))
    for wide in (weights, np.column_stack([weights, weights[::-1]])):
        got = toxicity._Evidence(keys, wide).of([f"w{k}" for k in range(len(asked) - 1)])
        want = [np.maximum(wide[0], wide[4]), *wide[1:], *np.zeros((3, *wide.shape[1:]))]
        assert np.array_equal(got, want)


def test_a_long_text_is_split_in_pieces(learned, monkeypatch):
    rng, sizes, split = random.Random(25), [], toxicity._split
    texts = ["on the", f"{prose(rng, 400)} gr1bble {prose(rng, 300)} {'the' * 60}é–snarkon", "", "g r i b b l e " + prose(rng, 200), "er" * 500]
    restore = toxicity.Restorer(learned[2].letters)
    want = [sorted(set(toxicity._WORD.findall(restore(t)))) for t in texts]
    monkeypatch.setattr(toxicity, "TOGETHER", 200)
    monkeypatch.setattr(toxicity, "_split", lambda t: sizes.append(sum(map(len, t.to_pylist()))) or split(t))
    assert list(restore.each(texts)) == want
    assert len(sizes) > 10 and sorted(sizes)[-2] < 500
