import random
import re
import time
from collections import Counter

import regex

from tapewire.llm.license_scan import BASE_PHRASES, NOTICES, Scanner, edits_allowed, scan, words
from tests.llm.conftest import table

TEXTS = [
    "Released Under the MIT License. under-the;mit/license", "undr the mit licence", "Apache License, Version 2.0; CC BY-NC 4.0",
    "the GNU Genral Public License", "cc by nc cc by nc", "permission is hereby granted, free of charge to any persn obtaining a copy",
    "nothing here", "", None, "under the mit licenses", "é under the mit licenseé", "xunder the mit license", "under the mit",
]


def spots(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    found = spots(text)
    starts = [(i, label) for phrase, label in BASE_PHRASES for i in range(len(found)) if found[i : i + len(phrase.split())] == phrase.split()]
    return len(found), len(starts), min(starts, default=(None,))[0], max(starts, default=(None,))[0], ",".join(sorted({x for _, x in starts}))


def test_base_phrases_against_lists_of_words(spark, texts, nothing):
    df = table(spark, [*TEXTS, *texts])
    got = scan(df).collect()
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    assert len(got) == df.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert scan(nothing).collect() == []


def test_edits_are_found_where_a_full_search_finds_them():
    search = Scanner(BASE_PHRASES, NOTICES)
    for text in TEXTS:
        joined = words(text or "")
        got = {(s.notice, s.edits) for s in search.fuzzy(joined)}
        for notice, _ in NOTICES:
            pattern = regex.compile(rf"(?b)(?:{regex.escape(f' {notice} ', literal_spaces=True)}){{e<={edits_allowed(notice)}}}")
            want = [sum(m.fuzzy_counts) for m in pattern.finditer(joined.decode("latin-1"))]
            assert sorted(e for n, e in got if n == notice) == sorted(set(want)), (text, notice)


def test_spans_name_words(spark):
    df = spark.createDataFrame([(1, "It is undr the MIT license, and more")], "doc_id int, text string")
    row = scan(df).first()
    assert row.labels == "mit" and row.base_labels == "" and row.n_base == 0 and 0.9 < row.score < 1
    span = [s for s in row.spans if s.label == "mit"][0]
    assert (span.first_word, span.end_word, span.edits, span.text) == (2, 6, 1, "undr the mit license")


def test_spans_that_stand_back_to_back_are_all_found():
    search = Scanner(BASE_PHRASES, NOTICES)

    def edits(text):
        return sorted((s.first_word, s.edits) for s in search.fuzzy(words(text)) if s.notice == "under the mit license")

    assert edits("under the mit licence " * 2) == [(0, 1), (4, 1)]
    assert edits("under the mit licence under the mit licence under the mit license") == [(0, 1), (4, 1), (8, 0)]
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 8)
        pieces, want, at = [], [], 0
        for _ in range(n):
            wrong, exact = rng.random() < 0.5, "under the mit license"
            behind = pieces[-1:] == [exact]  # whose space is taken
            pieces.append("undr the mit license" if wrong else exact)
            want.append((at, int(wrong or behind)))
            at += 4
            if rng.random() < 0.3:
                pieces.append("other")
                at += 1
        assert edits(" ".join(pieces)) == want, pieces


def test_places_against_distances_of_all_substrings():
    """Every substring within a notice's edits overlaps a span found, of no more edits but for a space that is taken."""
    rng = random.Random(8)
    base, notices = BASE_PHRASES, (("cc by nc sharealike", "x"), ("gnu general public license", "gpl"))
    search = Scanner(base, notices)
    for _ in range(30):
        text = " ".join(rng.choice(["gnu", "general", "genral", "public", "license", "cc", "by", "nc", "sharelike", "sharealike"]) for _ in range(14))
        text += rng.choice([" gnu general public license", " gnu genral public license gnu general public licens", " cc by nc sharelike"])
        joined = words(text)
        flat = joined.decode()
        spans = search.fuzzy(joined)
        for notice, _ in notices:
            k, padded = edits_allowed(notice), f" {notice} "
            mine = [s for s in spans if s.notice == notice]
            starts = [m.start() for m in re.finditer(" ", flat)]
            for a in range(len(flat)):
                row = list(range(len(padded) + 1))
                for b in range(a, min(len(flat), a + len(padded) + k)):
                    row, before = [row[0] + 1], row
                    for j, c in enumerate(padded):
                        row.append(min(row[-1] + 1, before[j + 1] + 1, before[j] + (c != flat[b])))
                    if row[-1] <= k:
                        inner = (a + (flat[a] == " "), b + 1 - (flat[b] == " "))
                        held = [s for s in mine if s.edits <= row[-1] + 1 and starts[s.first_word] < inner[1] and inner[0] < starts[s.end_word]]
                        assert held, (notice, flat[a : b + 1], mine)


def test_time_is_in_proportion_to_notices(spark):
    search = Scanner(BASE_PHRASES, NOTICES)
    rng = random.Random(1)
    plain = "under the mit licence " * 10_000
    mixed = " ".join("under the mit " + rng.choice(("licence", "license", "licens")) + " " + str(rng.randrange(10**6)) for _ in range(10_000))
    for text in (plain, mixed):
        began = time.process_time()
        found = search.fuzzy(words(text))
        assert time.process_time() - began < 2
        assert Counter(s.notice for s in found)["under the mit license"] == 10_000
