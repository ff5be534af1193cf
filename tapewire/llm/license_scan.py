"""Fuzzy search for short licence notices.

A text is reduced to its words.  Each notice is allowed some edits and split into one part
more than that: where the notice stands with no more edits, at least one part stands exactly
(pigeonhole).  All parts of all notices are found in one pass by an Aho-Corasick automaton; only
around such seeds, in a window of the notice's length and its edits, does a bounded-error pattern
of ``regex`` verify the edits.
"""

from __future__ import annotations

import functools
from bisect import bisect
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases whose exact places are always counted, with their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices searched with edits, with their labels.
NOTICES = (
    *BASE_PHRASES,
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("spdx license identifier", "spdx"),
)
#: Letters a notice must have for each edit it is allowed.
LETTERS_PER_EDIT = 15
#: Windows of a text that are remembered with their match.
WINDOWS = 10_000
#: Bytes that end a word, and capitals, as one translation.
_WORD = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


class Span(NamedTuple):
    """A notice found: its label, first word and word after the last, edits, and what stands there."""

    label: str
    notice: str
    first_word: int
    end_word: int
    edits: int
    text: str


def words(text: str) -> bytes:
    """The words of a text, one space before each and one at the end; ASCII capitals lowered.

    Bytes from 0x80 on belong to words, so this is the same over bytes as over characters.
    """
    return b" " + b" ".join(text.encode().translate(_WORD).split()) + b" "


def edits_allowed(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


class Scanner:
    """Exact places of ``base`` and fuzzy places of ``notices``."""

    def __init__(self, base: Iterable[tuple[str, str]], notices: Iterable[tuple[str, str]]) -> None:
        self.base = [(b" " + p.encode() + b" ", label) for p, label in base]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices):
            padded, k = f" {notice} ", edits_allowed(notice)
            pattern = regex.compile(rf"(?b)(?:{regex.escape(padded, literal_spaces=True)}){{e<={k}}}")
            self.notices.append((notice, padded, label, k, pattern))
            bounds = np.linspace(0, len(padded), k + 2).astype(int)
            for a, b in zip(bounds, bounds[1:]):
                seeds.setdefault(padded[a:b], []).append((n, int(b)))
        for seed, owners in seeds.items():
            self.seeds.add_word(seed, owners)
        self.seeds.make_automaton()

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """``(first word, label)`` of every exact place, overlapping ones too."""
        found = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = joined.find(phrase, at + 1)
        return [(int(w), label) for w, label in zip(_word_at(joined, [a for a, _ in found]), [x for _, x in found])]

    def fuzzy(self, joined: bytes) -> list[Span]:
        """The best places of every notice within its edits, not overlapping for one notice.

        Every seed's window holds whatever place of its notice the seed may belong to, and is
        searched by itself.  Of places that overlap the one of fewer edits stays, then the first.
        Places may share the space between them: it belongs to the one that would stay, and is
        an edit of the other if that may have one more.
        """
        text = joined.decode("latin-1")  # one character a byte
        found: dict[int, dict[tuple[int, int], tuple[int, int, int]]] = {}
        searched: set[tuple[int, int]] = set()
        known: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        for end, owners in self.seeds.iter(text):
            for n, offset in owners:
                _, padded, _, k, pattern = self.notices[n]
                start = max(0, end + 1 - offset - k)
                if (n, start) in searched:
                    continue
                searched.add((n, start))
                window = text[start : end + 1 - offset + len(padded) + k]
                if (n, window) not in known:
                    if len(known) >= WINDOWS:
                        known.clear()
                    m = pattern.search(window)
                    known[n, window] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
                if place := known[n, window]:
                    a, b, edits = place[0] + start, place[1] + start, place[2]
                    inner = a + (text[a] == " "), b - (text[b - 1] == " ")
                    found.setdefault(n, {}).setdefault(inner, (a, b, edits))
        out = []
        for n, places in found.items():
            notice, _, label, k, _ = self.notices[n]
            out += [(a, b, label, notice, edits, text[a:b]) for a, b, edits in _best_apart(places, k)]
        first = _word_at(joined, [a for a, *_ in out])
        last = _word_at(joined, [b - 1 for _, b, *_ in out])
        return [
            Span(label, notice, int(a), int(b), edits, found.strip().encode("latin-1").decode(errors="replace"))
            for a, b, (_, _, label, notice, edits, found) in zip(first, last, out)
        ]


def _best_apart(places: dict[tuple[int, int], tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """The places, of those whose inner spans (the keys) overlap the one of fewest edits, then the first.

    A space that another place holds is one of at most ``most`` edits.
    """
    chosen: list[tuple[int, int]] = []
    for level in sorted({edits for _, _, edits in places.values()}):
        more: list[tuple[int, int]] = []
        for span in sorted(inner for inner, place in places.items() if place[2] == level):
            at = bisect(chosen, span)
            free = (not at or chosen[at - 1][1] <= span[0]) and (at == len(chosen) or span[1] <= chosen[at][0])
            if free and (not more or more[-1][1] <= span[0]):
                more.append(span)
        chosen = sorted(chosen + more)
    out = []
    for i, span in enumerate(chosen):
        a, b, edits = places[span]
        before = i > 0 and places[chosen[i - 1]][1] > a and places[chosen[i - 1]][2] <= edits
        behind = i + 1 < len(chosen) and places[chosen[i + 1]][0] < b and places[chosen[i + 1]][2] < edits
        out.append((a, b, min(most, edits + before + behind)))
    return out


def _word_at(joined: bytes, places: list[int]) -> np.ndarray:
    """How many words begin before each place (a word begins after a space)."""
    if not places:
        return np.empty(0, int)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.searchsorted(spaces, places, side="left")


@functools.cache
def scanner(base: tuple, notices: tuple) -> Scanner:
    return Scanner(base, notices)


SPANS = "array<struct<label:string,notice:string,first_word:bigint,end_word:bigint,edits:int,text:string>>"
OUT = f"id string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: tuple[tuple[str, str], ...] = BASE_PHRASES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
) -> DataFrame:
    """Licence labels of every text.

    Columns: the id; ``n_words``; of the exact ``base`` phrases ``n_base`` (all places),
    ``first_word`` and ``last_word`` (smallest and largest start, null without places) and
    ``base_labels``; ``labels`` with those of ``notices`` found with edits; ``score``, the share of
    the best notice's letters without edits (0 without any); ``spans`` of the notices.  Labels are
    distinct, sorted and joined by commas.  Null and empty texts have no words and score 0;
    repeated rows and null ids are answered row by row.  Other columns are ignored, whatever
    their names.
    """
    base, notices = tuple(map(tuple, base)), tuple(map(tuple, notices))
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = OUT.replace("id string", f"id {kind}", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = scanner(base, notices)
        for batch in batches:
            rows = [_row(search, text.as_py()) for text in batch.column("text")]
            arrays = [batch.column("id"), *(pa.array(list(v), t) for v, t in zip(zip(*rows), _TYPES))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", *_NAMES])

    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("text", pa.string())])
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(_SPAN)]


def _row(search: Scanner, text: str) -> tuple:
    joined = words(text)
    n_words = joined.count(b" ") - 1 if len(joined) > 2 else 0
    exact, fuzzy = search.exact(joined), search.fuzzy(joined)
    starts = [w for w, _ in exact]
    sure = {label for _, label in exact}
    best = max([1.0 * bool(exact), *(1 - s.edits / len(s.notice) for s in fuzzy)])
    spans = [s._asdict() for s in sorted(fuzzy, key=lambda s: (s.first_word, s.end_word, s.notice))]
    return (
        n_words, len(exact), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(sure)), ",".join(sorted(sure | {s.label for s in fuzzy})), best, spans,
    )


def label_array(labels: Column) -> Column:
    """The comma-joined labels as an array; none as an empty one."""
    return F.when(labels == "", F.array().cast("array<string>")).otherwise(F.split(labels, ","))
