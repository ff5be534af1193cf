"""Keywords of a dictionary table looked up where the texts are read, so that no hit is moved.

A part of a dictionary, of bounded size, goes to every task: its words sorted by their hashes, one
table a length, with a bit for each category that has the word.  Texts are read together, some hundred
thousand characters at once.  A filter as in `word_filter` names the places; what passes it is looked
up and compared letter by letter, so that nothing wrong is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from tapewire.operators.word_filter import (
    _BACK, _BASE, _MIX, BITS_EACH, LEAD, LEAST_BITS, MOST_BITS, PIECE, WordFilter, _bits, _hash, _powers, _sums,
)

#: Characters of texts that are read together, and what ends a text: no character.
TOGETHER, END = 1 << 18, 0x110000
#: Categories of a table: bits of its masks.
MOST_CATEGORIES = 63
#: Steps in which all places of texts are told apart together, before the rest goes one by one.
STEPS = 8


@dataclass(frozen=True)
class WordTable:
    """Words by their numbers: ``masks`` of categories and ``shares``; by length, the hashes in order,
    the letters of these words, their numbers, and how many words may have one hash."""

    categories: list[str]
    filter: WordFilter
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    masks: np.ndarray
    shares: np.ndarray
    words: pa.Array | None

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place, end and word of every hit, by place and then by length; places go on over all texts."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        whole = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        whole[ends - 1] = END
        widest = max(self.by_length, default=1)
        size = min(PIECE + widest, len(whole) + 1)
        powers, back = _powers(_BASE, size), _powers(_BACK, size)
        places, sizes, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first in range(0, len(whole) if self.by_length else 0, PIECE):
            letters = whole[first : first + PIECE + widest - 1]
            codes = letters.astype(np.uint64)
            sums, own = _sums(codes, powers), min(PIECE, len(whole) - first)
            for lead in sorted({min(n, LEAD) for n in self.by_length}):
                at = np.arange(max(0, min(own, len(codes) - lead + 1)))
                at = at[self.filter._holds(self.filter.leads, _hash(sums, back, at, lead))]
                for n in self.by_length:
                    if min(n, LEAD) == lead:
                        there = at[at + n <= len(codes)]
                        hashes = _hash(sums, back, there, n)
                        passed = self.filter._holds(self.filter.words, hashes)
                        there, number = self._words(letters, there[passed], hashes[passed], n)
                        places.append(there + first)
                        sizes.append(np.full(len(there), n))
                        numbers.append(number)
        at, n, number = (np.concatenate(x) for x in (places, sizes, numbers))
        order = np.lexsort((n, at))
        at, n, number = at[order], n[order], number[order]
        return np.searchsorted(ends, at, "right"), at, at + n, number

    def _words(self, letters: np.ndarray, at: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces of ``n`` letters at these places, those that are words, with the words' numbers."""
        known, codes, numbers, alike = self.by_length[n]
        found, words = [], []
        start = np.searchsorted(known, hashes)
        for i in range(alike):
            row = start + i
            same = np.flatnonzero(row < len(known))
            same = same[known[row[same]] == hashes[same]]
            for k in range(n):
                same = same[letters[at[same] + k] == codes[row[same], k]]
            found.append(at[same])
            words.append(numbers[row[same]])
        return np.concatenate(found), np.concatenate(words)

    def kept(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Category, texts and words of the hits that count, in text order: of a place the longest
        word of the category, none that begins inside the one before."""
        text, at, end, number = self.hits(texts)
        masks = self.masks[number]
        for c in range(len(self.categories)):
            own = np.flatnonzero(masks >> np.uint64(c) & np.uint64(1))
            if len(own):
                longest = np.append(at[own[1:]] != at[own[:-1]], True)
                own = own[longest]
                own = own[apart(at[own], end[own])]
                yield c, text[own], number[own]


def apart(at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of these spans, in order of their places, are kept if each begins behind the last one kept."""
    left, kept = np.arange(len(at)), []
    for _ in range(STEPS):
        if not len(left):
            break
        # A span behind the ends of all before it is kept; what begins inside such a one is not.
        before = np.concatenate((np.full(1, -1), np.maximum.accumulate(end[left])[:-1]))
        first = at[left] >= before
        inside = end[left[first]][np.cumsum(first) - 1]
        kept.append(left[first])
        left = left[~first & (at[left] >= inside)]
    # The last one kept before each of the rest may be any of those above.
    if len(left):
        sure = np.sort(np.concatenate(kept))
        earlier = np.searchsorted(sure, left)
        bound = end[sure[earlier - 1]]
        last, more = 0, []
        for i, a, e, b in zip(left.tolist(), at[left].tolist(), end[left].tolist(), bound.tolist()):
            if a >= max(last, b):
                more.append(i)
                last = e
        kept.append(np.array(more, np.int64))
    return np.sort(np.concatenate(kept)) if kept else left


def word_table(rows: pa.Table, categories: list[str], texts: bool) -> WordTable:
    """The table of distinct words: ``word, mask, share``; with ``texts`` it can name its words."""
    words = rows.column("word").to_pylist()
    lengths = np.array([len(w) for w in words], np.int64)
    by_length, hashes, leads = {}, [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n in np.unique(lengths).tolist():
        numbers = np.flatnonzero(lengths == n)
        codes = np.frombuffer("".join(words[i] for i in numbers.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        own = _hashes(codes)
        order = np.argsort(own, kind="stable")
        own, codes, numbers = own[order], codes[order], numbers[order]
        most = int(codes.max())
        codes = codes.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)
        by_length[n] = (own, codes, numbers, int(np.unique(own, return_counts=True)[1].max()))
        hashes.append(own)
        leads.append(np.unique(_hashes(codes[:, :LEAD])))
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * max(len(words), 1)).bit_length()))
    marked = []
    for part in (np.concatenate(hashes), np.concatenate(leads)):
        table = np.zeros(1 << bits, bool)
        for at in _bits(part, bits):
            table[at] = True
        marked.append(np.packbits(table, bitorder="little"))
    masks = rows.column("mask").to_numpy().astype(np.uint64)
    held = rows.column("word").combine_chunks() if texts else None
    return WordTable(categories, WordFilter(bits, *marked, tuple(by_length)), by_length, masks, rows.column("share").to_numpy(), held)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """As `word_filter._hash`, of words of one length."""
    powers, out = _powers(_BASE, codes.shape[1]), np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out += (codes[:, k].astype(np.uint64) + np.uint64(1)) * powers[k]
    return out ^ np.multiply(_MIX, np.uint64(codes.shape[1]))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts of a batch that are read together."""
    rows, texts, size = [], [], 0
    for i, text in enumerate(batch.column(1)):
        whole = text.as_py()
        if whole:
            rows.append(i)
            texts.append(whole)
            size += len(whole)
        if size >= TOGETHER:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def lists(table: WordTable, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``(key, category, matches)`` of a batch of keys and texts."""
    for rows, texts in _groups(batch):
        for c, text, number in table.kept(texts):
            there, sizes = np.unique(text, return_counts=True)
            offsets = pa.array(np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes))), pa.int32())
            found = pa.ListArray.from_arrays(offsets, table.words.take(pa.array(number)).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([_keys(batch, rows, there), _named(table, c, len(there)), found], ["key", "category", "matches"])


def counts(table: WordTable, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``(key, category, unique_matches, occurrences, total)``: distinct words, hits, and the shares of the
    distinct words added up in text order."""
    for rows, texts in _groups(batch):
        for c, text, number in table.kept(texts):
            distinct = pd.unique(text * len(table.masks) + number)
            of, word = distinct // len(table.masks), distinct % len(table.masks)
            occurrences = np.bincount(text, minlength=len(texts))
            there = np.flatnonzero(occurrences)
            unique, total = np.bincount(of, minlength=len(texts)), np.bincount(of, table.shares[word], len(texts))
            yield pa.RecordBatch.from_arrays(
                [_keys(batch, rows, there), _named(table, c, len(there)), *[pa.array(x[there]) for x in (unique, occurrences, total)]],
                ["key", "category", "unique_matches", "occurrences", "total"],
            )


def _keys(batch: pa.RecordBatch, rows: list[int], there: np.ndarray) -> pa.Array:
    return batch.column(0).take(pa.array(np.array(rows, np.int64)[there]))


def _named(table: WordTable, c: int, n: int) -> pa.Array:
    return pa.array([table.categories[c]] * n, pa.string())
