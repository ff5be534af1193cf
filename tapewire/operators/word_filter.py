"""A first pass over texts for dictionary tables of any size: places where a keyword may stand.

Keywords are hashed into a filter of bounded size, under their length and, cut to LEAD characters,
under that of their beginning.  The hash of any piece of a text is a difference of two running sums,
so that all places of a text are tested together: first the beginnings, then, where one is found, the
lengths that keywords have.  What passes may still be wrong, some in ten thousand places, and is
joined with the keywords.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter by number of keywords, at least and at most (32 MB), and bits set by a keyword.
BITS_EACH, LEAST_BITS, MOST_BITS, HASHES = 48, 20, 28, 3
#: Characters of a beginning, characters of a text that are tested together, bits of a part.
LEAD, PIECE, PART = 4, 1 << 18, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _sums(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running sums of the characters, each times the power of its place."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64)))


def _hash(sums: np.ndarray, back: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the pieces of this length at these places; equal pieces have equal hashes, wherever they are."""
    return (sums[at + length] - sums[at]) * back[at] ^ np.multiply(_MIX, np.uint64(length))


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The HASHES bits of each hash."""
    out = []
    for i in range(HASHES):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((int(_MIX) + 2 * i) % (1 << 64))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_BASE)
        out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


@dataclass(frozen=True)
class WordFilter:
    """Bits of whole keywords and of their beginnings, and the lengths there are of each."""

    bits: int
    words: np.ndarray
    leads: np.ndarray
    lengths: tuple[int, ...]

    def _holds(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        held = np.ones(len(hashes), bool)
        for at in _bits(hashes, self.bits):
            held &= (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return held

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """Place and length of everything in the text that may be a keyword."""
        whole, widest = _codes(text), max(self.lengths, default=1)
        size = min(PIECE + widest, len(whole) + 1)
        powers, back = _powers(_BASE, size), _powers(_BACK, size)
        for first in range(0, len(whole) if self.lengths else 0, PIECE):
            codes = whole[first : first + PIECE + widest - 1]
            sums, own = _sums(codes, powers), min(PIECE, len(whole) - first)
            for lead in sorted({min(n, LEAD) for n in self.lengths}):
                at = np.arange(max(0, min(own, len(codes) - lead + 1)))
                at = at[self._holds(self.leads, _hash(sums, back, at, lead))]
                for n in self.lengths:
                    if min(n, LEAD) == lead:
                        there = at[at + n <= len(codes)]
                        there = there[self._holds(self.words, _hash(sums, back, there, n))]
                        yield from ((first + i, n) for i in there.tolist())


def _hash_of(word: str) -> np.ndarray:
    codes = _codes(word)
    sums = _sums(codes, _powers(_BASE, len(codes)))
    return _hash(sums, np.ones(1, np.uint64), np.zeros(1, np.int64), len(codes))


def word_filter(words: DataFrame, col: str = "word") -> WordFilter:
    """The filter of a table of keywords; parts of PART bits are made by tasks of their own.

    Lengths of keywords, distinct ones, and at most 2 x 32 MB of bits go through the driver.
    """
    found = words.select(F.col(col).alias("word"), F.length(col).alias("n"))
    lengths = sorted(r["n"] for r in found.select("n").distinct().collect())
    count = found.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * max(count, 1)).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("word").to_pylist()
            marks = [(kind, b) for kind, cut in ((0, None), (1, LEAD)) for t in {t[:cut] for t in texts} for x in _bits(_hash_of(t), bits) for b in x.tolist()]
            kinds, at = zip(*marks) if marks else ((), ())
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "at": pa.array(at, pa.int64())})

    marks = found.select("word").mapInArrow(place, "kind int, at bigint")
    parts = marks.groupBy("kind", F.expr(f"at div {PART}").alias("part")).agg(F.collect_set((F.col("at") % PART).cast("int")).alias("ats"))
    tables = np.zeros((2, 1 << bits), bool)
    for row in parts.toLocalIterator():  # one part at a time
        tables[row["kind"], np.array(row["ats"], np.int64) + row["part"] * PART] = True
    packed = [np.packbits(t, bitorder="little") for t in tables]
    return WordFilter(bits, packed[0], packed[1], tuple(lengths))


def candidate_places(df: DataFrame, words: WordFilter, text_col: str, key: str) -> DataFrame:
    """``(key, pos, word)`` for every place and length of a text that passes the filter."""
    sent = df.sparkSession.sparkContext.broadcast(words)
    kind = df.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows: list[int] = []
            places: list[int] = []
            found: list[str] = []

            def out() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(found, pa.string())], [key, "pos", "word"])
                for held in (rows, places, found):
                    held.clear()
                return made

            for i, text in enumerate(batch.column(1)):
                whole = text.as_py() or ""
                for at, n in sent.value.places(whole):
                    rows.append(i)
                    places.append(at)
                    found.append(whole[at : at + n])
                    if len(rows) >= 100_000:
                        yield out()
            yield out()

    return df.select(key, text_col).mapInArrow(find, f"`{key}` {kind}, pos bigint, word string")
