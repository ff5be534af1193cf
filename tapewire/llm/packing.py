"""Packing documents into sequences of one window by non-negative least squares.

Each document is tokenised where it is read.  Whole windows at its front are sequences of
their own; what is left, less than a window, goes with its ids to one of many shards of
bounded size.  A shard counts its lengths in classes of ``GRAIN`` tokens, enumerates all
combinations of up to three classes that fill the window, solves how often to repeat each
against the histogram with non-negative least squares, rounds down, deals documents to the
combinations, and packs the residual documents greedily: whole where they fit, cut where
they close a gap.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.common import partitions_for, taking_over

#: Tokens of one length class, and parts of one combination at most.
GRAIN, DEPTH = 32, 3
#: A gap below this many tokens is left as padding; no piece is cut shorter.
LEAST_CUT = 16
#: Bytes of text a shard holds on average; words a task remembers.
SHARD_BYTES, WORDS = 32 << 20, 400_000
#: Bits of a sequence number within its shard.
LOCAL_BITS = 32


# --- token ids ----------------------------------------------------------------------------------


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """The ids of a run of letters, a digit or a run of signs (lower case) as little-endian 32-bit
    numbers, looked up once.

    For vocabularies whose tokens never span white space, which is dropped.  Texts of ASCII and of
    Latin-1 letters, which are composed already, go straight to the merges, run by run; of others
    only such words do, the rest goes through the whole tokenizer.
    """

    SIMPLE = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*+")
    #: The vocabulary's pattern, for simple texts.
    RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
    #: White space of the vocabulary's pattern; Python also splits at four control characters.
    SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    #: How the vocabulary writes the bytes of UTF-8 that are no Latin-1 sign: from 7F to A0 one after the other.
    BYTES = {b: 0x121 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 0x143}

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}  # of texts that are not simple

    def __missing__(self, run: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        written = run if run.isascii() else run.encode().decode("latin-1").translate(self.BYTES)
        ids = self[run] = _packed([t.id for t in self.model.tokenize(written)])
        return ids

    def _simple(self, text: str) -> bool:
        return self.SIMPLE.fullmatch(text) is not None and "<|" not in text

    def _runs(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.RUNS.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        if len(self.words) >= WORDS // 2:
            self.words.clear()
        simple = self._simple(word)
        ids = self.words[word] = self._runs(word) if simple else _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self._simple(text):
            return np.frombuffer(self._runs(text), "<u4")
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = [w for w in self.SPACE.split(text) if w] if odd else text.split()
        known = self.words
        return np.frombuffer(b"".join([known.get(w) or self._word(w) for w in words]), "<u4")


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _encoder(path: str) -> WordIds:
    taking_over("packing", word_ids.cache_clear)
    return word_ids(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


# --- the arithmetic of one shard ------------------------------------------------------------------


@functools.cache
def combinations(classes: int) -> np.ndarray:
    """Every way to fill ``classes`` grains with up to DEPTH length classes, as columns of counts."""
    found = [(classes,)]
    found += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    found += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    columns = np.zeros((classes, len(found)))
    for j, parts in enumerate(found):
        for c in parts:
            columns[c - 1, j] += 1
    return columns


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|: active sets, one column more or less at a time."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    floor = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        free = np.where(active, -np.inf, gradient)
        best = int(free.argmax())
        if free[best] <= floor:
            break
        active[best] = True
        while True:
            columns = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, columns], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[columns] = s
                break
            bad = s <= 0
            old = x[columns]
            step = (old[bad] / np.maximum(old[bad] - s[bad], 1e-300)).min()
            x[columns] = old + step * (s - old)
            active[columns[x[columns] <= 1e-12]] = False
            x[~active] = 0
        gradient = a.T @ (b - a @ x)
    return x


def plan(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents shorter than a window.

    Only lengths count: equal lengths in equal order give equal plans.
    """
    classes = window // GRAIN
    of = (lengths + GRAIN - 1) // GRAIN
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(1, classes + 2))
    taken, left = bounds[:-1].copy(), np.diff(bounds)
    out: list[tuple[int, int, int, int, int]] = []
    filled: list[np.ndarray] = []
    sequences = 0
    if len(lengths):
        columns = combinations(classes)
        repeats = nnls(columns, left.astype(float))
        # Gaps of half a grain a part are closed with residual documents: keep that many back.
        keep = 1 - DEPTH * GRAIN / 2 / window
        for j in np.argsort(-repeats, kind="stable"):
            parts = columns[:, j].astype(int)
            uses = np.flatnonzero(parts)
            n = min(int(repeats[j] * keep), int((left[uses] // parts[uses]).min()))
            if n <= 0:
                if repeats[j] <= 0:
                    break
                continue
            total = np.zeros(n, np.int64)
            for c in uses[::-1]:
                for _ in range(parts[c]):
                    docs = order[taken[c] : taken[c] + n]
                    taken[c] += n
                    left[c] -= n
                    seqs = np.arange(sequences, sequences + n)
                    out += zip(docs.tolist(), [0] * n, lengths[docs].tolist(), seqs.tolist(), total.tolist())
                    total = total + lengths[docs]
            filled.append(total)
            sequences += n
    # The residual, shortest first: (length, document, start).
    rest = sorted(
        (int(lengths[d]), int(d), 0) for c in range(classes) for d in order[taken[c] : bounds[c + 1]].tolist()
    )
    used = np.concatenate(filled).tolist() if filled else []
    sequence = 0
    while rest or sequence < len(used):
        offset = used[sequence] if sequence < len(used) else 0
        free = window - offset
        while rest and free > 0:
            at = bisect_left(rest, (free + 1,))
            if at:  # the longest that fits, whole
                n, doc, start = rest.pop(at - 1)
            elif free >= LEAST_CUT:  # the front of the shortest that does not
                n, doc, start = rest.pop(0)
                insort(rest, (n - free, doc, start + free))
                n = free
            else:
                break
            out.append((doc, start, n, sequence, offset))
            offset, free = offset + n, free - n
        sequence += 1
    return out


# --- the operator ---------------------------------------------------------------------------------


def pack(
    df: DataFrame,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Columns: the id, ``start`` (ids of the document before the piece), ``length``, ``ids_crc32``
    (unsigned, over little-endian 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset`` (place
    in the sequence, gapless from 0), and with ``with_ids`` the ``ids`` themselves.  A document is
    the library's ids without added special tokens and then ``end_id``; null and empty texts are
    ``end_id`` alone.  Every row is packed, repeated rows and rows without an id too.  Each shard
    leaves at most one sequence partly filled.  Other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = partitions_for(texts.agg(F.sum(F.octet_length("text"))).first()[0], SHARD_BYTES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                whole = len(ids) // window * window
                shard = zlib.crc32(repr(i).encode() if i is not None else ids.tobytes()) % shards
                for at in range(0, whole, window):
                    part = ids[at : at + window]
                    rows.append((shard, i, at, window, _crc(part), len(ids), part.tobytes() if with_ids else None, True))
                if whole < len(ids):
                    rows.append((shard, i, whole, len(ids) - whole, None, len(ids), ids[whole:].tobytes(), False))
                if len(rows) >= 4096:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    columns = [("shard", pa.int32()), ("id", _arrow(kind)), ("start", pa.int64()), ("length", pa.int64()),
               ("crc", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("done", pa.bool_())]

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(list(values), t) for values, (_, t) in zip(zip(*rows), columns)]
        return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in columns])

    def arrange(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.assign(known=group["id"].notna()).sort_values(
            ["done", "length", "known", "id", "start", "ids"], ascending=[False, True, True, True, True, True], kind="stable"
        )
        done, rest = group[group["done"]], group[~group["done"]]
        out = [
            (i, s, n, c, t, k, 0, ids)
            for k, (i, s, n, c, t, ids) in enumerate(
                zip(done["id"], done["start"], done["length"], done["crc"], done["doc_tokens"], done["ids"])
            )
        ]
        held = [np.frombuffer(b, "<u4") for b in rest["ids"]]
        names, starts, totals = rest["id"].tolist(), rest["start"].tolist(), rest["doc_tokens"].tolist()
        for doc, at, n, sequence, offset in plan(rest["length"].to_numpy(np.int64), window):
            ids = held[doc][at : at + n]
            out.append(
                (names[doc], starts[doc] + at, n, _crc(ids), totals[doc], len(done) + sequence, offset,
                 ids.tobytes() if with_ids else None)
            )
        made = pd.DataFrame(out, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        made["id"] = made["id"].astype(group["id"].dtype)
        made["sequence_id"] = made["sequence_id"].astype("int64") + (shard << LOCAL_BITS)
        made["ids"] = [np.frombuffer(b, "<u4").tolist() for b in made["ids"]] if with_ids else None
        return made

    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<bigint>"
    parts = texts.mapInArrow(cut, f"shard int, id {kind}, start bigint, length bigint, crc bigint, doc_tokens bigint, ids binary, done boolean")
    packed = parts.groupBy("shard").applyInPandas(arrange, schema).withColumnRenamed("id", id_col)
    return packed if with_ids else packed.drop("ids")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
