"""Encoding and decoding with the pieces of a sentencepiece model by unigram Viterbi.

The pieces stand in a double-array trie over UTF-8 bytes, each with its log score.  A text is
cut where no piece can cross, and in each part the sequence of pieces of the greatest score
sum is found.  A character without a piece becomes its bytes, where the model has byte pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
#: What an unknown character costs below the least score of all pieces, as in unigram models.
UNKNOWN_PENALTY = 10.0
#: Parts of texts a task remembers.
PARTS = 300_000


class DoubleArray:
    """A trie of byte strings in two arrays: child c of node s is t = base[s] + c if check[t] = s.

    ``value[t]`` is the number of the key that ends at t, or -1.
    """

    def __init__(self, keys: Iterable[tuple[bytes, int]]) -> None:
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        root: dict = {}
        for key, number in keys:
            node = root
            for byte in key:
                node = node.setdefault(byte, {})
            node[-1] = number
        # Where nodes of one child and of several were placed last: neither looks further back.
        narrow, wide = 1, 1
        waiting = deque([(0, root)])
        while waiting:
            state, node = waiting.popleft()
            self.value[state] = node.get(-1, -1)
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            base = max(1, (narrow if len(codes) == 1 else wide) - codes[0])
            self._grow(base + 512)
            while any(self.check[base + c] >= 0 for c in codes):
                base += 1
                self._grow(base + 512)
            if len(codes) == 1:
                narrow = base + codes[0] + 1
            else:
                wide = base + codes[0]
            self.base[state] = base
            for c in codes:
                self.check[base + c] = state
                waiting.append((base + c, node[c]))

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            more = max(more, len(self.base))
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more

    def prefixes(self, text: bytes, start: int = 0) -> list[tuple[int, int]]:
        """``(end, number)`` of every key that stands in ``text`` from ``start`` on."""
        base, check, value = self.base, self.check, self.value
        state, out = 0, []
        for at in range(start, len(text)):
            child = base[state] + text[at]
            if check[child] != state or not child:
                break
            state = child
            if value[state] >= 0:
                out.append((at + 1, value[state]))
        return out


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            byte = message[at]
            n |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return n, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class Pieces:
    """The pieces of a model file, as unigrams whatever the model was trained as."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            proto = file.read()
        normalizer = dict(_fields(dict(_fields(proto)).get(3, b"")))
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize if normalizer.get(2) else None  # a table of characters
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.trie = DoubleArray((names[i].encode(), i) for i in plain)
        self.unknown = model.unk_id()
        self.unknown_score = min((self.scores[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_ids = frozenset(self.bytes.values())
        #: No piece holds any other pair of neighbours: between them a text may be cut.
        self.pairs = {names[i][k : k + 2] for i in plain for k in range(len(names[i]) - 1)}
        self.surface = [b"" if model.is_control(i) else names[i].replace(MARKER, " ").encode() for i in range(n)]
        self.surface[self.unknown] = " ⁇ ".encode()
        for byte, i in self.bytes.items():
            self.surface[i] = bytes([byte])
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def normalized(self, text: str) -> str:
        """White space as markers, one in front, as the model's settings have it."""
        if self.normalize is not None:
            return self.normalize(text)
        if self.squeeze:
            text = " ".join(w for w in text.split(" ") if w)
        return (MARKER if self.prefix and text else "") + text.replace(" ", MARKER)

    def viterbi(self, part: str) -> list[int]:
        """The ids of the best path; of equal sums the path whose last piece is longer."""
        text = part.encode()
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        best[0] = 0.0
        scores, prefixes = self.scores, self.trie.prefixes
        for at in range(n):
            here = best[at]
            if here is None:
                continue
            first = text[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            single = False
            for end, piece in prefixes(text, at):
                score = here + scores[piece]
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (at, piece)
                single = single or end == at + width
            if not single:
                end = at + width
                score = here + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (at, self.unknown)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece == self.unknown and self.bytes:
                ids += [self.bytes[b] for b in reversed(text[start:at])]
            else:
                ids.append(piece)
            at = start
        return ids[::-1]

    def _word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit numbers, part by part."""
        out, start = [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or word[i - 1 : i + 1] not in self.pairs:
                part = word[start:i]
                ids = self.parts.get(part)
                if ids is None:
                    if len(self.parts) >= PARTS:
                        self.parts.clear()
                    ids = self.parts[part] = np.asarray(self.viterbi(part), "<u4").tobytes()
                out.append(ids)
                start = i
        if len(self.words) >= PARTS:
            self.words.clear()
        ids = self.words[word] = b"".join(out)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        plain = self.normalized(text)
        if any(f"{c}{MARKER}" in self.pairs for c in set(plain) - {MARKER}):
            return np.frombuffer(self._word(plain), "<u4")
        words, out, empty = self.words, [], ""
        for i, piece in enumerate(plain.split(MARKER)):
            if i == 0:
                if piece:
                    out.append(words.get(piece) or self._word(piece))
            elif piece:
                word = f"{empty}{MARKER}{piece}"
                out.append(words.get(word) or self._word(word))
                empty = ""
            else:
                empty += MARKER  # markers in a row belong to the word after them
        if empty:
            out.append(words.get(empty) or self._word(empty))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: markers are spaces, the one put in front goes, bytes are put together."""
        text = b"".join([self.surface[i] for i in ids])
        if self.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode(errors="replace")


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of every text.

    Columns: the id, ``n_pieces``, ``n_bytes`` (pieces that stand for one byte), ``n_unknown``,
    ``ids_crc32`` (unsigned, over little-endian 32-bit ids), ``round_trip`` (whether decoding gives
    the text back) and, with ``with_ids``, ``ids``.  Null and empty texts have no pieces; repeated
    rows and null ids are answered row by row.  Other columns are ignored, whatever their names.
    """
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", "n_pieces", "n_bytes", "n_unknown", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        is_byte = np.zeros(len(model.scores), bool)
        is_byte[list(model.byte_ids)] = True
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                ids = model.encode(text)
                row = (len(ids), int(is_byte[ids].sum()), int((ids == model.unknown).sum()), zlib.crc32(ids.tobytes()), model.decode(ids.tolist()) == text)
                rows.append((*row, ids.astype("<i4")) if with_ids else row)
            arrays = [pa.array(list(v), t) for v, t in zip(zip(*rows), types)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=names)

    schema = f"id {kind}, n_pieces bigint, n_bytes bigint, n_unknown bigint, ids_crc32 bigint, round_trip boolean"
    return texts.mapInArrow(run, schema + (", ids array<int>" if with_ids else "")).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and the ``text`` of arrays of ids; null gives null, ids of no piece are left out."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        n = len(model.scores)
        for batch in batches:
            texts = [None if ids is None else model.decode(i for i in ids if i is not None and 0 <= i < n) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
