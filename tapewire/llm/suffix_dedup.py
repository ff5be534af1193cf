"""Removal of repeated substrings by a distributed merge sort of suffixes.

Wanted are all strings of ``length`` bytes that also start in a document of smaller id.  Not
every suffix is sorted: of the ``seed``-byte strings in each window of ``length`` bytes the one of
least hash is its anchor, so equal windows have the same anchor at the same place, and one
suffix per anchor, cut where its windows end, stands for all of them.

1. Texts are gathered into blocks; copies of a whole text are settled by their digest.
2. Prefix doubling's first step: blocks exchange the hashes of their anchors, sorted and
   difference-coded, and learn which stand in more than one document.  The others' suffixes
   are told apart by their first ``seed`` bytes and need not be sent.
3. Each block sorts its suffixes into runs, one per part of the hashes, and sends them front
   coded.  A part merges its runs with the loser tree of `suffix_merge`.  Equal suffixes have the
   same windows: the least id of each decides.  Among suffixes with the same anchor that differ
   later, windows are compared one by one.
4. Each block takes the spans found out of its texts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm import suffix_merge
from tapewire.llm.common import bucketed, looked_up, partitions_for, saved, taking_over

#: Bytes and documents of a block, bytes of texts looked at together, anchors a part holds.
BLOCK_BYTES, BLOCK_DOCUMENTS, STEP_BYTES, PART_ANCHORS = 8 << 20, 20_000, 1 << 20, 1_000_000
_B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _coded(sorted_values: np.ndarray) -> np.ndarray:
    """Sorted 32-bit numbers as byte planes of their differences, which compress well."""
    steps = np.diff(sorted_values, prepend=np.uint32(0)).astype("<u4")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)


def _decoded(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


# --- anchors ------------------------------------------------------------------------------------


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the ``seed`` bytes at every place, by doubling."""
    level, width, power = data.astype(np.uint64) + np.uint64(1), 1, _B
    total, done = None, 0
    with np.errstate(over="ignore"):
        while True:
            if seed & width:
                if total is None:
                    total = level
                else:
                    n = len(data) - done - width + 1
                    total = total[done * 0 : n] * power + level[done : done + n]
                done += width
            if width * 2 > seed:
                break
            level = level[:-width] * power + level[width:]
            power = power * power
            width *= 2
        total = (total ^ (total >> np.uint64(31))) * _M
    return total ^ (total >> np.uint64(32))


def anchors(texts: list[bytes], length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of ``texts`` end to end: each anchor's place, its first and last window, and its hash.

    Windows do not cross texts.
    """
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    starts = ends - [len(t) for t in texts]
    long = ends - starts >= length
    if not long.any():
        return none, none, none, np.empty(0, np.uint64)
    hashes = seed_hashes(data, seed)
    # The least hash wins, the first of equal ones; place and hash in one number.
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, want = 1, length - seed + 1
    while width * 2 <= want:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < want:
        best = np.minimum(best[: len(best) - (want - width)], best[want - width :])
    valid = np.zeros(len(data) + 1, np.int64)
    valid[starts[long]] += 1
    valid[ends[long] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(valid)[: len(best)] > 0)
    place = (best[windows] & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)))
    last = np.append(first[1:], len(place)) - 1
    return place[first], windows[first], windows[last], hashes[place[first]]


class _Block:
    """The texts of a block that take part, and the anchors in them."""

    def __init__(self, row: dict, length: int, seed: int, parts: int) -> None:
        data = zstandard.ZstdDecompressor().decompress(row["texts"])
        ends = np.cumsum(np.asarray(row["sizes"], np.int64))
        starts = ends - np.asarray(row["sizes"], np.int64)
        self.texts = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        self.ids = row["ids"]
        apart = set(row["copies"] or ())
        self.taken = [i for i in range(len(self.texts)) if i not in apart and self.ids[i] is not None]
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        at = 0
        while at < len(self.taken):
            group, held = [], 0
            while at < len(self.taken) and (not group or held + len(self.texts[self.taken[at]]) <= STEP_BYTES):
                group.append(self.taken[at])
                held += len(self.texts[group[-1]])
                at += 1
            texts = [self.texts[i] for i in group]
            place, a, b, hashes = anchors(texts, length, seed)
            ends = np.cumsum([len(t) for t in texts])
            of = np.searchsorted(ends, place, side="right")
            begin = (ends - [len(t) for t in texts])[of]
            for kept, new in zip(found, (np.asarray(group)[of], place - begin, a - begin, b - begin, hashes)):
                kept.append(new)
        none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
        self.doc, self.place, self.first, self.last, hashes = (np.concatenate(f) if f else e for f, e in zip(found, none))
        self.part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        self.key = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def by_part(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each part and the numbers of its anchors."""
        order = np.argsort(self.part, kind="stable")
        parts, begins = np.unique(self.part[order], return_index=True)
        yield from zip(parts.tolist(), np.split(order, begins[1:]))


# --- the four steps -------------------------------------------------------------------------------


def _blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """``block``, ``ids``, ``sizes``, ``digests`` and the compressed ``texts`` of bounded blocks."""
    names = ["block", "ids", "sizes", "digests", "texts"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list[bytes] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in held]
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(held))
            row = [number, list(ids), [len(t) for t in held], digests, data]
            number += 1
            ids.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        size = 0
        for batch in batches:
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                ids.append(i)
                held.append(text.as_py().encode())
                size += len(held[-1])
                if size >= block_bytes or len(ids) >= BLOCK_DOCUMENTS:
                    yield block()
                    size = 0
        if ids:
            yield block()

    return texts.mapInArrow(run, "block bigint, ids array<bigint>, sizes array<int>, digests array<binary>, texts binary")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    taking_over("suffix_dedup")
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _shared_flags(blocks: DataFrame, length: int, seed: int, parts: int) -> DataFrame:
    """``block``, ``part`` and, for the sorted anchor hashes of the block, which to send."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row, length, seed, parts)
            number = np.unique(np.asarray([block.ids[i] for i in block.taken] or [0]), return_inverse=True)[1]
            name = np.zeros(len(block.texts), np.int64)
            name[block.taken] = number[: len(block.taken)]
            out = []
            for part, own in block.by_part():
                keys, names = block.key[own], name[block.doc[own]]
                order = np.lexsort((names, keys))
                keys, names = keys[order], names[order]
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                last = np.append(first[1:], len(keys)) - 1
                out.append((part, _pack(_coded(keys[first]), np.packbits(names[first] != names[last]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.int64()), pa.array([row["block"]] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())],
                names=["part", "block", "run"],
            )

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        keys, several = [], []
        for blob in group["run"]:
            planes, bits = _unpack(blob)
            keys.append(_decoded(planes))
            several.append(np.unpackbits(bits, count=len(keys[-1])).astype(bool))
        everything = np.sort(np.concatenate(keys))
        twice = everything[1:][everything[1:] == everything[:-1]]
        many = np.unique(np.concatenate([twice, *(k[s] for k, s in zip(keys, several))]))
        flags = [np.packbits(np.isin(k, many, assume_unique=True)).tobytes() for k in keys]
        return pd.DataFrame({"block": group["block"], "part": group["part"], "flags": flags})

    sent = blocks.mapInArrow(runs, "part bigint, block bigint, run binary")
    return sent.groupBy("part").applyInPandas(shared, "block bigint, part bigint, flags binary")


def _suffix_runs(blocks: DataFrame, length: int, seed: int, parts: int) -> DataFrame:
    """Per part and block the front-coded run of suffixes, and where each stands."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            flags = {f["part"]: f["flags"] for f in row["flags"] or ()}
            block = _Block(row, length, seed, parts)
            out = []
            for part, own in block.by_part():
                keys, where = np.unique(block.key[own], return_inverse=True)
                own = own[np.unpackbits(np.frombuffer(flags[part], np.uint8), count=len(keys)).astype(bool)[where]]
                if not len(own):
                    continue
                held: dict[bytes, list[int]] = {}
                for n, d, p, a, b in zip(own.tolist(), block.doc[own].tolist(), block.place[own].tolist(), block.first[own].tolist(), (block.last[own] + length).tolist()):
                    text = block.texts[d]
                    # From the anchor to the end of its windows, then back to their beginning.
                    held.setdefault(text[p:b] + text[a:p][::-1] + (b - p).to_bytes(2, "big"), []).append(n)
                strings = sorted(held)
                places = np.concatenate([held[s] for s in strings])
                counts = np.asarray([len(held[s]) for s in strings], "<u4")
                ids = np.asarray([block.ids[d] for d in block.doc[places].tolist()], "<i8")
                coded = suffix_merge.front_code(strings)
                out.append((part, _pack(*coded, counts, ids, block.doc[places].astype("<u4"), block.first[places].astype("<u4"))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.int64()), pa.array([row["block"]] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())],
                names=["part", "block", "run"],
            )

    return blocks.mapInArrow(runs, "part bigint, block bigint, run binary")


def _windows(strings: list[bytes], least: list[int], length: int) -> list[np.ndarray]:
    """For suffixes of one anchor: the least id of every window of each."""
    known: dict[bytes, int] = {}
    cut = []
    for s, i in zip(strings, least):
        right = int.from_bytes(s[-2:], "big")
        text = s[right:-2][::-1] + s[:right]
        cut.append([text[j : j + length] for j in range(len(text) - length + 1)])
        for w in cut[-1]:
            if known.get(w, i) >= i:
                known[w] = i
    return [np.asarray([known[w] for w in windows]) for windows in cut]


def _found(group: pd.DataFrame, length: int, seed: int) -> pd.DataFrame:
    """Merges the runs of one part; per block the spans that stand in a document of smaller id."""
    loaded = [_unpack(blob) for blob in group["run"]]
    smallest = [np.minimum.reduceat(x[4], np.concatenate([[0], np.cumsum(x[3][:-1], dtype=np.int64)])).tolist() for x in loaded]
    of: list[list[int]] = [[] for _ in loaded]  # of each run: the number of each string among all
    least: list[int] = []  # of each string: its least id
    windows: list[int] = []  # and how many windows it stands for
    several: dict[int, np.ndarray] = {}  # least ids by window, where another suffix of the anchor differs later
    strings: list[bytes] = []  # of the current anchor

    def settle() -> None:
        if len(strings) > 1:
            first = len(least) - len(strings)
            for k, values in enumerate(_windows(strings, least[first:], length)):
                if values.min() < least[first + k]:
                    several[first + k] = values
        strings.clear()

    for share, string, run in suffix_merge.merge([suffix_merge.decode(*x[:3]) for x in loaded]):
        low = smallest[run][len(of[run])]
        if share == len(string) and strings and share == len(strings[-1]):
            if low < least[-1]:
                least[-1] = low
        else:
            if share < seed:
                settle()
            strings.append(string)
            least.append(low)
            windows.append(len(string) - 1 - length)
        of[run].append(len(least) - 1)
    settle()
    limits, spread = np.asarray(least, np.int64), np.asarray(windows, np.int64)
    for k, values in several.items():
        limits[k] = values.max()  # documents beyond have all windows elsewhere
    partly = np.zeros(len(least), bool)
    partly[list(several)] = True
    out = []
    for block, x, own in zip(group["block"], loaded, of):
        number = np.repeat(np.asarray(own, np.int64), x[3])
        ids, docs, begins = x[4], x[5].astype(np.int64), x[6].astype(np.int64)
        full = ids > limits[number]
        spans = [(docs[full], begins[full], begins[full] + spread[number[full]] - 1 + length)]
        for k in np.flatnonzero(~full & partly[number]).tolist():
            hit = np.flatnonzero(several[int(number[k])] < ids[k])
            if len(hit):
                edge = np.flatnonzero(np.diff(hit) > 1)
                a, b = hit[np.append(0, edge + 1)], hit[np.append(edge, len(hit) - 1)]
                spans.append((np.repeat(docs[k], len(a)), begins[k] + a, begins[k] + b + length))
        merged = [np.concatenate(c).astype("<u4") for c in zip(*spans)]
        if len(merged[0]):
            out.append((block, _pack(*merged)))
    return pd.DataFrame(out, columns=["block", "spans"]).astype({"block": "int64"})


def removed_spans(docs: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """The union of spans of each document, as maximal runs."""
    out: dict[int, list[tuple[int, int]]] = {}
    order = np.lexsort((begins, docs))
    for d, a, b in zip(docs[order].tolist(), begins[order].tolist(), ends[order].tolist()):
        runs = out.setdefault(d, [])
        if runs and a <= runs[-1][1]:
            if b > runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
        else:
            runs.append((a, b))
    return out


def _results(blocks: DataFrame, length: int, with_text: bool) -> DataFrame:
    names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text", "text_sha256"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string(), span, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data = zstandard.ZstdDecompressor().decompress(row["texts"])
            copies = set(row["copies"] or ())
            found = [_unpack(blob) for blob in row["spans"] or ()]
            cut = removed_spans(*(np.concatenate(c) for c in zip(*found))) if found else {}
            out, at = [], 0
            for i, (doc_id, size) in enumerate(zip(row["ids"], row["sizes"])):
                text = data[at : at + size]
                at += size
                runs = ([(0, size)] if size >= length else []) if i in copies else cut.get(i, [])
                kept, last = [], 0
                for a, b in runs:
                    kept.append(text[last:a])
                    last = b
                rest = b"".join([*kept, text[last:]])
                out.append((
                    doc_id, size, size - len(rest), len(runs), hashlib.sha256(rest).hexdigest(),
                    [{"start": a, "end": b} for a, b in runs], rest.decode(errors="ignore") if with_text else None,
                    hashlib.sha256(text).hexdigest() if with_text else None,
                ))
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out), types)], names=names)

    return blocks.mapInArrow(
        run,
        "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "spans array<struct<start:bigint,end:bigint>>, kept_text string, text_sha256 string",
    )


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    seed: int = 16,
    with_text: bool = False,
    block_bytes: int = BLOCK_BYTES,
    part_anchors: int = PART_ANCHORS,
) -> DataFrame:
    """What is left of each text without the ``length``-byte strings of documents of smaller id.

    Texts are UTF-8 bytes; each byte is removed that is covered by a string of ``length`` bytes
    which also starts in the input text of a document of smaller id.  Columns: the id, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``, ``spans`` (in bytes) and, with
    ``with_text``, ``kept_text``, without the fragments of characters that a cut leaves, and
    ``text_sha256`` of the input text, which tells rows of one id apart.  Null text is empty; texts shorter than ``length`` lose nothing.  Rows that repeat an id are not smaller
    than each other.  A row without an id is left as it is and removes nothing elsewhere.  Ids are
    integers.  Other columns are ignored, whatever their names.
    """
    if not 8 <= seed <= length:
        raise ValueError("seed must be 8 to length")
    texts = df.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = partitions_for(total, 3 * block_bytes)
    parts = partitions_for(total * 2 // (length - seed + 2), part_anchors)
    blocks = bucketed(_blocks(texts, block_bytes), "blocks", "block", buckets)

    held = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "doc"))
    held = held.select("block", "place", F.col("doc.ids").alias("_id"), F.when(F.col("doc.ids").isNotNull(), F.col("doc.digests")).alias("digest"))
    same = held.where("digest is not null").groupBy("digest").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("n"))
    same = saved(same.where("n > 1"), "copies")
    copies = looked_up(held, "digest", same, "n", ["least"]).where("_id > least")
    copies = saved(copies.groupBy("block").agg(F.collect_list("place").alias("copies")), "copies")  # a block's at most
    blocks = blocks.join(copies, "block", "left")

    flags = _shared_flags(blocks.select("block", "ids", "sizes", "texts", "copies"), length, seed, parts)
    flags = saved(flags, "flags").groupBy("block").agg(F.collect_list(F.struct("part", "flags")).alias("flags"))  # one a part
    runs = _suffix_runs(blocks.join(flags, "block", "left").select("block", "ids", "sizes", "texts", "copies", "flags"), length, seed, parts)
    found = runs.groupBy("part").applyInPandas(lambda group: _found(group, length, seed), "block bigint, spans binary")
    found = saved(found, "spans").groupBy("block").agg(F.collect_list("spans").alias("spans"))  # one a part
    out = _results(blocks.join(found, "block", "left").select("block", "ids", "sizes", "texts", "copies", "spans"), length, with_text)
    out = out.withColumnRenamed("_id", id_col)
    return out if with_text else out.drop("kept_text", "text_sha256")
