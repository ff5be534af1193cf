"""Near-duplicate documents: MinHash, banding, verification, components.

Documents of the same shingle set become one class at once.  Classes that agree in a band of
their signature share a bucket.  Then, twice: each bucket names one member its centre, each
class goes to the first of its buckets' centres, and what met there is compared on the full
sets, in blocks of bounded size that give out only the links that join components.  Buckets
within one component are done.  Of the others the signatures are compared in blocks, which give out
only the members that are like one of another component they never met; those are compared on
their full sets, again in blocks.  The signatures lose less than one link in a million.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.common import looked_up, saved, taking_over
from tapewire.llm.components import directed, stars

#: 42 bands of 5 minima: a pair of similarity 0.8 shares no bucket once in ten million.
BANDS, ROWS = 42, 5
#: A pair goes on if its signatures agree at the least similarity less the slack: at 0.8 one in a
#: million does not (binomial).
SLACK = 0.15
#: Times that classes meet at a centre, and shingles of a block of them.
ROUNDS, BLOCK_SHINGLES = 2, 1_500_000
#: Signatures of a part; a block holds two.
BLOCK_CLASSES = 2048
#: Words a task remembers.
WORDS = 300_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def remembering_words() -> None:
    """Said where a task begins that takes `shingles`."""
    taking_over("shingles", _words.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that leaves no trace of sums."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """The distinct ``width``-word shingles as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space, ASCII capitals lowered.  Fewer words than
    ``width`` are one shingle; no words, none.
    """
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width, short = min(width, len(words)), len(words) < width
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(total) + k])
    if short:  # a short sequence never equals a shingle of full width
        total = _mixed(total + np.uint64(width))
    return np.unique(total)


@functools.cache
def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``n`` multiply-shift hash functions."""
    rng = np.random.default_rng(20240101)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of ``n`` universal hash functions over a set, its lower 16 bits."""
    a, b = _universal(n)
    best = np.full(n, 0xFFFFFFFF, np.uint64)
    step = max(1, (1 << 17) // n)  # a block stays in the processor's cache
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None] * a
        part += b
        part >>= np.uint64(32)
        np.minimum(best, part.min(axis=0), out=best)
    return best.astype("<u2")


def _described(df: DataFrame, width: int) -> DataFrame:
    """Per row: the id, size and digest of its shingle set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering_words()
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch.column("_text"):
                hashes = shingles(text.as_py(), width)
                sizes.append(len(hashes))
                digests.append(_digest(hashes))
                signatures.append(signature(hashes, BANDS * ROWS).tobytes() if len(hashes) else None)
            arrays = [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "n_shingles", "digest", "signature"])

    return df.mapInArrow(run, "_id bigint, n_shingles bigint, digest binary, signature binary")


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sets(df: DataFrame, width: int) -> DataFrame:
    """The shingle sets as binary, eight bytes a shingle, with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembering_words()
        for batch in batches:
            sets = [shingles(text.as_py(), width).astype("<u8") for text in batch.column("_text")]
            arrays = [batch.column("_id"), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "digest", "shingles"])

    return df.mapInArrow(run, "node bigint, digest binary, shingles binary")


def _drawn(member: str, salt: int) -> Column:
    """A member's place in an order that changes with ``salt``; the first is the centre."""
    return F.struct(F.xxhash64(F.col(member), F.lit(salt)).alias("order"), F.col(member).alias("member"))


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """Groups of documents whose ``width``-word shingle sets are linked by Jaccard ``percent``.

    Columns: the id, ``n_shingles``, ``component_id`` (the smallest id reachable over links, its own
    included), ``kept`` (whether that is its own id).  Null, empty and blank texts have no
    shingles and are linked with nothing.  Rows that repeat an id with other texts are linked by the
    id, and what is linked to either is in their group; a row without an id is kept, linked with
    nothing and has a null component.  Links are found over the banded signature and confirmed on
    the full sets: of pairs at 0.8 one in ten million shares no band, and of those not compared on
    full sets at once less than one in a million is missed.
    Ids are integers.  Other columns are ignored, whatever their names.
    """
    texts = df.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    seen = saved(_described(texts, width), "signatures")
    n, size = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    named = seen.where("_id is not null and digest is not null")
    # One row per class of equal sets, known by its smallest id; an id may have several texts, so
    # a class is also numbered.
    classes = named.groupBy("digest").agg(
        F.min("_id").alias("node"), F.count(F.lit(1)).alias("n"), F.min_by("signature", "_id").alias("signature")
    )
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "classes", n)
    heads = classes.select("cls", "node", "digest", "signature")
    found = _linked(heads, _id_links(named, heads), texts, width, percent, n, size)
    top = classes.join(found, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component_id"))
    out = looked_up(seen.withColumn("digest", F.when(F.col("_id").isNotNull(), F.col("digest"))), "digest", top, "n", ["component_id"])
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )


def _id_links(named: DataFrame, heads: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` of ids that stand beside several texts to the classes of all of them."""
    several = named.groupBy("_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last")
    several = saved(several.select("_id"), "repeated_ids")
    if several.isEmpty():
        return named.sparkSession.createDataFrame([], "u bigint, v bigint")
    rows = named.select("_id", "digest").join(several, "_id").distinct()
    return rows.join(heads.select("digest", "node"), "digest").select(F.col("_id").alias("u"), F.col("node").alias("v")).where("u <> v")


def _joining(percent: int):
    """A function of one block: links between components, as few as join what belongs together."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        nodes, components_ = block["node"].to_numpy(), block["component"].to_numpy()
        sets = [np.frombuffer(b, "<u8") for b in block["shingles"]]
        sizes = np.asarray([len(s) for s in sets])
        names, values = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        _, own, count = np.unique(components_, return_inverse=True, return_counts=True)
        links = []
        marked = np.zeros(len(names), np.int32)
        # Of two components one is not the largest: its members are held against all others.
        for k in np.flatnonzero(own != count.argmax()).tolist():
            mine = values[starts[k] : starts[k] + sizes[k]]
            marked[mine] = 1
            both = np.add.reduceat(marked[values], starts)
            marked[mine] = 0
            near = (100 * both >= percent * (sizes[k] + sizes - both)) & (own != own[k])
            for o in np.unique(own[near]).tolist():
                links.append((nodes[k], nodes[np.flatnonzero(near & (own == o))[0]]))
                own[own == o] = own[k]
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


def _met(homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the classes of one home, compared in blocks.

    A home of many shingles is dealt to several parts, and every two parts form a block.
    """
    known = homes.join(sets.select("cls", F.length("shingles").alias("bytes")), "cls")
    parts = known.groupBy("home").agg(
        F.ceil(F.sum("bytes") / (8 * BLOCK_SHINGLES)).cast("int").alias("parts"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    blocks = _blocks(homes.join(parts.where("low <> high").select("home", "parts"), "home"))
    return blocks.join(sets, "cls").groupBy("home", "a", "b").applyInPandas(_joining(percent), "u bigint, v bigint")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt to the ``parts`` of their home, in every block ``a``, ``b`` of two parts."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ends = {"a": F.least("part", "other"), "b": F.greatest("part", "other")}
    return dealt.withColumns(ends).drop("other", "parts")


def _open(members: DataFrame, heads: DataFrame, component: DataFrame | None, n: int) -> DataFrame:
    """The rows of buckets that hold more than one component, with each member's component."""
    if component is not None:
        now = heads.select("cls", "node").join(component, "node").select("cls", F.col("component").alias("now"))
        members = members.join(now, "cls", "left").select("bucket", "cls", F.coalesce("now", "component").alias("component"))
    several = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return saved(members.join(several.where("low <> high").select("bucket"), "bucket"), "buckets", BANDS * n)


def _linked(heads: DataFrame, links: DataFrame, texts: DataFrame, width: int, percent: int, n: int, size: int) -> DataFrame:
    """The components of ``links`` and of confirmed ones that, together, connect all classes that are
    connected; ``n`` is the number of documents, ``size`` that of their shingles."""
    size = 4 * ROWS  # hex digits of a band
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("hexed"), b * size + 1, F.lit(size))),
    )
    rows = heads.select("cls", F.col("node").alias("component"), F.hex("signature").alias("hexed"))
    members = _open(rows.select(F.explode(keys).alias("bucket"), "cls", "component"), heads, None, n)
    wanted = members.select("cls").distinct().join(heads.select("cls", "node", "digest"), "cls")
    sets = _sets(texts.join(wanted.select(F.col("node").alias("_id")).distinct().hint("shuffle_hash"), "_id", "left_semi"), width)
    sets = sets.join(wanted, ["node", "digest"]).select("cls", "node", "shingles").dropDuplicates(["cls"])
    sets = saved(sets, "shingle_sets", size // 4)  # 3 MB a file

    homes: list[DataFrame] = []
    for turn in range(ROUNDS):
        centre = members.groupBy("bucket").agg(F.min(_drawn("cls", turn)).alias("centre"))
        first = members.join(centre, "bucket").groupBy("cls", "component").agg(F.min("centre").alias("centre"))
        homes.append(saved(first.select("cls", "component", F.col("centre.member").alias("home")), "homes", n))
        found = stars(directed(links.union(_met(homes[-1], sets, percent)), n))
        members = _open(members, heads, found, n)
        if members.isEmpty():
            return found
        links = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    alike = saved(_alike(members, homes, heads, percent / 100 - SLACK, n), "alike", n)
    return stars(directed(links.union(_met(alike, sets, percent)), n))


def _alike(members: DataFrame, homes: list[DataFrame], heads: DataFrame, least: float, n: int) -> DataFrame:
    """The members of a bucket (``home``) that share at least ``least`` of their signature with one
    of another component there that they never met."""
    met = [f"home{turn}" for turn in range(len(homes))]
    for name, home in zip(met, homes):
        members = members.join(home.select("cls", F.col("home").alias(name)), "cls", "left")
    members = saved(members.withColumnRenamed("bucket", "home"), "buckets", BANDS * n)
    parts = members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("parts"))
    blocks = _blocks(members.join(parts, "home")).join(heads.select("cls", "signature"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the block in which the last batch ended
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = held.combine_chunks()
            key = np.stack([held[c].to_numpy() for c in ("home", "a", "b")])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist() if held.num_rows else [0]
            for at, to in zip(starts, starts[1:]):
                yield _like_ones(held.slice(at, to - at), met, least)
            held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield _like_ones(held, met, least)

    sorted_ = blocks.repartition("home", "a", "b").sortWithinPartitions("home", "a", "b")
    return sorted_.mapInArrow(run, "home bigint, cls bigint, component bigint").distinct()


def _like_ones(block: pa.Table, met: list[str], least: float) -> pa.RecordBatch:
    """The rows of a block that are like another one they never met; parts meet themselves in blocks of their own."""
    apart = [block[c].to_numpy() for c in met]
    part = block["part"].to_numpy() if block["a"][0].as_py() != block["b"][0].as_py() else None
    signatures = np.frombuffer(b"".join(block["signature"].to_pylist()), "<u2").reshape(block.num_rows, -1)
    _, own, count = np.unique(block["component"].to_numpy(), return_inverse=True, return_counts=True)
    found = np.zeros(block.num_rows, bool)
    # Of two components one is not the largest: its members are held against all others.
    for k in np.flatnonzero(own != count.argmax()).tolist():
        strange = own != own[k]
        for values in [*apart, part] if part is not None else apart:
            strange &= values != values[k]
        others = np.flatnonzero(strange)
        others = others[(signatures[others] == signatures[k]).mean(axis=1) >= least]
        if len(others):
            found[k] = found[others] = True
    kept = block.select(["home", "cls", "component"]).filter(pa.array(found)).combine_chunks()
    return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], kept.schema)
