"""Source divergence audit: how far the words of each source are from those of others and of its language.

A first pass counts in how many documents each term stands.  The kept terms, sorted, become minimal
acyclic transducers with lexicographic ordinals; a second pass streams the texts through them and
counts ordinals per source.  Terms are ordinals from there on: vectors of sources are compared in
blocks of ordinals, ties between terms go to the smaller ordinal.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewire.llm.common import saved
from tapewire.llm.ordered import numbered, placed, spans
from tapewire.llm.transducer import Transducer

#: Terms and bytes of terms of one transducer (it has fewer arcs than bytes, 40 bytes each at most).
PART_TERMS, PART_BYTES = 1 << 16, 1 << 20
#: Bytes of transducers that one pass over the texts sends to every task; more take more passes.
WAVE_BYTES = 64 << 20
#: Rows that a task holds before it puts them out, bytes of text that it looks at together.
HELD, WINDOW = 500_000, 2 << 20
#: A place is counted under its group's number and its ordinal in one whole number.
_ORDINAL_BITS = 40
#: Ordinals and sources of a block.
ORDINALS, SOURCES = 512, 64

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
IN_TERM = np.array([bool(TERM.match(bytes([b]))) for b in range(256)])
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _document_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``term`` and in how many documents of the language it stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter[bytes]] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, stands in held.items():
                terms, n = pa.array(list(stands), pa.binary()), pa.array(list(stands.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int64))), terms, n], ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                held[lang].update(set(TERM.findall(text.as_py().lower())))
                if sum(map(len, held.values())) >= HELD:
                    yield from rows()
        yield from rows()

    found = docs.select("lang", "text").mapInArrow(count, "lang string, term binary, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def _machines(sorted_terms: DataFrame) -> DataFrame:
    """Transducers of consecutive terms: ``lang``, ``_at`` and ``_part`` of the first, ``head``, ``machine``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[bytes] = []
        held, lang, first, last = 0, None, 0, 0

        def row() -> pa.RecordBatch:
            machine = pickle.dumps(Transducer(terms), protocol=5)
            return pa.RecordBatch.from_pydict({"lang": [lang], "_at": [first], "_part": [first >> 33], "head": [terms[0][:8]], "machine": [machine]})

        for batch in batches:
            for its, term, at in zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "_at"))):
                if terms and (its != lang or at != last + 1 or len(terms) >= PART_TERMS or held + len(term) > PART_BYTES):
                    yield row()
                    terms, held = [], 0
                if not terms:
                    lang, first = its, at
                terms.append(term)
                held, last = held + len(term), at
        if terms:
            yield row()

    kind = "lang string, _at bigint, _part bigint, head binary, machine binary"
    return sorted_terms.select("lang", "term", "_at").mapInArrow(build, kind)


class _Lexicon:
    """The transducers of one language, each with the ordinal of its first term."""

    def __init__(self, parts: list[tuple[int, bytes, bytes]]) -> None:
        parts = sorted(parts)
        self.offsets = [offset for offset, _, _ in parts]
        self.heads = np.array([int.from_bytes(head.ljust(8, b"\0"), "big") for _, head, _ in parts], np.uint64)
        self.machines = [pickle.loads(machine) for _, _, machine in parts]

    def ordinals(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.machines) == 1:
            found = self.machines[0].ordinals(buffer, starts, ends)
            return np.where(found < 0, -1, found + self.offsets[0])
        head = np.zeros(len(starts), np.uint64)
        for i in range(8):
            at = np.minimum(starts + i, len(buffer) - 1)
            head = head << np.uint64(8) | np.where(starts + i < ends, buffer[at], 0).astype(np.uint64)
        low = np.searchsorted(self.heads, head, "left") - 1
        high = np.searchsorted(self.heads, head, "right") - 1
        out = np.full(len(starts), -1, np.int64)
        for i, (offset, machine) in enumerate(zip(self.offsets, self.machines)):
            own = np.flatnonzero((low <= i) & (i <= high))
            found = machine.ordinals(buffer, starts[own], ends[own])
            known = found >= 0
            out[own[known]] = found[known] + offset
        return out


def _words(batch: pa.BinaryArray | pa.LargeBinaryArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lower-cased bytes, starts and ends of terms, and their rows, for windows of the texts of a batch."""
    wide = np.int64 if pa.types.is_large_binary(batch.type) else np.int32
    offsets = np.frombuffer(batch.buffers()[1], wide)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
    values = batch.buffers()[2]
    whole = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    a, last = int(offsets[0]), int(offsets[-1])
    while a < last:
        b = min(a + WINDOW, last)
        while b < last and IN_TERM[whole[b]]:  # on to the end of a term
            more = np.flatnonzero(~IN_TERM[whole[b : b + WINDOW]])
            b = b + int(more[0]) if len(more) else min(b + WINDOW, last)
        buffer = LOWER[whole[a:b]]
        inside = IN_TERM[buffer]
        edges = np.unique(offsets[(offsets >= a) & (offsets <= b)] - a)
        before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        before[edges[edges < len(inside)]] = False
        after[edges[edges > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield buffer, starts, ends, np.searchsorted(offsets, starts + a, "right") - 1
        a = b


class _Places:
    """How often each key was added: ``keys`` and ``n``, and a bounded number not yet sorted in."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[np.ndarray] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        self.more.append(keys)
        self.waiting += len(keys)
        if self.waiting >= 2 * HELD:
            self.sort_in()

    def sort_in(self) -> None:
        new, n = np.unique(np.concatenate([self.keys[:0], *self.more]), return_counts=True)
        keys, at = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        self.n = np.bincount(at, np.concatenate((self.n, n)), len(keys)).astype(np.int64)
        self.keys, self.more, self.waiting = keys, [], 0

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        self.sort_in()
        found = self.keys, self.n
        self.keys, self.n = self.keys[:0], self.n[:0]
        return found


def _counts(docs: DataFrame, lexicons: dict[str, list[tuple[int, bytes, bytes]]]) -> DataFrame:
    """``lang``, ``source``, ``ordinal``, ``n`` of the terms of ``lexicons``, still to be summed."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {lang: _Lexicon(parts) for lang, parts in sent.value.items()}
        groups: dict[tuple[str, str], int] = {}
        places = _Places()

        def rows() -> pa.RecordBatch:
            keys, n = places.out()
            own, names = pa.array(keys >> _ORDINAL_BITS), list(groups)
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([g[0] for g in names], pa.string()).take(own), "source": pa.array([g[1] for g in names], pa.string()).take(own),
                "ordinal": pa.array(keys & (1 << _ORDINAL_BITS) - 1), "n": pa.array(n),
            })

        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            code = np.array([groups.setdefault(pair, len(groups)) for pair in zip(langs, sources)], np.int64)
            in_lang = {lang: np.array([x == lang for x in langs]) for lang in set(langs) & set(known)}
            for buffer, starts, ends, row in _words(batch.column("text")):
                for lang, mine in in_lang.items():
                    own = np.flatnonzero(mine[row])
                    if len(own):
                        found = known[lang].ordinals(buffer, starts[own], ends[own])
                        hit = found >= 0
                        places.add(code[row[own[hit]]] << _ORDINAL_BITS | found[hit])
                if len(places.keys) >= HELD:
                    yield rows()
        yield rows()

    wanted = docs.where(F.col("lang").isin(list(lexicons)))
    return wanted.select("lang", "source", "text").mapInArrow(recount, "lang string, source string, ordinal bigint, n bigint")


def _waves(machines: DataFrame) -> Iterator[dict[str, list[tuple[int, bytes, bytes]]]]:
    """Transducers by language, WAVE_BYTES of them at a time (or one, if it is larger)."""
    sizes = machines.select("lang", "_at", F.length("machine").alias("bytes")).orderBy("lang", "_at").collect()  # one row per transducer
    waves: list[list] = [[]]
    held = 0
    for row in sizes:
        if waves[-1] and held + row["bytes"] > WAVE_BYTES:
            waves.append([])
            held = 0
        waves[-1].append(row)
        held += row["bytes"]
    for wave in filter(None, waves):
        first, last = wave[0], wave[-1]
        at = F.struct("lang", "_at")
        bounds = [F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["_at"]).cast("bigint").alias("_at")) for r in (first, last)]
        out: dict[str, list[tuple[int, bytes, bytes]]] = {}
        for row in machines.where(at.between(*bounds)).collect():
            out.setdefault(row["lang"], []).append((row["ordinal"], bytes(row["head"]), bytes(row["machine"])))
        yield out


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), in whole numbers."""
    whole = lambda c: c.cast("decimal(19,0)")
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * whole(n + 5)
    return F.lit(1) + F.call_function("div", above, whole(total + 5 * terms))


def _pair_sums(cells: DataFrame, info: DataFrame) -> DataFrame:
    """``lang``, ``x``, ``y``, ``value``: distances of the sources numbered x and y, both ways."""
    blocks = F.greatest(F.ceil(F.col("terms") / ORDINALS), F.lit(1))
    heads = info.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    heads = heads.select("lang", "no", "sources", "terms", "block", F.lit(None).cast("bigint").alias("ordinal"), F.col("base").alias("p"))
    own = cells.select("lang", "no", "sources", "terms", F.expr(f"ordinal div {ORDINALS}").alias("block"), "ordinal", "p")
    mine, all_ = F.expr(f"no div {SOURCES}"), F.expr(f"(sources - 1) div {SOURCES}")
    dealt = heads.unionByName(own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), all_)))
    dealt = dealt.withColumns({"a": F.least(mine, "other"), "b": F.greatest(mine, "other")}).drop("other", "sources")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        block, terms = int(group["block"].iloc[0]), int(group["terms"].iloc[0])
        a, b = int(group["a"].iloc[0]), int(group["b"].iloc[0])
        head = group[group["ordinal"].isna()].sort_values("no")
        cell = group[group["ordinal"].notna()]
        no = head["no"].to_numpy(np.int64)
        width = min(ORDINALS, max(0, terms - block * ORDINALS))
        shares = np.repeat(head["p"].fillna(0).to_numpy(np.int64)[:, None], width, axis=1)
        if len(cell):
            at = cell["ordinal"].to_numpy(np.int64) - block * ORDINALS
            shares[np.searchsorted(no, cell["no"].to_numpy(np.int64)), at] = cell["p"].to_numpy(np.int64)
        left, right = no // SOURCES == a, no // SOURCES == b
        out = []
        for x, values in zip(no[left], shares[left]):
            later = right & (no > x)
            sums = np.abs(shares[later] - values).sum(axis=1)
            out.append(pd.DataFrame({"lang": group["lang"].iloc[0], "x": x, "y": no[later], "value": sums}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "x": [], "y": [], "value": []})

    found = dealt.groupBy("lang", "block", "a", "b").applyInPandas(compare, "lang string, x bigint, y bigint, value bigint")
    found = found.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    return found.unionByName(found.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))


def _ranked(rows: DataFrame, part: str, tie: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), tie)
    return rows.withColumns({"part": F.lit(part), "rank": F.row_number().over(order)})


def audit(
    docs: DataFrame, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Distances of sources and the terms each uses more than its language does.

    Columns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.  Terms are runs of letters
    A to Z, lower-cased, and of characters beyond ASCII; a language keeps those that stand in at
    least ``least`` of its documents.  A group (language and source) gives a kept term the share
    p = 1 + floor(10^9 (n + 5) / (N + 5 V)) of its n places there, N of all kept terms, V kept
    terms.  Part ``pair``: every other source of the language with the sum of the differences of
    their shares over all kept terms (0 without any).  Part ``term``: the ``top`` terms of the
    group whose share is above that in the language, with the difference.  The highest value is
    rank 1, ties in UTF-8 order of the item.

    Null text, language or source counts as empty; a source without terms is compared as well, an
    only source has no pairs; repeated rows count as often as they stand; an empty table gives no
    rows.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = docs.select(clean(lang_col).alias("lang"), clean(source_col).alias("source"), clean(text_col).cast("binary").alias("text"))
    kept = saved(_document_counts(plain).where(F.col("n") >= least).select("lang", "term"), "kept_terms")
    in_order = placed(kept, ["lang"], ["term"], "sorted_terms")
    terms = saved(numbered(in_order, ["lang"], "ordinal").select("lang", "ordinal", F.col("term").cast("string").alias("term")), "numbered_terms")
    starts = spans(in_order, ["lang"])
    machines = saved(
        _machines(in_order).join(starts, ["lang", "_part"])
        .withColumn("ordinal", F.col("_at") - F.col("_first") + F.col("_sum")).drop("_part", "_first", "_sum"),
        "transducers",
    )
    counts = _empty_counts(spark)
    for wave in _waves(machines):  # an ordinal is counted by one wave
        found = _counts(plain, wave).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))
        counts = counts.unionByName(saved(found, "term_counts"))

    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    numbers = Window.partitionBy("lang").orderBy("source")
    info = plain.select("lang", "source").distinct().withColumn("no", (F.row_number().over(numbers) - 1).cast("bigint"))
    info = info.withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    info = info.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "terms"])
    info = info.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    base = F.when(F.col("terms") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")))
    info = saved(info.withColumn("base", base), "sources")  # one row per language and source

    cells = counts.join(info, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    names = info.select("lang", "no", "source")
    pairs = _pair_sums(cells, info)
    pairs = pairs.join(names.withColumnRenamed("no", "x"), ["lang", "x"])
    pairs = pairs.join(names.select("lang", F.col("no").alias("y"), F.col("source").alias("item")), ["lang", "y"])
    pairs = _ranked(pairs, "pair", "item")

    in_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    above = cells.join(in_lang, ["lang", "ordinal"])
    above = above.withColumn("value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("value > 0")
    above = _ranked(above.select("lang", "source", "ordinal", "value"), "term", "ordinal").where(F.col("rank") <= top)
    above = above.join(terms.withColumnRenamed("term", "item"), ["lang", "ordinal"])

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(above.select(*columns))


def _empty_counts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
