"""Near-duplicate embeddings: vectors meet in spherical-cap filters and are compared there.

Equal vectors are one class.  Every class enters all filters of random product codes that it reaches
(`cap_filters`); classes that share a filter are compared as matrices inside the filter, in blocks
where it holds many, and only counts and the least id of each linked group leave it.  A pair that
shares several filters is counted in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm import cap_filters
from tapewire.llm.common import looked_up, saved
from tapewire.llm.components import components

#: Classes of a block of a filter, rows decoded together.
BLOCK, ROWS = 1024, 256


def _usable(vector: Column) -> Column:
    """Null unless all components are finite numbers, not all zero."""
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    return F.when(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), vector)


def _digest(vector: Column) -> Column:
    """Equal vectors have equal digests (0 and -0 are equal)."""
    return F.unhex(F.sha2(F.concat_ws(",", F.transform(vector, lambda x: (x + F.lit(0).cast("float")).cast("string"))), 256))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Of vectors scaled by a power of two where their squares would leave the range of a double."""
    return np.sqrt((vectors * vectors).sum(axis=1))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors, each with a largest component between a half and one; powers of two change no cosine."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _decoded(classes: DataFrame, plans: dict[int, cap_filters.Plan]) -> DataFrame:
    """The classes with their ``filters``, ascending."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("width"))
            for width in np.unique(widths).tolist():
                own = batch.filter(pa.array(widths == width))
                for at in range(0, len(own), ROWS):
                    some = own.slice(at, ROWS)
                    vectors = _scaled(_matrix(some.column("v"), len(some)))
                    rows, names = cap_filters.filters(plans[width], vectors / _lengths(vectors)[:, None])
                    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(some)))))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names))
                    yield pa.RecordBatch.from_arrays([*some.columns, lists], [*some.schema.names, "filters"])

    return classes.mapInArrow(decode, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in classes.schema)}, filters array<bigint>")


def _shared_before(filters: list[np.ndarray], name: int) -> np.ndarray:
    """Which pairs of rows share a filter before ``name``."""
    row = np.repeat(np.arange(len(filters)), [np.searchsorted(f, name) for f in filters])
    earlier = np.concatenate([f[: np.searchsorted(f, name)] for f in filters])
    names, column, count = np.unique(earlier, return_inverse=True, return_counts=True)
    met = np.zeros((len(filters), len(filters)), bool)
    often = np.flatnonzero(count > 1)
    place = np.full(len(names), -1)
    place[often] = np.arange(len(often))
    at = place[column]
    for first in range(0, len(often), 4096):
        some = (at >= first) & (at < first + 4096)
        held = np.zeros((len(filters), min(4096, len(often) - first)), np.float32)
        held[row[some], at[some] - first] = 1
        met |= held @ held.T > 0
    return met


def _least_linked(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least of ``ids`` in its connected group."""
    low = ids.copy()
    while True:
        last = low
        low = np.minimum(last, np.where(links, last[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (low == last).all():
            return low


def _compared(group: pa.RecordBatch, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of a block that have links met here first, how many vectors they link, and their least id."""
    first, second, name = (group.column(c)[0].as_py() for c in ("first", "second", "filter"))
    vectors = _scaled(_matrix(group.column("v"), len(group)))
    lengths = _lengths(vectors)
    links = vectors @ vectors.T / (lengths[:, None] * lengths) >= cosine
    np.fill_diagonal(links, False)
    if first != second:
        side = np.asarray(group.column("own"))
        links &= side[:, None] != side
    rows = np.flatnonzero(links.any(axis=1))
    if not len(rows):
        return None
    links = links[np.ix_(rows, rows)]
    lists = group.column("filters").take(pa.array(rows))
    values, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]
    links &= ~_shared_before(np.split(values, ends), name)
    own = links.any(axis=1)
    rows, links = rows[own], links[np.ix_(own, own)]
    if not len(rows):
        return None
    sizes, ids = (np.asarray(group.column(c))[rows] for c in ("size", "rep"))
    return rows, links @ sizes, _least_linked(links, ids)


def _links(dealt: DataFrame, cosine: float) -> DataFrame:
    """``key``, ``n`` (linked vectors), ``rep``, ``low`` for each block in which a class has links."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one block after the other; they lie next to each other."""
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            marks = np.column_stack([np.asarray(batch.column(c)) for c in ("width", "filter", "first", "second")])
            starts = np.flatnonzero(np.concatenate(([True], (marks[1:] != marks[:-1]).any(axis=1))))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    yield batch.slice(a, b - a)
            held = batch.slice(int(starts[-1])) if len(starts) else None
        if held is not None and len(held) > 1:
            yield held

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(b for b in batches if len(b)):
            found = _compared(group, cosine)
            if found:
                rows, n, low = found
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([group.column("key").take(at), pa.array(n), group.column("rep").take(at), pa.array(low)], ["key", "n", "rep", "low"])

    by = ["width", "filter", "first", "second"]
    columns = [*by, "own", "key", "rep", "size", "v", "filters"]
    in_order = dealt.select(*columns).repartition(*by).sortWithinPartitions(*by)
    return in_order.mapInArrow(compare, "key binary, n bigint, rep bigint, low bigint")


def _dealt(hits: DataFrame) -> DataFrame:
    """One row per class, filter and pair of its blocks (``first`` <= ``second``, ``own`` among them)."""
    met = hits.withColumn("filter", F.explode("filters"))
    sizes = met.groupBy("width", "filter").agg(F.count(F.lit(1)).alias("n"))
    shared = saved(sizes.where("n > 1").select("width", "filter", F.ceil(F.col("n") / BLOCK).alias("blocks")), "filter_blocks")
    met = met.join(shared, ["width", "filter"])
    met = met.withColumn("own", F.pmod(F.xxhash64("key", "filter"), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return met.withColumns({"first": F.least("own", "other"), "second": F.greatest("own", "other")})


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links between vectors whose cosine is ``cosine`` or more, and their connected components.

    One row per vector: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id``
    (smallest id reachable, its own included), ``kept`` (it is the smallest).  Cosines are taken in
    double precision; no link is below the threshold, and of those at it the filters find all but
    some in a thousand, of closer ones more.

    Vectors that are null or empty, that hold a null or a number that is not finite, or are all zero
    link with nothing, as do those of different lengths; vectors without an id take no part and get
    a null component.  Rows that repeat a vector are vectors of their own; rows with one id are one
    node and share what each of them links.  Ids are integers.  Other columns are ignored, whatever
    their names.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), _usable(F.col(vector_col)).alias("v"))
    rows = rows.withColumn("key", F.when(F.col("vec_id").isNotNull() & F.col("v").isNotNull(), _digest(F.col("v"))))
    usable = rows.where(F.col("key").isNotNull())
    alike = usable.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    classes = saved(alike.withColumn("width", F.size("v")), "vector_classes")
    widths = classes.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per length of vectors
    plans = {r["width"]: cap_filters.Plan.of(r["n"], r["width"], cosine) for r in widths}

    hits = saved(_decoded(classes, plans), "vector_filters")
    found = saved(_links(_dealt(hits), cosine), "vector_links")

    several = rows.select("vec_id", "key").where("vec_id IS NOT NULL").groupBy("vec_id")
    several = several.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("keyed"), F.count(F.lit(1)).alias("n"))
    several = several.where("low <> high OR keyed BETWEEN 1 AND n - 1").select("vec_id")
    same_id = usable.join(several, "vec_id").select("vec_id", "key").distinct().join(classes.select("key", "rep"), "key")
    edges = found.select(F.col("rep").alias("u"), F.col("low").alias("v")).unionByName(same_id.select(F.col("vec_id").alias("u"), F.col("rep").alias("v")))
    reached = saved(components(edges), "vector_components")

    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    settled = classes.select("key", "size", "rep").join(counts, "key", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    settled = settled.select(
        "key", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = looked_up(usable.select("vec_id", "key"), "key", settled, "size", ["n_links", "component_id"])
    alone = rows.where(F.col("key").isNull()).join(reached.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    alone = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
