"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Vectors are dealt to shards of bounded size, each shard becomes one ball tree, queries become
blocks of bounded size.  A block is first searched in one shard, its home; the k-th score found
there is the least that a node of any other shard must be able to reach.  In a tree nodes are
visited by the upper bound of their inner products (that of the centre plus the query's length
times the radius), and the search ends at the first bound below the current k-th score.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.common import partitions_for, saved

#: Vectors of a shard and of a leaf, queries of a block, blocks that one task searches in a shard.
SHARD, LEAF, BLOCK, BLOCKS = 8192, 64, 256, 64
_LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as double; null unless all are finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


class BallTree:
    """Nested balls around the rows of ``vectors``; node 2i+1 and 2i+2 halve node i."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.arange(len(ids))
        spans = [(0, len(ids))]
        centres, radii, children = [], [], []
        at = 0
        while at < len(spans):
            a, b = spans[at]
            own = vectors[order[a:b]]
            centre = own.mean(axis=0) if len(own) else np.zeros(vectors.shape[1])
            away = ((own - centre) ** 2).sum(axis=1)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max(initial=0))))
            if b - a > LEAF and radii[-1] > 0:
                # Two far points draw the axis; the middle of the places along it is the cut.
                far = own[int(away.argmax())]
                other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own @ (far - other), middle)]
                children.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            else:
                children.append(0)
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.spans, self.children = spans, children
        self.centres, self.radii = np.asarray(centres), np.asarray(radii)
        self.largest = float(np.abs(vectors).max(initial=0))

    def search(self, queries: np.ndarray, own: list[int], k: int, floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """For each query up to ``k`` pairs ``(score, id)``, best first, ties to the smaller id.

        Ids equal to a query's ``own`` are left out, as is what cannot reach its floor.
        """
        lengths = np.sqrt((queries**2).sum(axis=1))
        bounds = queries @ self.centres.T + lengths[:, None] * self.radii
        bounds += 1 + 1e-9 * np.abs(bounds)  # more than rounding can take away
        size = float(np.abs(queries).max(initial=0)) * self.largest * max(1, queries.shape[1])
        exact = size < 1 << 53
        out = []
        for q, (bound, me, floor) in enumerate(zip(bounds, own, floors)):
            found: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
            least = -float("inf") if floor is None else floor
            nodes = [(-bound[0], 0)]
            while nodes:
                best, node = heapq.heappop(nodes)
                if -best < least:
                    break
                child = self.children[node]
                if child:
                    for c in (child, child + 1):
                        if bound[c] >= least:
                            heapq.heappush(nodes, (-bound[c], c))
                    continue
                a, b = self.spans[node]
                if exact:
                    scores = self.vectors[a:b] @ queries[q]
                    near = np.flatnonzero(scores >= least)
                    pairs = [(int(scores[i]), -int(self.ids[a + i])) for i in near.tolist()]
                else:  # beyond the exact doubles: whole numbers of any size
                    point = [int(x) for x in queries[q]]
                    pairs = [(sum(int(x) * y for x, y in zip(v, point)), -int(i)) for v, i in zip(self.vectors[a:b], self.ids[a:b])]
                    pairs = [p for p in pairs if p[0] >= least]
                for pair in pairs:
                    if pair[1] == -me:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, pair)
                    elif pair > found[0]:
                        heapq.heapreplace(found, pair)
                if len(found) == k:
                    least = max(least, found[0][0])
            out.append([(s, -i) for s, i in sorted(found, reverse=True)])
        return out


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    return np.asarray(values.tolist(), float).reshape(len(values), width)


def _trees(vectors: DataFrame, shards: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        width, shard = int(group["width"].iloc[0]), int(group["shard"].iloc[0])
        group = group.sort_values("id", kind="stable")
        tree = BallTree(group["id"].to_numpy(np.int64), _matrix(group["v"], width))
        return pd.DataFrame({"width": [width], "shard": [shard], "tree": [pickle.dumps(tree, protocol=5)]})

    dealt = vectors.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("width", "shard").applyInPandas(build, "width int, shard int, tree binary")


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    def gather(group: pd.DataFrame) -> pd.DataFrame:
        width, block = int(group["width"].iloc[0]), int(group["block"].iloc[0])
        group = group.sort_values("id", kind="stable")
        held = pickle.dumps((group["id"].tolist(), _matrix(group["v"], width)), protocol=5)
        return pd.DataFrame({"width": [width], "block": [block], "held": [held]})

    dealt = queries.select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("width", "block").applyInPandas(gather, "width int, block int, held binary")


def _search(trees: DataFrame, blocks: DataFrame, k: int, chunks: int) -> DataFrame:
    """``width``, ``block``, ``query_id``, ``vec_id``, ``score`` from each block in its ``shard``."""

    def run(tree: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(tree) and len(wanted):
            ball = pickle.loads(tree["tree"].iloc[0])
            for width, block, held, floors in zip(wanted["width"], wanted["block"], wanted["held"], wanted["floors"]):
                ids, queries = pickle.loads(held)
                least = {f["query_id"]: f["floor"] for f in (floors if floors is not None else ())}
                for i, found in zip(ids, ball.search(queries, ids, k, [least.get(i) for i in ids])):
                    rows += [(width, block, i, v, max(-_LONG - 1, min(_LONG, s))) for s, v in found]
        return pd.DataFrame(rows, columns=["width", "block", "query_id", "vec_id", "score"])

    on = ["width", "shard", "chunk"]
    each = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    dealt = blocks.withColumn("chunk", F.pmod("block", F.lit(chunks)))
    return each.groupBy(on).cogroup(dealt.groupBy(on)).applyInPandas(run, "width int, block int, query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, gathered as they pass and never more than ``k`` at once."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.  Components count as
    floor(scale * x); the score is their whole-number inner product (held to the range of a long).
    A query never finds its own id; ties go to the smaller id; with fewer candidates than ``k`` all
    are returned.  Rows take no part whose id or vector is null, or whose vector holds a null or a
    number that is not finite; a query meets only vectors of its own length.  Of rows that repeat a
    query's id the smallest vector asks; repeated candidates are found as often as they stand.
    Ids are integers.  Other columns are ignored, whatever their names.
    """
    plain = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
    held = saved(plain(vectors), "vectors")
    asked = saved(plain(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    shards, n = partitions_for(held.count(), SHARD), asked.count()
    trees = saved(_trees(held, shards), "trees")
    blocks = partitions_for(n, BLOCK)
    chunks = partitions_for(blocks, BLOCKS)
    asked = saved(_blocks(asked, blocks), "query_blocks")
    none = F.lit(None).cast("array<struct<query_id:bigint,floor:bigint>>")
    home = F.pmod("block", F.lit(shards)).cast("int")
    first = saved(_search(trees, asked.withColumns({"shard": home, "floors": none}), k, chunks), "home_hits")
    floors = first.groupBy("width", "block", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = floors.groupBy("width", "block").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))  # a block's at most
    others = asked.join(floors, ["width", "block"], "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rest = _search(trees, others.where(F.col("shard") != home), k, chunks)
    found = _best(first.unionByName(rest), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
