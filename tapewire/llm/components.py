"""Connected components by alternating large-star and small-star.

A large-star step links every larger neighbour of a node to the smallest of its neighbourhood,
a small-star step links the smaller ones; in turns they end in one star per component around
its smallest node.  Neighbourhoods are never gathered: a step is a minimum per node and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewire.llm.common import saved


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("v", "u"))


def large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour ``v`` of ``u`` to the smallest of ``u`` and its neighbours."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Links ``u`` and its smaller neighbours to the smallest of them.  Edges run down."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def directed(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of ``edges`` without loops and repeats, each running down; about ``rows`` at most, if known."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    return saved(down, "links", rows)


def _state(down: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes have two edges down, or edges both up and down:
    without such nodes the edges are stars around their smallest nodes."""
    ends = down.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(down.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
    found = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count(F.when((F.col("down") > 0) & (F.col("n") > 1), 1)))
    return tuple(found.first())


def stars(down: DataFrame) -> DataFrame:
    """`components` of a table of edges that are `directed`."""
    edges, unsettled = _state(down)
    while unsettled:  # a step makes no more edges than there were
        down = saved(small_star(large_star(down)), "links", edges)
        edges, unsettled = _state(down)
    nodes = down.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(down.select(F.col("v"), F.col("v")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has a link.

    ``edges`` are ``u``, ``v`` in any order; loops and repeats are ignored.
    """
    return stars(directed(edges))
