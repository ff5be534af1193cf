"""Prefix trie of conversations by ROLLUP over blocks of positional turn columns.

A conversation is cut into blocks of BLOCK turns; a block is one row with a column per position and
the node its first turn hangs from.  One ROLLUP over the columns, grouped by that node, aggregates
all prefixes of all blocks together, and grouping_id tells their depths.  A node is known by its
depth and the sum of its turns' hashes, each taken with its position, so that the node at the
beginning of a block is a running sum and no block waits for the one before.

What a subtree adds up to needs no walk up the trie: each node is charged to its smallest member,
whose nodes from some depth on are all its own, and a second ROLLUP sums over the members of a node
what they are charged from its depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewire.llm.common import looked_up, saved
from tapewire.llm.ordered import numbered, placed, running

#: Turns of a block; conversation ids that one piece of a node's list may hold.
BLOCK, PIECE = 8, 4096
#: Hashes have 96 bits: sums of 10^9 of them are exact.
HASH = "decimal(38,0)"
WORD = r"[^\x20\x09-\x0D]+"
_COLUMNS = [f"t{i}" for i in range(1, BLOCK + 1)]


def _turn_hash(place: Column, turn_id: Column) -> Column:
    """96 bits of a turn and its place, as an exact number."""
    text = F.sha2(F.concat_ws(":", place.cast("string"), F.hex(turn_id)), 256)
    half = lambda at: F.conv(F.substring(text, at, 12), 16, 10).cast("decimal(15,0)")
    return (half(1) * F.lit(1 << 48).cast("decimal(15,0)") + half(13)).cast(HASH)


def _rebuilt(turns: DataFrame, share: int, most: int) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the rebuilt turns: ``conv_id``, ``place`` (from 1), ``turn_id``, ``words``."""
    sorted_turns = placed(turns, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("turn_id")], "turns")
    rows = saved(numbered(sorted_turns, ["conv_id"], "at").select("conv_id", "at", "turn_id", "words"), "turn_places")
    base = F.expr(f"conv_id - conv_id % {share}")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1))
    heads = rows.where((F.col("at") < most) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("has"))  # most at most
    ids = rows.where("at = 0").select("conv_id", base.alias("base"), taken.alias("taken")).join(lengths, "base", "left")
    ids = saved(ids.withColumn("got", F.least("taken", F.coalesce("has", F.lit(0)))).drop("has"), "conversations")
    given = ids.join(heads, "base").where("at < got")
    own = rows.join(ids, "conv_id").where("at >= taken").withColumn("at", F.col("at") - F.col("taken") + F.col("got"))
    columns = ["conv_id", (F.col("at") + 1).cast("bigint").alias("place"), "turn_id", "words"]
    return ids.select("conv_id"), given.select(*columns).unionByName(own.select(*columns))


def _blocks(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per conversation and ``block``: ``start``, the node its first turn hangs from, ``own``,
    the sum of its hashes, ``filled``, its turns, and ``t1``... (hash and words; null beyond the end).

    Every conversation has a block 0, also one without turns.
    """
    turns = turns.withColumns({"hash": _turn_hash(F.col("place"), F.col("turn_id")), "block": F.expr(f"(place - 1) div {BLOCK}")})
    slot, turn = F.expr(f"(place - 1) % {BLOCK} + 1"), F.struct("hash", "words")
    cells = [F.max(F.when(slot == i, turn)).alias(c) for i, c in enumerate(_COLUMNS, 1)]
    empty = ids.select("conv_id", F.lit(0).cast("bigint").alias("block"))
    found = turns.unionByName(empty, allowMissingColumns=True).groupBy("conv_id", "block")
    found = found.agg(*cells, F.coalesce(F.sum("hash").cast(HASH), F.lit(0).cast(HASH)).alias("own"), F.count("hash").alias("filled"))
    found = running(placed(found, ["conv_id"], ["block"], "turn_blocks"), ["conv_id"], "own", "start")
    return saved(found.withColumn("start", F.col("start").cast(HASH)), "block_nodes")


def _key(depth: Column, node: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", depth.cast("string"), node.cast("string")), 256))


def _rolled_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """Every node with ``key``, ``up`` (the key of its parent), ``depth``, ``level`` in its block,
    ``words`` of its last turn, and the aggregates over its members."""
    columns = ", ".join(_COLUMNS)
    rows = blocks.sparkSession.sql(
        f"SELECT block, start, {columns}, {BLOCK} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, start, ROLLUP({columns})",
        blocks=blocks,
    )
    # A prefix longer than its conversation is no node, and the first of a later block was counted in the one before.
    filled = sum(F.col(c).isNotNull().cast("int") for c in _COLUMNS)
    rows = rows.where((filled == F.col("level")) & ((F.col("level") > 0) | (F.col("block") == 0)))
    nothing = F.lit(0).cast(HASH)
    node, last = F.col("start"), nothing
    for c in _COLUMNS:
        node = (node + F.coalesce(F.col(f"{c}.hash"), nothing)).cast(HASH)
        last = F.coalesce(F.col(f"{c}.hash"), last)
    words = F.coalesce(*[F.col(f"{c}.words") for c in reversed(_COLUMNS)], F.lit(0))
    rows = rows.withColumns({"node": node, "last": last, "words": words, "depth": F.col("block") * BLOCK + F.col("level")})
    up = F.when(F.col("depth") > 0, _key(F.col("depth") - 1, (F.col("node") - F.col("last")).cast(HASH)))
    return rows.withColumns({"key": _key(F.col("depth"), F.col("node")), "up": up}).drop("block", "start", "node", "last", *_COLUMNS)


def _charged(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The blocks with what nodes charge to their conversation: ``leaf`` (1 if it is the smallest
    member of a childless node) and ``s0``..., the tokens saved at the nodes charged to it from each
    place of the block on."""
    weight = (F.col("n_convs") - 1) * F.col("words")
    slot = F.expr(f"(depth - 1) % {BLOCK} + 1")
    chain = nodes.where("depth > 0").groupBy("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block"))
    chain = chain.agg(*[F.sum(F.when(slot == i, weight)).alias(f"w{i}") for i in range(1, BLOCK + 1)], F.sum(weight).alias("charged"))
    leaves = nodes.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf"))
    found = blocks.select("conv_id", "block", "start", *_COLUMNS).join(chain, ["conv_id", "block"], "left").join(leaves, "conv_id", "left")
    found = found.fillna(0, ["leaf", "charged", *[f"w{i}" for i in range(1, BLOCK + 1)]])
    found = running(placed(found, ["conv_id"], [F.desc("block")], "charged_blocks"), ["conv_id"], "charged", "later")
    sums, so_far = {}, F.col("later")
    for i in range(BLOCK, 0, -1):
        so_far = so_far + F.col(f"w{i}")
        sums[f"s{i}"] = so_far
    sums["s0"] = sums["s1"]
    return found.withColumns(sums)


def _end_digests(ends: DataFrame) -> DataFrame:
    """``key`` and ``ends_sha256`` of nodes where conversations end.

    Ids are joined in pieces of bounded length; a digest reads its pieces one after the other.
    """
    piece = F.floor(F.col("conv_id") / F.lit(PIECE).cast("decimal(10,0)"))
    pieces = ends.groupBy("key", piece.alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # PIECE at most
    pieces = pieces.select("key", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, hashlib.sha256()
        out: list[tuple[bytes, str]] = []

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in out], pa.binary()), "ends_sha256": pa.array([d for _, d in out], pa.string())})
            out.clear()
            return found

        for batch in batches:
            for its, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if its == key:
                    held.update(b",")
                else:
                    if key is not None:
                        out.append((key, held.hexdigest()))
                    key, held = its, hashlib.sha256()
                held.update(ids.encode())
            yield rows()
        if key is not None:
            out.append((key, held.hexdigest()))
            yield rows()

    in_order = pieces.repartition("key").sortWithinPartitions("key", "piece")
    return in_order.select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(
    turns: DataFrame, share: int = 20, most: int = 3,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    A conversation c is rebuilt from the first h turns of conversation ``c - c % share`` (all it has
    if fewer) and its own turns after its first h, h being ``crc32(decimal c) % (most + 1)``.  Turns
    are ordered by ``turn``, null first, equal ones by a digest of role and text.  A node is a
    distinct sequence of first turns (role and text); the root has none.  Columns: ``conv_id``
    (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes in the subtree), ``saved_tokens`` (words of last
    turns that members of the subtree's nodes beyond the first need not read again) and
    ``ends_sha256`` (of the sorted ids of the members that end here).

    Null role or text counts as empty; rows without a conversation id belong to none; repeated rows
    are turns of their own; a conversation may be left without turns and is a member of the root
    only.  An empty table has no nodes.  Other columns are ignored, whatever their names.
    """
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn_id = F.unhex(F.sha2(F.concat(F.length(clean(role_col)).cast("string"), F.lit(":"), clean(role_col), clean(text_col)), 256))
    plain = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), turn_id.alias("turn_id"),
        F.regexp_count(clean(text_col), F.lit(WORD)).cast("bigint").alias("words"),
    )
    ids, rebuilt = _rebuilt(plain, share, most)
    blocks = _blocks(ids, rebuilt)

    nodes = saved(_rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id"), "trie_nodes")
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(children, "key", "left").fillna(0, ["n_children"]), "trie_children")

    charged = saved(_charged(blocks, nodes), "trie_charges")
    sums = ", ".join(f"sum(s{i}) AS s{i}" for i in range(BLOCK + 1))
    summed = _rolled_up(charged, f"sum(leaf) AS n_leaves, {sums}")
    saved_tokens = F.element_at(F.array(*[f"s{i}" for i in range(BLOCK + 1)]), (F.col("level") + 1).cast("int"))
    summed = summed.select("key", "n_leaves", saved_tokens.alias("saved_tokens"))

    last = F.max(F.struct("block", (F.col("block") * BLOCK + F.col("filled")).alias("depth"), (F.col("start") + F.col("own")).cast(HASH).alias("node")))
    ends = blocks.groupBy("conv_id").agg(last.alias("last")).select("conv_id", _key(F.col("last.depth"), F.col("last.node")).alias("key"))

    parents = nodes.where("n_children > 0").select(F.col("key").alias("up"), "n_children", F.col("conv_id").alias("parent_conv_id"))
    out = looked_up(nodes, "up", parents, "n_children", ["parent_conv_id"])
    out = out.join(summed, "key", "left").join(_end_digests(ends), "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
