"""Merkle manifest of a dataset: one tree per key, and a tree over the keys' roots.

Leaves are dealt to aligned blocks of ``3 ** levels`` consecutive leaves of a key. A block hashes its own subtree. Then blocks
exchange roots like a butterfly: in round r a block meets the partners that differ from it in digit r of its number (base 3), takes
their roots and hashes the common parent itself, as they do. After the last round every block holds all its ancestors' siblings, so
proofs are written in one pass over the blocks and nothing travels down from the root.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lanewise.llm.common import saved

FANOUT = 3
LEVELS = 7  # a block holds FANOUT ** LEVELS leaves: the most rows of one group
STEP = "struct<left: string, right: string>"


def encoded(column: str | Column) -> Column:
    """``<bytes>:<value>`` of a value's decimal or UTF-8 text, ``-`` for null: no two rows of values give one string."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*columns: str | Column) -> Column:
    """The leaf of a row: lowercase hex SHA-256 of its encoded values."""
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(table: DataFrame, key: str, order: Sequence[str], leaf: str, levels: int = LEVELS) -> DataFrame:
    """``table`` with ``subroot`` (of the row's key), ``root`` and ``proof`` (a step per level: siblings left and right, joined).

    ``leaf`` names a column of hex digests, ``key`` one that is compared as text (null first, then by UTF-8 bytes); leaves ascend by
    ``order`` (nulls first), then by digest, so equal digests may change places without changing the tree. A null digest counts as
    the digest of nothing. Columns named like the results are replaced; an empty table gives an empty one.
    """
    rest = [c for c in table.columns if c not in ("subroot", "root", "proof")]
    name = F.col(f"`{key}`").cast("string")
    nodes = table.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("key"), F.struct(*(F.col(f"`{c}`") for c in order)).alias("rank"),
                         F.coalesce(F.col(f"`{leaf}`"), F.sha2(F.lit(""), 256)).alias("node"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    placed, blocks = subtrees(nodes, levels)
    # the keys' roots are the leaves of one more tree
    tops = blocks.where("block = 0").select(F.lit("").alias("key"), F.struct("key").alias("rank"), "node", F.struct("key").alias("row"))
    top = proofs(*subtrees(tops, levels), levels).select(F.col("row.key").alias("key"), F.col("reached").alias("root"), F.col("proof").alias("over"))
    full = blocks.join(top, "key").withColumn("upper", F.concat("upper", "over")).drop("over")
    out = proofs(placed, full, levels, "root")
    return out.select(*(F.col("row").getField(c).alias(c) for c in rest), F.col("reached").alias("subroot"), "root", "proof")


def subtrees(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The nodes with their blocks, and the blocks with the root of their key (``node``) and the steps from the block to it (``upper``)."""
    placed = in_blocks(nodes, FANOUT ** levels)
    local = placed.select("key", "block", "pos", "n", "node").groupBy("key", "block").applyInArrow(
        lambda t: _local_root(t, levels), "key string, block bigint, blocks bigint, node string")
    return placed, exchanged(local)


def in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Each node's place among its key's (``pos`` of ``n``) and its aligned block.

    Rows are dealt by ranges, so a key with most of the rows is many tasks; a partition's first place of a key follows from the
    counts of the partitions before. A tie of whole rows is cut by the place of the row in the written table.
    """
    order = ["key", "rank", "node", "tie"]
    dealt = (saved(nodes).withColumn("tie", F.monotonically_increasing_id())
             .repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "rank"))
    rows = saved(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.expr("shiftright(at, 33)")))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("key", "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    bases = counts.select("key", "range", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("base"),
                          F.sum("rows").over(Window.partitionBy("key")).alias("n"))
    pos = F.col("at") + F.col("base")
    return rows.join(saved(bases), ["key", "range"]).select("key", pos.alias("pos"), F.expr(f"(at + base) div {size}").alias("block"), "n", "node", "row")


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of all levels from the leaves up."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i:i + FANOUT]).encode()).hexdigest() for i in range(0, len(below), FANOUT)])
    return out


def _sorted(t: pa.Table) -> pa.Table:
    return t.take(pa.array(np.argsort(t["pos"].to_numpy(), kind="stable")))


def _local_root(t: pa.Table, levels: int) -> pa.Table:
    """The root of one block, and how many blocks its key has. In a key of more blocks each grows by all levels, a lone node too."""
    n, size = t["n"][0].as_py(), FANOUT ** levels
    nodes = _sorted(t.select(["pos", "node"]))["node"].to_pylist()
    root = _grown(nodes, levels if n > size else height(n))[-1][0]
    return pa.table({"key": t["key"][:1], "block": t["block"][:1], "blocks": pa.array([-(-n // size)], pa.int64()), "node": [root]})


def exchanged(local: DataFrame) -> DataFrame:
    """Blocks with ``node`` grown to the root of their key, and the siblings met on the way. Rounds: the logarithm of a key's blocks.

    Where the last node of a level has fewer blocks than the others, its blocks serve several partners each, in turn.
    """
    state = saved(local.withColumn("upper", F.expr(f"CAST(array() AS array<{STEP}>)")))
    most = state.agg(F.max("blocks")).first()[0] or 1
    for r in range(height(most)):
        span = FANOUT ** r
        now = state.withColumn("mine", F.expr(f"block div {span}"))
        asks = (now.where(f"blocks > {span}")
                .select("key", "block", "blocks", "mine", F.explode(F.expr(
                    f"sequence(mine div {FANOUT} * {FANOUT}, least(mine div {FANOUT} * {FANOUT} + {FANOUT - 1}, (blocks - 1) div {span}))")).alias("other"))
                .where("other <> mine")
                .select("key", "block", "mine", "other", F.expr(
                    f"other * {span} + (block % {span}) % least({span}, blocks - other * {span})").alias("partner")))
        met = asks.join(state.select("key", F.col("block").alias("partner"), F.col("node").alias("theirs")), ["key", "partner"])

        def side(where: str) -> Column:
            # at most FANOUT - 1 partners, joined in their order
            near = F.array_sort(F.collect_list(F.when(F.expr(where), F.struct("other", "theirs"))))
            return F.array_join(F.transform(near, lambda x: x["theirs"]), "")

        swapped = met.groupBy("key", "block").agg(side("other < mine").alias("left"), side("other > mine").alias("right"))
        sides = [F.coalesce(c, F.lit("")) for c in ("left", "right")]
        grows = F.col("blocks") > span
        state = saved(state.join(swapped, ["key", "block"], "left").select(
            "key", "block", "blocks", F.when(grows, F.sha2(F.concat(sides[0], "node", sides[1]), 256)).otherwise(F.col("node")).alias("node"),
            F.when(grows, F.concat("upper", F.array(F.struct(sides[0].alias("left"), sides[1].alias("right"))))).otherwise(F.col("upper")).alias("upper")))
    return state


def proofs(placed: DataFrame, blocks: DataFrame, levels: int, *more: str) -> DataFrame:
    """(row, reached, more.., proof): every node's steps within its block, then those of the block; ``reached`` is the block's ``node``."""
    def attach(nodes: pa.Table, block: pa.Table) -> pa.Table:
        t, n = _sorted(nodes), nodes.num_rows
        grown = _grown(t["node"].to_pylist(), levels if block["blocks"][0].as_py() > 1 else height(n))
        upper = block["upper"][0].as_py()
        # texts of all steps once, and for every node the steps it takes
        left, right, taken, first = [], [], np.empty((n, len(grown) - 1 + len(upper)), np.int64), 0
        for level, known in enumerate(grown[:-1]):
            runs = [known[i:i + FANOUT] for i in range(0, len(known), FANOUT)]
            left += ["".join(run[:i]) for run in runs for i in range(len(run))]
            right += ["".join(run[i + 1:]) for run in runs for i in range(len(run))]
            taken[:, level] = first + np.arange(n) // FANOUT ** level
            first += len(known)
        for i, step in enumerate(upper):
            left.append(step["left"])
            right.append(step["right"])
            taken[:, len(grown) - 1 + i] = first + i
        flat = pa.array(taken.ravel())
        steps = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(flat), pa.array(right, pa.string()).take(flat)], ["left", "right"])
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * taken.shape[1])
        whole = {c: pa.array([block[c][0].as_py()] * n, block[c].type) for c in ("node", *more)}
        return pa.table({"row": t["row"], "reached": whole.pop("node"), **whole, "proof": pa.ListArray.from_arrays(offsets, steps)})

    nodes = placed.select("key", "block", "pos", "node", "row").groupBy("key", "block")
    schema = placed.select("row").schema.add("reached", StringType())
    for c in more:
        schema = schema.add(blocks.schema[c])
    schema = schema.add("proof", ArrayType(StructType().add("left", StringType()).add("right", StringType())))
    return nodes.cogroup(blocks.groupBy("key", "block")).applyInArrow(attach, schema)
