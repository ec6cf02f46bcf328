"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample, every vector is filed under one leaf. A
query goes down the nearest branches and keeps the others in a priority queue,
by the cosine to their centres; leaves come out best first. How many are visited
is calibrated: the visits of sample queries widen until they find the wanted
part of their true neighbours.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.llm.common import saved
from lanewise.llm.vectors import cosines, matrix, unit, usable

SAMPLE = 16_384  # vectors that the tree is fitted on
BRANCHES = 8
LEAF = 128  # sample vectors below which a node isn't split
PROBES = 256  # queries that calibrate the visits
BLOCK = 4096  # vectors of a leaf, and queries to it, that one group compares


@dataclass
class Node:
    centres: np.ndarray | None = None
    children: list["Node"] = field(default_factory=list)
    leaf: int = -1


class Tree:
    """Hierarchical spherical k-means over unit vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        self.leaves = 0
        self.root = self.grow(sample, np.random.default_rng(seed)) if len(sample) else self.tip()

    def tip(self) -> Node:
        self.leaves += 1
        return Node(leaf=self.leaves - 1)

    def grow(self, v: np.ndarray, rng: np.random.Generator) -> Node:
        if len(v) <= LEAF:
            return self.tip()
        centres = v[rng.choice(len(v), BRANCHES, replace=False)]
        for _ in range(12):
            at = (v @ centres.T).argmax(1)
            sums = np.stack([v[at == k].sum(0) if (at == k).any() else centres[k] for k in range(BRANCHES)])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
        at = (v @ centres.T).argmax(1)
        used = [k for k in range(BRANCHES) if (at == k).any()]
        if len(used) < 2:  # copies of one direction
            return self.tip()
        return Node(centres[used], [self.grow(v[at == k], rng) for k in used])

    def file(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(v), np.int32)
        todo = [(self.root, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if node.leaf >= 0:
                out[rows] = node.leaf
            elif len(rows):
                at = (v[rows] @ node.centres.T).argmax(1)
                todo += [(child, rows[at == k]) for k, child in enumerate(node.children)]
        return out

    def best_first(self, q: np.ndarray, most: int, holds: dict[int, int] | None = None, wanted: int = 0) -> list[int]:
        """The first ``most`` leaves in the order of the queue, and as many more as hold ``wanted`` candidates together."""
        queue, order, count, held = [(-2.0, 0, self.root)], [], 0, 0
        while queue and (len(order) < most or held < wanted):
            _, _, node = heapq.heappop(queue)
            while node.leaf < 0:
                near = node.centres @ q
                best = int(near.argmax())
                for k, child in enumerate(node.children):
                    if k != best:
                        count += 1
                        heapq.heappush(queue, (-float(near[k]), count, child))
                node = node.children[best]
            order.append(node.leaf)
            held += holds.get(node.leaf, 0) if holds else 0
        return order


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> list[int]:
    """Places of the ``k`` best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k].tolist()


def shortlist(q: np.ndarray, v: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of ``q`` the rows of ``v`` that may be among the ``k`` nearest, rounding allowed for."""
    s = q @ v.T
    if s.shape[1] <= k:
        return [np.arange(s.shape[1])] * len(q)
    limit = np.partition(s, -k, 1)[:, -k] - 1e-9
    return [np.flatnonzero(row >= x) for row, x in zip(s, limit)]


def calibrate(tree: Tree, homes: DataFrame, probes: np.ndarray, k: int, recall: float) -> int:
    """Fewest visits with which the probes find ``recall`` of their true ``k`` nearest, which a scan of all vectors gives."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unit(probes)
        best: list[tuple] = []
        for b in batches:
            v, leaf = unit(matrix(b.column("v"))), b.column("leaf").to_pylist()
            rows = [(i, float(q[i] @ v[j]), leaf[j]) for i, at in enumerate(shortlist(q, v, k + 1)) for j in at.tolist()]
            best = sorted(best + rows, key=lambda r: (r[0], -r[1]))
            kept, seen = [], {}
            for r in best:
                seen[r[0]] = seen.get(r[0], 0) + 1
                if seen[r[0]] <= k + 1:
                    kept.append(r)
            best = kept
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*best)], schema=pa.schema([("probe", pa.int64()), ("score", pa.float64()), ("leaf", pa.int32())]))

    w = Window.partitionBy("probe").orderBy(F.desc("score"))
    truth = (homes.select("v", "leaf").mapInArrow(scan, "probe bigint, score double, leaf int")
             .withColumn("r", F.row_number().over(w)).where(F.col("r").between(2, k + 1)).collect())  # the first is the probe itself
    if not truth:
        return 1
    place = [{leaf: i + 1 for i, leaf in enumerate(tree.best_first(q, tree.leaves))} for q in unit(probes)]
    needed = sorted(place[r.probe][r.leaf] for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]


def search(table: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds the ``k`` nearest other rows found.

    Score is the cosine in double precision, ties go to the smaller id. Null, zero, empty or non-finite vectors take no part,
    as queries or candidates; with fewer than ``k`` candidates all are returned, and a query whose leaves hold fewer goes on to others. Equal vectors are searched for
    once and found once, then stand for all their ids. A repeated id is a candidate to others once. Rows with a null id take no
    part, nor do vectors that haven't the most common length (of equals the smallest).
    """
    good = usable(table, id_col, vector_col, is_query.alias("q"))
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("v") == F.lit(lengths[0] if lengths else 0))
    # of equal vectors the k + 1 smallest ids can be results: a limit inside the window cuts a common vector before the shuffle
    ranked = good.select("id", "v").distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = saved(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.element_at("ids", 1)))
    sample = matrix(classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow().column("v"))
    sample = unit(sample) if len(sample) else sample
    tree = Tree(sample)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.file(unit(matrix(b.column("v")))) if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32())], names=[*b.schema.names, "leaf"])

    homes = saved(classes.mapInArrow(file, "v array<double>, ids array<bigint>, rep bigint, leaf int"))
    visits = calibrate(tree, homes, sample[:PROBES], k, recall) if len(sample) else 1
    # a leaf is split in blocks of about BLOCK vectors; at most one row for each leaf of the bounded tree
    leaves = homes.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    holds = {r.leaf: r.ids for r in leaves}
    asked = saved(good.where("q").groupBy("v").agg(F.min("id").alias("asked")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            routes = [tree.best_first(q, visits, holds, k + 1) for q in unit(matrix(b.column("v")))] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(routes, pa.list_(pa.int32()))], names=["v", "asked", "leaves"])

    routes = saved(asked.mapInArrow(visit, "v array<double>, asked bigint, leaves array<int>"))
    calls = routes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()

    def blocks(counts: list) -> Column:
        """Blocks of a leaf by its rows; 0 for one without."""
        known = F.create_map(*[F.lit(x) for r in counts for x in (r.leaf, -(-r.n // BLOCK))]) if counts else F.create_map().cast("map<int,int>")
        return F.coalesce(known[F.col("leaf")], F.lit(0))

    # a group is one block of a leaf's vectors and one of the queries that visit it, so neither side grows with the table
    filed = (homes.withColumn("part", F.pmod(F.xxhash64("rep"), F.greatest(blocks(leaves), F.lit(1))).cast("int")).withColumn("asking", blocks(calls))
             .where("asking > 0").select("leaf", "part", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("turn"), "v", "ids"))
    visiting = (routes.select("v", "asked", F.explode("leaves").alias("leaf")).withColumn("parts", blocks(leaves)).where("parts > 0")
                .withColumn("turn", F.pmod(F.xxhash64("asked"), F.greatest(blocks(calls), F.lit(1))).cast("int"))
                .select("v", "asked", "leaf", "turn", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))

    def compare(queries: Iterator[pa.RecordBatch], vectors: pa.Table) -> Iterator[tuple]:
        v = matrix(vectors.column("v"))
        names = vectors.column("ids").to_pylist()
        first, u = np.array([x[0] for x in names]), unit(v)
        for q, asked_ids in queries:
            for i, at in enumerate(shortlist(unit(q), u, k + 1)):
                score = cosines(q[i:i + 1], v[at])
                for j in top(first[at], score, k + 1):
                    yield asked_ids[i], names[at[j]], float(score[j])

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries and vectors that meet in a leaf, a block of each; the scores of 512 queries are in memory at a time."""
        fields = pa.schema([("asked", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        parts = ((matrix(p.column("v")), p.column("asked").to_pylist()) for p in left.to_batches(max_chunksize=512))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*compare(parts, right)), fields)], schema=fields)

    found = (visiting.groupBy("leaf", "part", "turn").cogroup(filed.groupBy("leaf", "part", "turn"))
             .applyInArrow(both, "asked bigint, ids array<bigint>, score double"))
    # of one query's finds k + 1 ids remain, as one of them may be the query's own
    wide = found.select("asked", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    near = wide.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = near.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("near"))
    queries = good.where("q").select("id", "v").distinct().join(asked, "v").select("id", "asked")
    out = queries.join(lists, "asked").select("id", F.slice(F.filter("near", lambda x: x.vec_id != F.col("id")), 1, k).alias("near"))
    return out.select(F.col("id").alias("query_id"), F.posexplode("near").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
