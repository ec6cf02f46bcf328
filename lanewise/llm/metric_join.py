"""Embedding near-duplicates by an exact metric range join.

On unit vectors cosine >= s is Euclidean distance <= r = sqrt(2 - 2 s). Each
vector lives in the cell of its nearest pivot. If w lives with pivot j and v with
pivot i, the triangle inequality keeps their distance above
(d(v, j) - d(v, i)) / 2, and in Euclidean space the hyperplane between the pivots
above (d(v, j)^2 - d(v, i)^2) / (2 d(i, j)); also above d(v, j) less the cell's
radius. v is copied to exactly the cells where no bound exceeds r, so every
vector meets all its partners in its own cell and cells join independently.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.common import components, saved
from lanewise.llm.vectors import matrix, unit, usable

SAMPLE = 4096  # vectors that pivots are chosen from
CELL = 4096  # vectors to a cell that the number of pivots aims at
PIVOTED = 200  # labels, the largest, that get pivots
BLOCK = 2048  # vectors of a cell that a group compares with as many of the copies in it
SLACK = 1e-9


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal: spread-out vectors of the sample."""
    picked = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < min(count, len(sample)):
        far = int(gap.argmax())
        if gap[far] == 0:
            break
        picked.append(far)
        gap = np.minimum(gap, ((sample - sample[far]) ** 2).sum(1))
    return sample[picked]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * v @ pivots.T))


def link(left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which unit rows are at least that similar. Matrix products may round by place, so values near the limit are summed anew."""
    s = left @ right.T
    out = s >= similarity
    i, j = np.nonzero(np.abs(s - similarity) < 1e-12)
    if len(i):
        out[i, j] = (left[i] * right[j]).sum(1) >= similarity
    return out


def spread(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``mask`` connects: at most one for each row and column, not one for each pair."""
    i, j = np.nonzero(mask)
    if not len(i):
        return []
    names, at = np.unique(np.concatenate([left[i], right[j]]), return_inverse=True)
    a, b = at[:len(i)], at[len(i):]
    root = np.arange(len(names))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return [(int(names[x]), int(names[r])) for x, r in enumerate(root) if x != r]
        root = new


def near_duplicates(table: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``table``.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least
    ``similarity``. Null, zero, empty or non-finite vectors and those without a label link with nothing: 0 links,
    a component of their own. Vectors of different length link never. A null id has
    0 links, a null component and is kept. Equal vectors are compared once and counted with
    their number. Each row of a repeated id has the id's largest number of links and smallest component. An empty table
    gives no row.
    """
    radius = math.sqrt(2 - 2 * similarity)
    label = F.col(f"`{label_col}`").alias("label")
    good = usable(table, id_col, vector_col, label).where("label IS NOT NULL").withColumn("label", F.struct("label", F.size("v").alias("dim")))
    # equal vectors are one class: a very common vector is met by partial sums
    classes = saved(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
                    .withColumn("key", F.xxhash64("label")).select("key", "label", "rep", "n", "v"))
    sizes = {r[0]: r[1] for r in classes.groupBy("key").count().where(F.col("count") > CELL)
             .orderBy(F.desc("count")).limit(PIVOTED).collect()}  # a label beyond these is one cell, split in blocks like all cells
    pivots: dict[int, np.ndarray] = {}
    for key, size in sizes.items():
        few = classes.where(F.col("key") == key).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
        pivots[key] = choose_pivots(unit(matrix(few.column("v"))), min(256, -(-size // CELL)))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array(b.column("key"))
            cell, away = np.zeros(len(keys), np.int32), np.zeros(len(keys))
            for k in pivots.keys() & set(keys.tolist()):
                at = np.flatnonzero(keys == k)
                d = distances(unit(matrix(b.column("v").take(pa.array(at)))), pivots[k])
                cell[at], away[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "rep": b.column("rep"), "n": b.column("n"), "v": b.column("v"),
                                              "cell": pa.array(cell), "away": pa.array(away)})

    kind = "key bigint, rep bigint, n bigint, v array<double>, cell int, away double"
    homes = saved(classes.select("key", "rep", "n", "v").mapInArrow(home, kind))
    held = homes.groupBy("key", "cell").agg(F.count("*").alias("size"), F.max("away").alias("reach"))
    reach = {(r.key, r.cell): r.reach for r in held.where(F.col("key").isin(list(sizes))).collect()} if sizes else {}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells within reach of every vector, its own among them."""
        for b in batches:
            keys, own_cells = b.column("key").to_pylist(), b.column("cell").to_pylist()
            near: list[list[int]] = [[c] for c in own_cells]
            for k in pivots.keys() & set(keys):
                at = np.flatnonzero(np.array(keys) == k)
                p = pivots[k]
                d = distances(unit(matrix(b.column("v").take(pa.array(at)))), p)
                mine = np.array(own_cells)[at]
                own = d[np.arange(len(at)), mine][:, None]
                between = distances(p, p)[mine]
                plane = (d * d - own * own) / np.maximum(2 * between, 1e-300)
                bound = np.maximum(np.maximum((d - own) / 2, np.where(between > 0, plane, 0)), d - np.array([reach.get((k, c), -9.0) for c in range(len(p))]))
                for row, i in zip(bound <= radius + SLACK, at):
                    near[i] = sorted({*np.flatnonzero(row).tolist(), own_cells[i]})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "rep", "n", "v", "cell")), pa.array(near, pa.list_(pa.int32()))],
                                             names=["key", "rep", "n", "v", "home", "near"])

    reaching = saved(homes.mapInArrow(cells, "key bigint, rep bigint, n bigint, v array<double>, home int, near array<int>"))
    # vectors at home in a cell and copies in it, each cut in blocks of their own
    split = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    crowds = (reaching.select("key", F.explode("near").alias("cell"), "home").groupBy("key", "cell")
              .agg(F.count("*").alias("copies"), F.count_if(F.col("cell") == F.col("home")).alias("homes"))
              .where("homes > 0").select("key", "cell", split("homes").alias("hbs"), split("copies").alias("pbs")))
    crowds = saved(crowds)
    at = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    row = ["key", "rep", "n", "v", "cell"]
    met = reaching.select("key", "rep", "n", "v", "home", F.explode("near").alias("cell")).join(crowds, ["key", "cell"])
    partners = met.select(*row, each("hbs").alias("hb"), at("pbs").alias("pb"), F.lit(1).alias("side"))
    askers = met.where("cell = home").select(*row, at("hbs").alias("hb"), each("pbs").alias("pb"), F.lit(0).alias("side"))
    dealt = partners.unionByName(askers)

    def join(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side"))
        reps, n = np.array(t.column("rep")), np.array(t.column("n"))
        v = unit(matrix(t.column("v")))
        home, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids, links, edges = [], [], []
        for at in range(0, len(home), 512):
            h = home[at:at + 512]
            mask = link(v[h], v[other], similarity) & (reps[h][:, None] != reps[other][None, :])
            ids.append(reps[h])
            links.append(mask @ n[other])
            edges += spread(mask, reps[h], reps[other])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        links = np.concatenate(links) if links else np.zeros(0, np.int64)
        return pa.table({"rep": pa.array([*ids.tolist(), *(a for a, _ in edges)], pa.int64()),
                         "links": pa.array([*links.tolist(), *[None] * len(edges)], pa.int64()),
                         "other": pa.array([*[None] * len(ids), *(b for _, b in edges)], pa.int64())})

    found = saved(dealt.groupBy("key", "cell", "hb", "pb").applyInArrow(join, "rep bigint, links bigint, other bigint"))
    counted = found.where("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.where("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    result = (classes.select("label", "v", "rep", "n").join(counted, "rep", "left")
              .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
              .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component_id")))
    members = good.join(result, ["label", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = table.select(F.col(f"`{id_col}`").alias("id"))
    return (ids.join(members, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True))))
