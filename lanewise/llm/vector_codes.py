"""Vectors as short codes: a codebook per part, trained by rounds over anchors-hierarchy trees.

Rows are dealt to blocks where they are read, without a shuffle; a block's trees are built once, written, and walked in every round.
Only counts and sums of entries leave a round: at most parts x entries rows, whatever the input.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanewise.llm.anchor_tree import Entries, Tree, assign, build
from lanewise.llm.common import saved
from lanewise.llm.vectors import matrix

BLOCK = 4096  # vectors of a tree
TREE = "struct<order: binary, centre: binary, radius: binary, sums: binary, span: binary, children: binary>"
ARROW = pa.list_(pa.struct([(f.name, pa.binary()) for f in fields(Tree)]))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256,
             rounds: int = 4, scale: int = 1024) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every kept vector, under the given names of id and label.

    Left out are vectors that are null or hold null or non-finite components, and those that have not the usual length (the most
    frequent one, of several the longest). A component x counts as ``floor(scale * x)``. A length that ``parts`` does not divide is
    filled up with zeros. Entries start as the parts of the vectors of the smallest ids (null ids last, equal ids by vector); with fewer
    vectors there are fewer entries. Repeated rows count and are all returned. Components whose exact squared distances exceed 64 bits
    raise an error. Other columns do not pass; an empty table gives an empty one.
    """
    v = F.col("v")
    rows = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    clean = rows.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    usual = clean.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = usual["length"] if usual else 0
    clean = clean.where(F.size("v") == length)
    dim = -(-length // parts)

    def integers(m: np.ndarray) -> np.ndarray:
        grown = np.floor(m * scale)
        if np.abs(grown).max(initial=0) >= 2 ** 31:
            raise ValueError("components are too large for exact squared distances in 64 bits")
        return np.pad(grown.astype(np.int64), ((0, 0), (0, parts * dim - length)))

    first = clean.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    books = [np.ascontiguousarray(b) for b in np.split(integers(np.array([r.v for r in first], float).reshape(len(first), length)), parts, 1)]
    blocks = saved(_blocks(clean, integers, parts, dim))
    for _ in range(rounds):
        books = _round(blocks, books, dim)
    final = saved(_codes(blocks, books, dim))
    known = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    sums = final.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = final.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of").withColumn("codebooks_sha256", F.lit(known))
    return out.withColumnsRenamed({"id": id_col, "label": label_col})


def _blocks(clean: DataFrame, integers, parts: int, dim: int) -> DataFrame:
    """One row per block: ids and labels, integer components and a tree for each part."""
    kind = {f.name: f.dataType.simpleString() for f in clean.schema}

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                points = integers(matrix(some.column("v")) if dim else np.zeros((some.num_rows, 0)))
                trees = [build(p).packed() for p in np.split(points, parts, 1)]
                keys = pa.StructArray.from_arrays([some.column("id"), some.column("label")], ["id", "label"])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([points.astype(np.int32).tobytes()]), pa.array([trees], ARROW)],
                    names=["keys", "points", "trees"])

    return clean.mapInArrow(grow, f"keys array<struct<id: {kind['id']}, label: {kind['label']}>>, points binary, trees array<{TREE}>")


def _read(batches: Iterator[pa.RecordBatch], parts: int, dim: int) -> Iterator[tuple[pa.StructArray, list[np.ndarray], list[Tree]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            points = np.frombuffer(one.column("points")[0].as_py(), np.int32).astype(np.int64)
            trees = [Tree.unpacked(t, dim) for t in one.column("trees")[0].as_py()]
            split = np.split(points.reshape(len(trees[0].order), -1), parts, 1)
            yield (one.column("keys").flatten() if "keys" in batch.schema.names else None), [np.ascontiguousarray(p) for p in split], trees


def _round(blocks: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round: every entry the floor of its parts' mean, unused ones as they were."""
    parts = len(books)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Entries(b) for b in books]
        counts, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros_like(b) for b in books]
        for _, points, trees in _read(batches, parts, dim):
            for p in range(parts):
                n, s, _ = assign(trees[p], points[p], known[p])
                counts[p] += n
                sums[p] += s
        used = [(p, e) for p in range(parts) for e in np.nonzero(counts[p])[0].tolist()]
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([counts[p][e] for p, e in used], pa.int64()),
                 pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    partial = blocks.select("points", "trees").mapInArrow(sums_of, "part int, entry int, n bigint, sums array<bigint>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
    new = [b.copy() for b in books]
    for r in total.collect():  # at most parts x entries rows
        new[r.part][r.entry] = [s // r.n for s in r.sums]
    return new


def _codes(blocks: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(id, label, code, error): the nearest entries of all vectors."""
    parts = len(books)
    kind = blocks.schema["keys"].dataType.elementType

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Entries(b) for b in books]
        for keys, points, trees in _read(batches, parts, dim):
            code, error = np.zeros((len(keys), parts), np.int64), np.zeros(len(keys), np.int64)
            for p in range(parts):
                assign(trees[p], points[p], known[p], code[:, p])
                error += ((points[p] - books[p][code[:, p]]) ** 2).sum(1)
            texts = ["".join(f"{x:02x}" for x in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([*keys.flatten(), pa.array(texts, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(codes, f"id {kind['id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error bigint")
