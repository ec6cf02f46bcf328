"""Nearest neighbours and the range join against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import kmeans_tree, metric_join
from lanewise.llm.vectors import cosines

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clustered(n, dim=12, seed=2, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    return (centres[rng.integers(0, 9, n)] + spread * rng.standard_normal((n, dim))).astype(np.float32)


def edge_rows(dim):
    return [(90001, None, 1), (90002, [0.0] * dim, 1), (90003, [float("nan")] + [1.0] * (dim - 1), 1), (90004, [float("inf")] + [1.0] * (dim - 1), 1),
            (90005, [None] + [1.0] * (dim - 1), 1), (90050, [], 1)]


def all_pairs(rows, similarity):
    """Links and components by comparing everything."""
    good = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            if good[a][2] == good[b][2] and cosines(good[a][1][None], good[b][1][None])[0] >= similarity:
                links[good[a][0]] += 1
                links[good[b][0]] += 1
                x, y = find(good[a][0]), find(good[b][0])
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("small", [False, True])
def test_range_join_equals_all_pairs(spark, monkeypatch, small):
    if small:  # many cells, blocks and pivots
        for name, value in (("CELL", 20), ("BLOCK", 16), ("SAMPLE", 64)):
            monkeypatch.setattr(metric_join, name, value)
    v = clustered(240)
    rows = [(i, v[i].tolist(), int(i % 3) if i % 17 else None) for i in range(240)]
    rows += [(1000 + i, v[7].tolist(), 1) for i in range(60)] + [(1100, (v[7] * 2).tolist(), 1)] + edge_rows(12)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(table, 0.93).collect()}
    assert got == all_pairs(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in metric_join.near_duplicates(table.limit(50)).collect())
    assert metric_join.near_duplicates(table.limit(0)).count() == 0


def test_groups_of_both_operators_stay_bounded(spark, monkeypatch):
    """Vectors that pivots hardly separate, and leaves that every query visits: no side of a group grows with the table."""
    monkeypatch.setattr(metric_join, "CELL", 40)
    monkeypatch.setattr(metric_join, "BLOCK", 32)
    monkeypatch.setattr(kmeans_tree, "BLOCK", 32)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 16)).astype(np.float32)
    v[300:330] = v[0:30] + 0.01
    rows = [(i, v[i].tolist(), 1) for i in range(600)]
    table = spark.createDataFrame(rows, SCHEMA)
    seen = spark.sparkContext.accumulator(0)
    plain_link, plain_short = metric_join.link, kmeans_tree.shortlist

    def link(left, right, similarity):
        assert len(left) <= 3 * 32 and len(right) <= 3 * 32, (len(left), len(right))  # hashing isn't even
        seen.add(1)
        return plain_link(left, right, similarity)

    def shortlist(q, w, k):
        if k == 6 and len(w) != 256:  # not the calibration
            assert len(w) <= 3 * 32 and len(q) <= 3 * 32, (len(q), len(w))
            seen.add(1)
        return plain_short(q, w, k)

    monkeypatch.setattr(metric_join, "link", link)
    got = {r.vec_id: (r.n_links, r.component_id) for r in metric_join.near_duplicates(table, 0.93).collect()}
    assert got == all_pairs(rows, 0.93) and sum(x > 0 for x, _ in got.values()) >= 60
    assert seen.value > 10
    before = seen.value
    monkeypatch.setattr(kmeans_tree, "calibrate", lambda *a: 10 ** 6)  # every query visits every leaf
    monkeypatch.setattr(kmeans_tree, "shortlist", shortlist)
    found = kmeans_tree.search(table, F.lit(True)).collect()
    assert seen.value > before + 10
    for query in (0, 300, 599):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)] == [i for i, _ in nearest(rows, query, 5)]


def test_leaves_with_few_candidates_are_not_the_end(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 4)
    monkeypatch.setattr(kmeans_tree, "BRANCHES", 4)
    monkeypatch.setattr(kmeans_tree, "calibrate", lambda *a: 1)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(clustered(120))]
    got = kmeans_tree.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in got) == [(q, i) for q in (0, 50, 100) for i in range(1, 6)]


def test_repeated_rows_of_an_id_are_all_kept(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1)], SCHEMA)
    rows = metric_join.near_duplicates(table).collect()
    assert sorted(r.vec_id for r in rows) == [1, 1, 2, 3] and {r.component_id for r in rows} == {1, 3}


def nearest(rows, query, k):
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    q = dict(good)[query]
    scored = sorted((-float(cosines(q[None], v[None])[0]), i) for i, v in good if i != query)
    return [(i, -s) for s, i in scored[:k]]


def test_search_finds_nearest_and_breaks_ties(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "LEAF", 24)
    v = clustered(400)
    rows = [(i, v[i].tolist(), 0) for i in range(400)] + [(1000 + i, v[50].tolist(), 0) for i in range(80)] + edge_rows(12)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("q", F.lit("clash"))
    got = {}
    for r in kmeans_tree.search(table, F.col("vec_id") % 50 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == {i for i in [*range(0, 400, 50), 1000, 1050]}
    hits = 0
    for q, found in got.items():
        want = nearest(rows, q, 5)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        for i, s in found:
            assert s == pytest.approx(float(cosines(np.array([dict((a, b) for a, b, _ in rows)[q]], float), np.array([dict((a, b) for a, b, _ in rows)[i]], float))[0]), abs=1e-12)
    assert hits >= 0.95 * 5 * len(got)
    assert [i for i, _ in got[1000]] == [50, 1001, 1002, 1003, 1004] and [i for i, _ in got[50]] == [1000, 1001, 1002, 1003, 1004]


def test_search_with_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], None), (50, [0.0, 0.0], 0)], SCHEMA)
    rows = kmeans_tree.search(table, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in rows] == [(0, 2), (0, 1)]
    assert kmeans_tree.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_null_ids_and_other_lengths(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.1], 1)], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in kmeans_tree.search(table, F.col("vec_id") % 50 == 0).collect()] == [(0, 2)]
    rows = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric_join.near_duplicates(table).collect()}
    assert rows == {None: (0, None, True), 0: (1, 0, True), 1: (0, 1, True), 2: (1, 0, False)}


def test_best_first_visits_every_leaf_once():
    v = clustered(800)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    tree = kmeans_tree.Tree(v.astype(float))
    assert tree.leaves > 4
    for q in v[:20].astype(float):
        order = tree.best_first(q, tree.leaves)
        assert sorted(order) == list(range(tree.leaves)) and order[0] == tree.file(q[None])[0]


def test_recall_on_the_test_table(spark):
    from lanewise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op4_kmeans_tree"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in nearest(rows, q, 5)}) for q in got)
    assert len(got) == sum(i % 50 == 0 for i, *_ in rows) and hits >= 0.9 * 5 * len(got)
