"""Vector codes against plain rounds over all pairs."""
import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import anchor_tree, vector_codes
from lanewise.llm.anchor_tree import Entries, assign, build

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, entries=256, rounds=4, parts=4):
    """(vec_id, code, error, label_error) of each row and the digest, in plain integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][1]) // parts
    cut = [[tuple(v[p * dim:(p + 1) * dim]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, xs in own.items():
                books[p][e] = tuple(sum(col) // len(xs) for col in zip(*xs))
    best = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in b) for b in best]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    known = sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in b), err, labels[label]) for (i, _, label), b, err in zip(kept, best, errors)), known


def made(n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    v = (centres[rng.integers(0, 5, n)] + 0.1 * rng.standard_normal((n, dim))).astype(np.float32)
    return [(int(i * 37 % 1009), v[i].tolist(), int(i % 3) if i % 10 else None) for i in range(n)]


@pytest.mark.parametrize("entries, block, leaf", [(256, 4096, 96), (9, 50, 4)])
def test_codes_equal_plain_rounds(spark, monkeypatch, entries, block, leaf):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(anchor_tree, "LEAF", leaf)
    rows = made(300) + [(2000 + i, [0.25, -0.5] * 4, 1) for i in range(80)]  # many equal ones
    rows += [(5000, [0.0] * 8, 7), (5001, None, 7), (5002, [math.nan] * 8, 7), (5003, [math.inf] + [0.0] * 7, 7), (5004, [None] + [0.0] * 7, 7),
             (5005, [1.0, 2.0], 7), (5006, [], 7), (None, [0.5] * 8, None), (3, [0.001, -0.001] * 4, 2), (3, [0.001, -0.001] * 4, 2)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"code": F.lit("clash"), "v": F.lit(1), "id": F.lit(2)}).repartition(4)
    got = vector_codes.compress(table, entries=entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    out = got.collect()
    want, known = plain([r for r in rows if r[1] is None or len(r[1]) == 8], entries)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in out) == want
    assert {r.codebooks_sha256 for r in out} == {known}


# the last of four parts of five components is all filled up
def test_few_vectors_odd_lengths_and_none(spark):
    table = spark.createDataFrame([(2, [1.0, -1.0, 0.5, 0.1, 0.3], 1), (1, [0.0] * 5, 1)], SCHEMA)
    out = vector_codes.compress(table).orderBy("vec_id").collect()
    assert [(r.code, r.error, r.label_error) for r in out] == [("00000000", 0, 0), ("01010100", 0, 0)]
    assert vector_codes.compress(table.limit(0)).count() == 0
    assert vector_codes.compress(table.where("vec_id = 2").withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
    assert [r.code for r in vector_codes.compress(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()] == ["00000000"]
    with pytest.raises(Exception, match="too large for exact"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA)).collect()


@pytest.mark.parametrize("spread", [1, 40])
def test_a_tree_owns_balls_without_looking(monkeypatch, spread):
    monkeypatch.setattr(anchor_tree, "LEAF", 8)
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, (12, 6))
    points = centres[rng.integers(0, 12, 3000)] + rng.integers(-spread, spread + 1, (3000, 6))
    tree, book = build(points), np.concatenate([points[:30], points[:3]])
    for a in range(len(tree.radius)):  # balls hold their points, sums and counts
        own = points[tree.order[tree.span[a, 0]:sum(tree.span[a])]]
        assert (own.sum(0) == tree.sums[a]).all() and np.sqrt(((own - tree.centre[a]) ** 2).sum(1)).max() <= tree.radius[a]
    assert sorted(tree.order) == list(range(3000))
    owners = np.empty(3000, np.int64)
    counts, sums, looked = assign(tree, points, Entries(book), owners)
    want = ((points[:, None] - book) ** 2).sum(2).argmin(1)
    assert (owners == want).all() and (counts == np.bincount(want, minlength=33)).all()
    assert all((sums[e] == points[want == e].sum(0)).all() for e in range(33))
    one = Entries(centres)
    assert assign(tree, points, one)[2] == (0 if spread == 1 else assign(tree, points, one)[2]) < 3000  # clusters of one entry each
    large = points.astype(np.int64) << 20
    assert (Entries(book << 20).distances(large[:50], np.arange(33)).argmin(1) == want[:50]).all()
