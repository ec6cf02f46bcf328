"""Order MinHash against aligning all pairs, and the components of edges."""
import random
from collections import Counter

import numpy as np
import pytest

from lanewise.llm import order_minhash as om
from lanewise.llm.common import components

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def edited(words, changes, rng=RNG):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], prose(1), [words[at], *prose(1)]])
    return words


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def by_pairs(rows):
    """Components by aligning all pairs without bands."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    texts = [(i, om.WORDS.findall((t or "").lower()), t) for i, t in rows]
    for a, (i, u, s) in enumerate(texts):
        for j, v, t in texts[:a]:
            if s is None or t is None:
                continue
            if not u or not v:
                same = s == t
            else:
                x, y = om.labelled(u).tolist(), om.labelled(v).tolist()
                common = lcs(x, y) if sum((Counter(x) & Counter(y)).values()) >= 0.6 * min(len(x), len(y)) else 0
                same = u == v or common / (len(x) + len(y) - common) >= 0.8
            if same:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def corpus():
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, words if words is None or isinstance(words, str) else " ".join(words)))
        n += 1

    for size in (5, 8, 9, 14, 17, 20, 25, 40, 120, 300):
        base = prose(size)
        add(base), add(base), add([w.upper() for w in base])
        for changes in (1, 1, 2, 3, 6):
            add(edited(base, changes))
    passage = prose(60)
    for _ in range(60):  # a common passage in different texts
        add(prose(RNG.randrange(20, 60)) + passage + prose(RNG.randrange(20, 60)))
    chain = prose(150)
    for _ in range(25):  # each near the one before
        add(chain)
        chain = edited(chain, 2)
    hub = prose(100)
    for _ in range(40):
        add(edited(hub, 1))
    for t in (None, None, "", "", "...", "...", "!!!", "word", "word", "two words", "Two  words.", "ha " * 500, "ha " * 499, "ha " * 200):
        add(t)
    return rows


@pytest.mark.parametrize("block,large", [(128, 4096), (3, 6)])
def test_components_equal_all_pairs(spark, monkeypatch, block, large):
    monkeypatch.setattr(om, "BLOCK", block)
    monkeypatch.setattr(om, "LARGE", large)
    monkeypatch.setattr(om, "COLUMNS", 64)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, key string, n int").repartition(4)
    got = {r.doc_id: r for r in om.near_duplicates(docs).collect()}
    want = by_pairs(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    first = {}
    for i, t in rows:
        words = tuple(om.WORDS.findall((t or "").lower()))
        key = words or (t if t is not None else i)
        assert got[i].class_id == first.setdefault(key, i)


def test_a_large_bucket_loses_no_link_of_one_shared_sketch(spark, monkeypatch):
    # every document has one key in common and else none, so only a comparison of the whole bucket finds the links
    monkeypatch.setattr(om, "LARGE", 4)
    monkeypatch.setattr(om, "BLOCK", 3)
    monkeypatch.setattr(om, "sketches", lambda s: np.array([1, int(s.view(np.int64)[0]) | 1], np.int64) if len(s) else np.zeros(0, np.int64))
    rng = random.Random(8)
    rows = []
    for k in range(9):
        words = [f"w{k}x{n}" for n in range(rng.randrange(30, 200))]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(["other", *words[1:]])), (10 * k + 2, " ".join(["another", *words[1:-1]]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in om.near_duplicates(docs).collect()}
    assert got == {i: i - i % 10 for i, _ in rows}


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "same text here"), (None, "same text here"), (5, "same text here"), (5, "same text here"), (6, "same text here")],
                                 "doc_id bigint, text string")
    rows = om.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert om.near_duplicates(docs.limit(0)).count() == 0


def test_banded_alignment_equals_full_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 80))]
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = [rng.randrange(30) for _ in range(rng.randrange(2))]
        common = lcs(a, b)
        true = common / (len(a) + len(b) - common) if a and b else 0
        assert om.aligned(a, b) == (pytest.approx(true) if true >= 0.8 else 0)


def test_sketch_follows_order_and_occurrence():
    words = prose(200)
    turned = words[100:] + words[:100]
    s = set(om.sketches(om.labelled(words)).tolist())
    assert s == set(om.sketches(om.labelled(words)).tolist())
    assert len(s & set(om.sketches(om.labelled(turned)).tolist())) < 16
    twice = om.labelled(["a"] * 20)
    assert len(set(twice.tolist())) == 16
    big = np.random.default_rng(0).integers(0, 2**64 - 1, (3, 5000), dtype=np.uint64)
    assert [sorted(r) for r in om.smallest(big, 5).tolist()] == [sorted(np.argsort(r)[:5].tolist()) for r in big]


def test_shared_counts_equal_set_intersections(monkeypatch):
    monkeypatch.setattr(om, "COLUMNS", 5)
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 25)) for _ in range(9)]
    assert om.shared_counts(rows[:4], rows[4:]).tolist() == [[len(set(a) & set(b)) for b in rows[4:]] for a in rows[:4]]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (500, 499)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(200)}, 500: 499, 499: 499}
