"""The manifest against a tree built in plain Python."""
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lanewise.llm import merkle_exchange as merkle
from lanewise.llm import queries
from tests.llm.conftest import DOCS


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, **new):
    return h(*(value({**row.asDict(), **new}[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(nodes):
    """(root, the siblings of each node level by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k - k % 3
            proofs[i].append((nodes[run:k], nodes[k + 1:run + 3]))
            at[i] = k // 3
        nodes = [h(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def expected(rows):
    """doc digest -> what the query says, for rows whose ids and texts differ."""
    out, sources = {}, sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[s] = (mine, *tree([leaf(r) for r in mine]))
    root, over = tree([trees[s][1] for s in sources])
    for s, up in zip(sources, over):
        mine, subroot, proofs = trees[s]
        for r, proof in zip(mine, proofs):
            steps = proof + up
            node = leaf(r)
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None:
                node = leaf(r, text=r.text.replace("\n", ""))
            for left, right in steps:
                node = h(*left, node, *right)
            out[leaf(r)] = (r.doc_id, subroot, root, h(*(x for a, b in steps for x in a + b)), node, node == root)
    return out


def some(n):
    """Documents of a hot source, small ones, a lone one and one without a name."""
    rows = []
    for i in range(n):
        source = "hot" if i % 3 else (None, "é", "z", "Z")[i // 3 % 4]
        rows.append((i * 7 % n, f"text {i}\nof line {i % 5}" if i % 11 else None, "en" if i % 4 else None, source, i))
    return rows + [(9000, "", "en", "lone", None), (None, "no id\n", None, "hot", 1), (9002, "x\n" * 5, None, None, 3)]


@pytest.mark.parametrize("n, levels", [(1, 1), (30, 2), (163, 1), (163, 7)])
def test_manifest_equals_a_plain_tree(spark, tmp_path, monkeypatch, n, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (levels,))
    spark.createDataFrame(some(n), DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    got = queries.op11_merkle_exchange(spark, str(tmp_path)).collect()
    assert {r.leaf: (r.doc_id, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got} == expected(rows)
    assert len(got) == len(rows)
    assert {r.verified for r in got} == {True, False} or n < 30


def test_a_changed_row_shows(spark):
    docs = spark.createDataFrame(some(50), DOCS)
    out = merkle.manifest(docs.withColumn("leaf", merkle.digest("doc_id", "text")), "source", ["doc_id"], "leaf", 1)
    changed = merkle.fold(merkle.digest("doc_id", F.concat("text", F.lit("!"))), F.col("proof"))
    rows = out.select("text", (merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("same"), (changed == F.col("root")).alias("changed")).collect()
    assert all(r.same for r in rows) and not any(r.changed for r in rows if r.text is not None)


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(1, "same", "en", "s", 4)] * 40 + [(None, None, None, None, None)] * 25
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("key", "node", "row", "pos", "block", "n", "root", "proof", "at", "a.b")})
    out = merkle.manifest(docs.withColumn("leaf", merkle.digest("doc_id", "text")), "source", ["doc_id"], "leaf", 1)
    assert out.columns == [*DOCS.replace(" bigint", "").replace(" string", "").split(", "), "key", "node", "row", "pos", "block", "n", "at", "a.b",
                           "leaf", "subroot", "root", "proof"]
    got = out.collect()
    assert len(got) == 65 and len({r.root for r in got}) == 1 and {r.key for r in got} == {"key"}
    assert all(r.ok for r in out.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect())
    assert merkle.manifest(docs.limit(0).withColumn("leaf", F.lit("x")), "source", ["doc_id"], "leaf").count() == 0
    nothing = merkle.manifest(docs.limit(1).withColumn("leaf", F.lit(None).cast("string")), "source", ["doc_id"], "leaf").first()
    assert nothing.root == nothing.subroot == h() and nothing.proof == []


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "long\n" * 400_000, "en", "s", 2_000_000), (2, "x", "en", "s", 1)], DOCS)
    got = docs.select(merkle.digest("doc_id", "source", "lang", "n_chars", "text").alias("leaf")).collect()
    assert [r.leaf for r in got] == [leaf(r) for r in docs.collect()]
