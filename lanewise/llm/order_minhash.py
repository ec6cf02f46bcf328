"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its five-word shingles, each labelled with how often
it has occurred before. A sketch takes the few labelled shingles that are smallest
under one hash function and keeps them in the order of the text, so it agrees
only where the same shingles stand in the same order. Documents that share a
sketch are candidates; an alignment of their sequences decides.

Similarity is M / (n + m - M) for M labelled shingles aligned of n and m: their
Jaccard index if their order agrees, and less if it doesn't.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lanewise.llm.common import components, few_at_once, remembered, saved, slices_of
from lanewise.session import sized

WORDS = re.compile(r"\w+")
SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, PICKED = 32, 5  # at similarity 0.8 a pair shares no sketch with a chance of about (1 - 0.8 ** 5) ** 32 = 3e-6
SHORT, SHORT_SKETCHES = 20, 12  # below so many shingles a sketch is one shingle; 0.2 ** 12 = 4e-9
BLOCK = 512  # members of a bucket that one group compares with as many others
LARGE = 4096  # members above which a bucket is dealt by length first, as lengths too different rule a link out
COLUMNS = 8192  # distinct shingles counted at a time
KNOWN = 300_000  # word hashes that a worker remembers

_seeds = np.random.default_rng(20240229).integers(0, 2**64 - 1, (2, SKETCHES), dtype=np.uint64, endpoint=True)
XOR, ODD = _seeds[0][:, None], _seeds[1][:, None] | np.uint64(1)
STEP = (np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(1, 2 * SHINGLE + 2 * PICKED, dtype=np.uint64) + np.uint64(1)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(words: list[str]) -> np.ndarray:
    known = remembered("order_minhash", dict)
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        new = {w for w in words if w not in known}
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def labelled(words: list[str]) -> np.ndarray:
    """A hash per shingle and occurrence, in text order; a text of fewer words is one shingle."""
    h = word_hashes(words)
    if len(h) < SHINGLE:
        s = mixed((h * STEP[:len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    else:
        n = len(h) - SHINGLE + 1
        s = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            s += h[k:k + n] * STEP[k]
        s = mixed(s)
    order = np.argsort(s, kind="stable")
    again = np.concatenate([[False], s[order[1:]] == s[order[:-1]]])
    if again.any():
        at = np.arange(len(s))
        begin = np.maximum.accumulate(np.where(again, 0, at))
        seen = np.empty(len(s), np.uint64)
        seen[order] = (at - begin).astype(np.uint64)
        s = mixed(s + seen * STEP[-1])
    return s


def smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the ``k`` smallest values, in ascending place."""
    n = values.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), (len(values), n))
    if n <= 512:
        return np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1)
    low = np.uint64(int(2**64 * min(0.999, 6 * k / n)))
    out = np.empty((len(values), k), np.int64)
    for j, row in enumerate(values):
        at = np.flatnonzero(row < low)
        if len(at) < k:
            at = np.arange(n)
        out[j] = np.sort(at[np.argpartition(row[at], k - 1)[:k]]) if len(at) > k else at
    return out


def sketches(s: np.ndarray) -> np.ndarray:
    """Bucket keys of a document; small documents have keys of single shingles, so that those near the limit have both."""
    keys = []
    for limit, count, picked in ((len(s) < SHORT, SHORT_SKETCHES, 1), (len(s) >= SIMILARITY * SHORT, SKETCHES, PICKED)):
        if limit:
            at = smallest((s ^ XOR[:count]) * ODD[:count], picked)
            parts = s[at]
            keys.append(mixed((parts * STEP[:parts.shape[1]]).sum(1, dtype=np.uint64) + STEP[picked] + np.arange(count, dtype=np.uint64) * STEP[-2]))
    return np.concatenate(keys).view(np.int64)


def aligned(a: list, b: list, least: float = SIMILARITY) -> float:
    """Similarity of two sequences if it is at least ``least``, else 0.

    The longest common subsequence, row by row with the bits of one integer. Similar
    sequences differ in at most (n + m)(1 - s) / (1 + s) insertions and deletions, so
    the alignment is sought in the diagonal band of that width only.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    bound = sum((Counter(a) & Counter(b)).values())
    if bound < least * (n + m - bound):
        return 0.0
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head:n - tail], b[head:m - tail]
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    where: dict = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    stripe, v = (1 << 2 * band + 1) - 1, full
    for j, c in enumerate(y):
        if c in where:
            u = v & where[c] & (stripe << j >> band)
            if u:
                v = (v + u | v - u) & full
    common = head + tail + len(x) - v.bit_count()
    similarity = common / (n + m - common)
    return similarity if similarity >= least else 0.0


def sketched(docs: DataFrame) -> DataFrame:
    """(id, digest, n, keys): digest is null for a null text; without a word the digest is the text's own and there are no keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices_of(whole, "text"):
                digest, size, keys, ends = [], [], [np.zeros(0, np.int64)], [0]
                for text in b.column("text").to_pylist():
                    words = WORDS.findall(text.lower()) if text else []
                    if words:
                        digest.append(xxhash.xxh3_128_digest(" ".join(words)))
                        s = labelled(words)
                        size.append(len(s))
                        keys.append(sketches(s))
                    else:
                        digest.append(None if text is None else xxhash.xxh3_128_digest("\n" + text))
                        size.append(0)
                        keys.append(keys[0])
                    ends.append(ends[-1] + len(keys[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), lists],
                                                 names=["id", "digest", "n", "keys"])

    return docs.mapInArrow(run, "id bigint, digest binary, n int, keys array<bigint>")


def sequences(texts: DataFrame) -> DataFrame:
    """(id, seq): the labelled shingles of a text in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices_of(whole, "text"):
                rows = [labelled(WORDS.findall(t.lower())).view(np.int64) for t in b.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, rows)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "seq"])

    return texts.mapInArrow(run, "id bigint, seq array<bigint>")


def verified(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sequences align."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # one pair at a time becomes Python numbers
            good = [aligned(np.array(x.values).tolist(), np.array(y.values).tolist(), least) > 0 for x, y in zip(b.column("seq_a"), b.column("seq_b"))]
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(seqs.select(F.col("id").alias("a"), F.col("seq").alias("seq_a")), "a")
    both = with_a.join(seqs.select(F.col("id").alias("b"), F.col("seq").alias("seq_b")), "b")
    return both.select("a", "b", "seq_a", "seq_b").mapInArrow(run, "a bigint, b bigint")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles each of ``left`` shares with each of ``right``."""
    rows = left + right
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column = np.unique(np.concatenate(rows), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + COLUMNS))
        hot = np.zeros((len(rows), COLUMNS), np.float32)
        hot[owner[at:end], column[at:end] - column[at]] = 1
        out += hot[:len(left)] @ hot[len(left):].T
        at = end
    return out


def dealt(members: DataFrame) -> DataFrame:
    """Members with their block ``x`` of the bucket, once for every block ``y`` of it."""
    n = F.ceil(F.col("size") / BLOCK)
    return (members.withColumn("x", F.pmod(F.xxhash64("id"), n)).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
            .select("key", "id", "component", "x", "y"))


def dealt_by_length(members: DataFrame, least: float) -> DataFrame:
    """The same with blocks of one class of lengths each. A class spans a factor of ``least``, so similar documents are of the same
    or of neighbouring classes and blocks of other classes needn't meet."""
    length = F.floor(F.log("n") / math.log(1 / least) + 1e-9)
    classed = members.select("key", "id", "component", length.alias("c"))
    blocks = classed.groupBy("key", "c").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    place = lambda c, k: c * F.lit(1 << 32) + k
    other = blocks.select("key", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"), F.col("c").alias("d"), F.col("n").alias("m"))
    mine = classed.join(blocks, ["key", "c"]).withColumn("x", place(F.col("c"), F.pmod(F.xxhash64("id"), F.col("n"))))
    met = mine.join(other, ["key", "c"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    return met.select("key", "id", "component", "x", place(F.col("d"), F.col("k")).alias("y"))


def linked_in_blocks(members: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between members of different components in a bucket; as many as connect them, not all.

    A bucket is dealt in blocks, and every two blocks that may hold a link meet in a group of their own. The numbers of shared shingles
    bound the similarity of all pairs of a group at once; only pairs within the bound that aren't connected yet are aligned.
    """
    met = dealt(members.where(F.col("size") <= LARGE)).unionByName(dealt_by_length(members.where(F.col("size") > LARGE), least))
    met = met.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "component").join(seqs, "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, component, x = (np.array(t.column(c)) for c in ("id", "component", "x"))
        seq = [np.array(r.values) for r in t.column("seq")]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left = np.flatnonzero(x == i)
        right = left if i == j else np.flatnonzero(x == j)
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            size = np.array([len(r) for r in seq])
            common = shared_counts([seq[k] for k in left], [seq[k] for k in right])
            bound = common / (size[left][:, None] + size[right][None] - common)
            near = (bound >= least - 1e-6) & (component[left][:, None] != component[right][None])
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for u, v in zip(*np.nonzero(near)):
                p, q = int(left[u]), int(right[v])
                c, d = find(int(component[p])), find(int(component[q]))
                if c != d and aligned(seq[p].tolist(), seq[q].tolist(), least):
                    root[max(c, d)] = min(c, d)
                    edges.append((int(ids[p]), int(ids[q])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return met.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def led(members: DataFrame, turn: int) -> DataFrame:
    """Members of the buckets that still hold several components, each with the bucket's leader of this turn."""
    leader = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n")).alias("l"),
                                        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    leader = leader.where("low <> high").select("key", F.col("l.id").alias("leader"), F.col("l.n").alias("leader_n"), "size")
    return members.join(leader, "key")


def close(n: str, m: str, least: float) -> Column:
    return F.least(n, m) >= F.greatest(n, m) * least


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, component_id, kept), one row for each row of ``docs``.

    ``class_id`` is the smallest id with the same words, ``component_id`` the smallest id reachable over similar documents,
    ``kept`` marks it. Words are lower-cased runs of letters and digits. Texts without a word are copies of equal texts
    only; a null text or null id is alone and kept. Rows that repeat an id count as one document: any link of one
    holds for all. An empty table gives no row; other columns are not read.

    No pair of candidates is dropped. First a leader of each bucket meets its members, and what that links becomes one component; buckets
    of a single component, as groups of copies mostly are, are done. In the others all members of different components are
    compared, block by block; in large buckets only blocks whose lengths allow a link meet.
    """
    few_at_once(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketch = saved(sketched(d.where("id IS NOT NULL")))
    classes = saved(sketch.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("id", "n", "keys")).alias("m"))
                    .select("digest", F.col("m.id").alias("id"), F.col("m.n").alias("n"), F.col("m.keys").alias("keys")))
    keyed = classes.select(F.explode("keys").alias("key"), "id", "n", F.col("id").alias("component"))
    members = saved(led(keyed, 0))
    texts = d.join(sized(members.select("id").distinct(), 1_000_000), "id", "left_semi").where("text IS NOT NULL")
    seqs = saved(sequences(texts))
    meet = members.where((F.col("id") != F.col("leader")) & close("n", "leader_n", least)).select("id", F.col("leader").alias("other"))
    pairs = meet.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    edges = saved(verified(pairs, seqs, least))
    labels = components(edges)
    rest = members.select("key", "id", "n").join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    rest = saved(led(rest, 1))
    more = saved(linked_in_blocks(rest, seqs, least))
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    known = classes.select("digest", F.col("id").alias("class_id"))
    known = known.join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    rows = sketch.select("id", "digest").join(known, "digest", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component", "class_id", "id").alias("component_id"))
    rows = rows.withColumn("kept", F.col("id") == F.col("component_id"))
    alone = d.where("id IS NULL").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(alone).withColumnRenamed("id", id_col)
