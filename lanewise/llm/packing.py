"""Mixture-controlled packing of documents into sequences of a fixed length.

Every source is a queue. A window is a run of whole sequences; in each window a
queue is served by its quantum, the target share of the window's tokens, and what
rounding leaves open stays as the queue's deficit for the next window. With R
windows and T tokens in a queue, the served amount after r windows is
floor(r * T / R): the deficit carried over in closed form. So the place of every
token follows from its position in its queue alone, and all partitions pack at
once, without passing tokens between tasks.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lanewise.llm.byte_bpe import WORD, ChunkEncoder, encoder
from lanewise.llm.common import saved, slices_of

LENGTH = 1024
QUEUES = 4096  # a source with at least this part of all tokens has a queue of its own; all the others share one


class LibraryEncoder(ChunkEncoder):
    """New chunks go to a tokenizer library, those with a leading space in one text: before such a space words always end."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken  # with the vocabulary of ``path``; ids are merge ranks there
        self.library = tiktoken.Encoding("file", pat_str=WORD.pattern, mergeable_ranks=self.vocabulary.ids, special_tokens={})
        self.sizes = np.zeros(max(self.vocabulary.tokens) + 1, np.int64)
        for i, b in self.vocabulary.tokens.items():
            self.sizes[i] = len(b)

    def learn(self, chunks: set[str]) -> None:
        joined = [c for c in chunks if c[0] == " " and len(c) < 1000 and not c[1:2].isspace() and len(c) > 1]
        if joined:
            ids = np.array(self.library.encode_ordinary("".join(joined)), "<u4")
            ends = np.searchsorted(self.sizes[ids].cumsum(), np.cumsum([len(c.encode()) for c in joined])) + 1
            blob, at = ids.tobytes(), 0
            for c, end in zip(joined, ends.tolist()):
                self.known[c] = blob[4 * at:4 * end]
                at = end
        for c in [c for c in chunks if c not in self.known]:
            self.known[c] = np.array(self.library.encode_ordinary(c) if len(c) < 1000 else self.long(c), "<u4").tobytes()

    def long(self, chunk: str) -> list[int]:
        """A run that isn't a word of any language goes through the trie, whose cost grows with its length only."""
        words = WORD.findall(chunk)
        ids = self.trie.encode({w.encode() for w in words})
        return [i for w in words for i in ids[w.encode()]]


def phases(totals: list[int], weights: list[float]) -> list[list[int]]:
    """Tokens that each queue gives while the same queues last: with weights, a queue that runs dry ends a phase.

    At most one phase per queue. Weights in proportion to the totals make a single phase.
    """
    left, out = list(totals), []
    while any(left):
        span = min(t / w for t, w in zip(left, weights) if t and w > 0) if any(t and w > 0 for t, w in zip(left, weights)) else None
        if span is None:  # only queues without a share are left: they go on in proportion to what they hold
            out.append(left)
            break
        take = [t if w > 0 and t / w <= span * (1 + 1e-12) else min(t, int(w * span)) if w > 0 else 0 for t, w in zip(left, weights)]
        out.append(take)
        left = [t - x for t, x in zip(left, take)]
    return out


class Plan:
    """Where the token at a position of a queue goes."""

    def __init__(self, parts: list[list[int]], window: int):
        self.totals = [np.array(p, np.int64) for p in parts]
        self.rounds = [max(1, -(-sum(p) // window)) for p in parts]
        self.begin = np.cumsum([0, *(sum(p) for p in parts)]).tolist()
        held = np.array(parts, np.int64).reshape(len(parts), -1)
        self.queue_begin = np.concatenate([np.zeros((1, held.shape[1]), np.int64), held.cumsum(0)]).T.tolist()
        self.first = np.cumsum([0, *self.rounds]).tolist()
        self.known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def served(self, phase: int, r: int) -> np.ndarray:
        t, n = self.totals[phase], self.rounds[phase]
        return t // n * r + t % n * r // n

    def window(self, phase: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """What each queue has given before window ``r``, and where its part of the window begins."""
        if (phase, r) not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            before, after = self.served(phase, r), self.served(phase, r + 1)
            part = after - before
            self.known[phase, r] = before, self.begin[phase] + before.sum() + part.cumsum() - part
        return self.known[phase, r]

    def pieces(self, queue: int, at: int, n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, global position, window) of the runs that tokens ``at``..``at + n`` of a queue fall into."""
        done = 0
        while done < n:
            x = at + done
            phase = bisect_right(self.queue_begin[queue], x) - 1
            y = x - self.queue_begin[queue][phase]
            total, rounds = int(self.totals[phase][queue]), self.rounds[phase]
            r = ((y + 1) * rounds - 1) // total
            before, place = self.window(phase, r)
            end = (r + 1) * total // rounds
            g = int(place[queue]) + y - int(before[queue])
            take = min(n - done, end - y, length - g % length)
            yield done, take, g, self.first[phase] + r
            done += take


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source",
         length: int = LENGTH, window: int = 64, end_id: int = 0, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens, ``window`` sequences to a window.

    Columns: id, start, length, doc_tokens, sequence_id, offset, window, ids (binary, little-endian unsigned 32-bit).
    A document is its text's ids and ``end_id``; a null text counts as empty and still has that id. Null
    sources form a queue; repeated rows are separate documents; an empty table gives no piece; only the last
    sequence has padding. ``targets`` gives sources weights; without it all last until the end, so that each
    window holds the mixture of the whole corpus to within a token a source. A source outside ``targets`` gives its tokens
    after the others have run dry.

    Texts are encoded once: the ids wait in the shared folder while the totals of (task, source) become the
    base position of each task in each queue.
    """
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path, LibraryEncoder), TaskContext.get().partitionId(), {}
        tail = np.array([end_id], "<u4").tobytes()
        small = max(enc.vocabulary.tokens) < 65536
        for whole in batches:
            for b in slices_of(whole, "text"):
                found = [x + tail for x in enc.encode(b.column("text").to_pylist())]
                queues, before = b.column("queue").to_pylist(), []
                for q, x in zip(queues, found):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + len(x) // 4
                kept = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in found] if small else found
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * b.num_rows, pa.int32()), "id": b.column("id"), "queue": b.column("queue"),
                    "n": pa.array([len(x) // 4 for x in found], pa.int64()), "before": pa.array(before, pa.int64()),
                    "wide": pa.array([not small] * b.num_rows, pa.bool_()), "ids": pa.array(kept, pa.binary())})

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    stored = saved(docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text", f"CAST(`{queue_col}` AS string) AS queue")
                   .mapInArrow(tokens, f"part int, id {kind}, queue string, n bigint, before bigint, wide boolean, ids binary"))
    held = saved(stored.groupBy("part", "queue").agg(F.sum("n").alias("n")))
    by_source = saved(held.groupBy("queue").agg(F.sum("n").alias("n")))
    everything = by_source.agg(F.sum("n")).first()[0] or 0
    # at most QUEUES rows can hold that share each; named sources of ``targets`` come from the caller
    own = F.col("n") * QUEUES >= everything
    if targets:
        own = own | F.col("queue").isin(list(targets))
    large = sorted(by_source.where(own).select("queue", "n").collect(), key=lambda r: (r[0] is not None, r[0] or ""))
    totals = [r[1] for r in large] + [everything - sum(r[1] for r in large)]
    weights = [targets.get(r[0], 0.0) for r in large] + [0.0] if targets else [float(t) for t in totals]
    plan_parts = phases(totals, weights) or [[0] * len(totals)]

    number = spark.createDataFrame([(r[0], i) for i, r in enumerate(large)], "name string, q int")
    known = held.join(F.broadcast(number), F.col("queue").eqNullSafe(F.col("name")), "left").select(
        "part", "queue", "n", F.coalesce("q", F.lit(len(large))).alias("q"))
    per_part = known.groupBy("part", "q").agg(F.sum("n").alias("n"))
    per_part = per_part.select("part", "q", (F.sum("n").over(Window.partitionBy("q").orderBy("part")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("part", "q").orderBy(F.col("queue").asc_nulls_first())
    base = saved(known.withColumn("inner", F.sum("n").over(inside) - F.col("n")).join(per_part, ["part", "q"])
                 .select(F.col("part").alias("p"), F.col("queue").alias("s"), "q", (F.col("base") + F.col("inner")).alias("base")))
    window_tokens = window * length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(plan_parts, window_tokens)
        for b in batches:
            out: list[tuple] = []
            size = 0
            for doc, q, at, n, wide, ids in zip(*(b.column(c).to_pylist() for c in ("id", "q", "at", "n", "wide", "ids"))):
                values = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                for start, take, g, w in plan.pieces(q, at, n, length):
                    out.append((doc, start, take, n, g // length, g % length, w, values[start:start + take].tobytes()))
                    size += take
                if size > 1_000_000:
                    yield table(out)
                    out, size = [], 0
            if out:
                yield table(out)

    id_type = docs.select(F.col(f"`{id_col}`").alias("id")).schema
    from pyspark.sql.pandas.types import to_arrow_type
    arrow_id = to_arrow_type(id_type["id"].dataType)
    fields = pa.schema([("id", arrow_id), *((c, pa.int64()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "window")),
                        ("ids", pa.binary())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    ready = stored.join(base, (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("s"))).select(
        "id", "q", (F.col("base") + F.col("before")).alias("at"), "n", "wide", "ids")
    out = ready.mapInArrow(place, f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
                                  "offset bigint, window bigint, ids binary")
    return out.withColumnRenamed("id", id_col)
