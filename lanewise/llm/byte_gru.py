"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word forwards and backwards, labels every
byte, and a document's probabilities are the mean over all its labelled bytes.
Its state restarts at each word, so equal words have equal labels and a worker
computes each only once while it remembers it.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanewise.llm.common import remembered, slices_of

UND = "und"
WORDS = re.compile(r"[^\W\d_]+")
PART = 24  # characters; longer runs of letters, as in scripts without spaces, are read in parts
KEPT = 300_000  # words that a worker remembers


@dataclass
class Model:
    """Weights: per direction an input table (byte -> gates), recurrent matrix and bias; then the output layer."""
    languages: list[str]
    forward: dict[str, np.ndarray] = field(default_factory=dict)
    backward: dict[str, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    bias: np.ndarray | None = None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gates(w: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for a batch: update gate, reset gate, candidate, and the recurrent part of the candidate."""
    n = h.shape[1]
    a, r = w["x"][x], h @ w["h"]
    zr = sigmoid(a[:, :2 * n] + r[:, :2 * n])
    inner = r[:, 2 * n:] + w["b"]
    c = np.tanh(a[:, 2 * n:] + zr[:, n:] * inner)
    return zr[:, :n], zr[:, n:], c, inner


def run(w: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States after every step of ``x`` (words x steps); masked steps leave the state as it is."""
    n = w["h"].shape[0]
    h, states, tape = np.zeros((len(x), n), np.float32), [], []
    for t in range(x.shape[1]):
        z, r, c, inner = gates(w, x[:, t], h)
        m = mask[:, t:t + 1]
        new = h + m * z * (c - h)
        if keep:
            tape.append((h, z, r, c, inner, m, x[:, t]))
        h = new
        states.append(h)
    return np.stack(states, 1), tape


def back(w: dict, tape: list, gradient: np.ndarray) -> dict[str, np.ndarray]:
    """Backpropagation through time: gradients of ``w`` from those of all states."""
    out = {k: np.zeros_like(v) for k, v in w.items()}
    carry, inputs = np.zeros_like(gradient[:, 0]), []
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, c, inner, m, x = tape[t]
        g = carry + gradient[:, t]
        dc = g * m * z * (1 - c * c)
        dz = g * m * (c - h) * z * (1 - z)
        dr = dc * inner * r * (1 - r)
        rec = np.concatenate([dz, dr, dc * r], 1)
        inputs.append(np.concatenate([dz, dr, dc], 1))
        out["h"] += h.T @ rec
        out["b"] += (dc * r).sum(0)
        carry = g * (1 - m * z) + rec @ w["h"].T
    read = np.concatenate([step[-1] for step in reversed(tape)])
    out["x"] += (np.arange(256)[:, None] == read).astype(np.float32) @ np.concatenate(inputs)
    return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, the bytes of reversed words, and the mask, each words x longest."""
    most = max(map(len, words))
    x = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(-1, most)
    y = np.frombuffer(b"".join(w[::-1].ljust(most, b"\0") for w in words), np.uint8).reshape(-1, most)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return x, y, (np.arange(most) < size[:, None]).astype(np.float32)


def turn(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Backward states in the order of the bytes."""
    size = mask.sum(1).astype(np.int64)
    at = np.maximum(size[:, None] - 1 - np.arange(mask.shape[1]), 0)
    return np.take_along_axis(states, at[:, :, None], 1)


def fit(rows: list[tuple[str, str, int]], hidden: int = 16, steps: int = 500, batch: int = 256, rate: float = 0.01,
        seed: int = 7) -> Model:
    """Train on (word, language, count). The order of ``rows`` is no matter; the same rows give the same weights."""
    languages = sorted({r[1] for r in rows})
    model = Model(languages)
    rows = sorted(r for r in rows if r[0])
    if not rows:
        return model
    rng = np.random.default_rng(seed)
    words = [r[0][:PART].encode()[:4 * PART] for r in rows]
    target = np.array([languages.index(r[1]) for r in rows])
    weight = np.sqrt(np.array([r[2] for r in rows], float))
    for k in range(len(languages)):  # every language counts the same
        weight[target == k] /= weight[target == k].sum()
    weight /= weight.sum()
    n, k = hidden, len(languages)
    init = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    for side in (model.forward, model.backward):
        side |= {"x": init(256, 3 * n), "h": init(n, 3 * n), "b": np.zeros(n, np.float32)}
    model.out, model.bias = init(2 * n, k), np.zeros(k, np.float32)
    held = [*model.forward.values(), *model.backward.values(), model.out, model.bias]
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    for step in range(1, steps + 1):
        pick = rng.choice(len(rows), batch, p=weight)
        x, y, mask = padded([words[i] for i in pick])
        f, ft = run(model.forward, x, mask, True)
        b, bt = run(model.backward, y, mask, True)
        states = np.concatenate([f, turn(b, mask)], 2)
        logits = states @ model.out + model.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[np.arange(batch), :, target[pick]] -= 1
        d = p * (mask / mask.sum())[:, :, None]
        ds = d @ model.out.T
        gf = back(model.forward, ft, ds[:, :, :n])
        gb = back(model.backward, bt, turn(ds[:, :, n:], mask) * mask[:, :, None])
        grads = [*gf.values(), *gb.values(), states.reshape(-1, 2 * n).T @ d.reshape(-1, k), d.sum((0, 1))]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(held, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= (pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def label(model: Model, words: list[bytes]) -> np.ndarray:
    """Per word the sum over its bytes of the probabilities of each language."""
    out = np.zeros((len(words), len(model.languages)))
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    for at in range(0, len(order), 2048):
        part = order[at:at + 2048]
        x, y, mask = padded([words[i] for i in part])
        states = np.concatenate([run(model.forward, x, mask)[0], turn(run(model.backward, y, mask)[0], mask)], 2)
        logits = states @ model.out + model.bias
        p = np.exp(logits - logits.max(2, keepdims=True))
        out[part] = (p / p.sum(2, keepdims=True) * mask[:, :, None]).sum(1)
    return out


class Labeller:
    """Pools the labels of documents; remembers words."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.table = np.zeros((0, len(model.languages) + 1))

    def learn(self, words: list[str]) -> None:
        sums = np.zeros((len(words), self.table.shape[1]))
        parts, owner = [], []
        for i, w in enumerate(words):
            if any(map(str.isalpha, w)):
                for at in range(0, len(w), PART):
                    parts.append(w[at:at + PART].encode())
                    owner.append(i)
        if parts:
            found = label(self.model, parts)
            np.add.at(sums, owner, np.column_stack([found, list(map(len, parts))]))
        self.rows.update(zip(words, range(len(self.table), len(self.table) + len(words))))
        self.table = np.vstack([self.table, sums])

    def pooled(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UND, 0.0)] * len(texts)
        cut = [WORDS.findall(t.lower()) if t else [] for t in texts]
        wanted = set().union(*cut)
        missing = {w for w in wanted if w not in self.rows}
        if len(self.rows) + len(missing) > KEPT:
            self.rows, self.table, missing = {}, self.table[:0], wanted
        self.learn(sorted(missing))
        out = []
        for words in cut:
            total = self.table[list(map(self.rows.__getitem__, words))].sum(0) if words else np.zeros(self.table.shape[1])
            if total[-1] == 0:
                out.append((UND, 0.0))
            else:
                best = int(total[:-1].argmax())
                out.append((self.model.languages[best], float(min(1.0, total[best] / total[-1]))))
        return out


def training_words(docs: DataFrame, per_language: int = 400, words: int = 6000, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str, int]]:
    """The bounded training sample: words of at most ``per_language`` documents a language, at most ``words`` of them.

    Documents and words are drawn by hash; rows without text or label are left out.
    """
    d = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text", f"`{lang_col}` AS lang").where(
        "lang IS NOT NULL AND text IS NOT NULL")
    # first within 256 parts of a language, so that no task meets the best of every partition
    some = d.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(256)).alias("part"))
    for keys in (("lang", "part"), ("lang",)):
        draw = Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
        some = some.withColumn("k", F.row_number().over(draw)).where(F.col("k") <= per_language)
    chosen = some
    # at most per_language ids for each learned label
    texts = d.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi")
    counted = (texts.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
               .groupBy("lang", "word").count())
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("word"), "word")
    some = counted.withColumn("k", F.row_number().over(pick)).where(F.col("k") <= words)
    return [(r[0], r[1], r[2]) for r in some.select("word", "lang", "count").collect()]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text.

    ``und`` with score 0 for a null text, a text without letters, or a model
    without languages. Ties go to the alphabetically first language. Repeated
    rows are predicted each; other columns are not read.
    """
    key = f"{id(model)}-{hash(tuple(model.languages))}-{float(np.abs(model.out).sum()) if model.out is not None else 0}"

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = remembered(key, lambda: Labeller(model))
        for whole in batches:
            for b in slices_of(whole, "text"):
                found = labeller.pooled(b.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "lang_pred": pa.array([x[0] for x in found], pa.string()),
                                                  "score": pa.array([x[1] for x in found], pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(pool, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
