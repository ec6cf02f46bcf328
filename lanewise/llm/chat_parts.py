"""Chat formatting over typed content parts.

A message is a list of parts: text, image, audio or document. A visitor walks the parts of each message in order, writes texts
escaped and attachments as placeholders, and notes for every attachment its reference, place and expanded token count, and for every
text to be learned its span. The formatted conversation is the concatenation of its messages' pieces by place; it can be read back
without loss.

Format of a message: ``<|turn|>``, the role, a line end, the parts, ``<|end|>`` and a line end. Every mark begins with ``<``. In roles
and texts ``\\`` becomes ``\\\\`` and ``<`` becomes ``\\<``, so no text makes a mark, also not across the border of two parts; in roles a
line end becomes ``\\n``.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanewise.llm.common import saved

TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<type: string, text: string, ref: string, width: bigint, height: bigint, seconds: double, pages: bigint>"
SPANS = "array<struct<start: bigint, length: bigint>>"
ATTACHMENTS = "array<struct<part: int, type: string, ref: string, start: bigint, tokens: bigint>>"
ROWS = 256  # messages of one batch of results
MARK = re.compile(r"<\|([a-z]+)\|>")
ESCAPED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Expansion:
    """Tokens that a model puts in the place of an attachment. A missing or negative size counts as none; each takes one token at least."""
    patch: int = 28                 # pixels of an image patch's side
    audio_rate: float = 12.5        # tokens a second
    page_tokens: int = 512          # tokens of a document's page


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def escaped_role(role: str) -> str:
    return escaped(role).replace("\n", "\\n")


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


@dataclass
class Visitor:
    """Flattens the parts of one message: ``visit_<type>`` for each part, in order."""
    expansion: Expansion
    learn: bool
    out: list[str] = field(default_factory=list)
    at: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit(self, number: int, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(number, part)

    def visit_text(self, number: int, part: dict) -> None:
        text = escaped(part.get("text") or "")
        if self.learn and text:
            self.spans.append((self.at, len(text)))
        self.write(text)

    def visit_image(self, number: int, part: dict) -> None:
        sides = [math.ceil(max(part.get(c) or 0, 0) / self.expansion.patch) for c in ("width", "height")]
        self.attach(number, part, "image", sides[0] * sides[1])

    def visit_audio(self, number: int, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self.attach(number, part, "audio", math.ceil(seconds * self.expansion.audio_rate) if 0 < seconds < math.inf else 0)

    def visit_document(self, number: int, part: dict) -> None:
        self.attach(number, part, "document", max(part.get("pages") or 0, 0) * self.expansion.page_tokens)

    def visit_other(self, number: int, part: dict) -> None:
        self.attach(number, part, "other", 1)

    def attach(self, number: int, part: dict, mark: str, tokens: int) -> None:
        self.attachments.append({"part": number, "type": part["type"], "ref": part.get("ref"), "start": self.at, "tokens": max(tokens, 1)})
        self.write(f"<|{mark}|>")


def message(role: str | None, parts: list[dict | None] | None, learned: frozenset[str], expansion: Expansion) -> Visitor:
    """The visitor after a whole message. A null role or list of parts is an empty one, a null part an empty text."""
    role = role or ""
    v = Visitor(expansion, role in learned)
    v.write(f"{TURN}{escaped_role(role)}\n")
    for number, part in enumerate(parts or []):
        v.visit(number, part or {})
    v.write(END)
    return v


def read_back(piece: str) -> tuple[str, list[tuple[str, str]]]:
    """(role, parts) of a formatted message; a part is ("text", its text) or (the placeholder's type, "")."""
    first = piece.index("\n")
    if not piece.startswith(TURN) or not piece.endswith(END):
        raise ValueError("not a formatted message")
    body, parts, at = piece[first + 1:-len(END)], [], 0
    for m in MARK.finditer(body):
        if _is_escape(body, m.start()):
            continue
        if m.start() > at:
            parts.append(("text", unescaped(body[at:m.start()])))
        parts.append((m[1], ""))
        at = m.end()
    if at < len(body):
        parts.append(("text", unescaped(body[at:])))
    return unescaped(piece[len(TURN):first]), parts


def _is_escape(text: str, at: int) -> bool:
    """Does an odd number of backslashes stand before?"""
    n = 0
    while n < at and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def text_parts(text: Column) -> Column:
    """The parts of a message that is one text."""
    empty = {c: F.lit(None).cast(t) for c, t in (x.split(": ") for x in PART[7:-1].split(", "))}
    return F.array(F.struct(*(c.alias(n) for n, c in {**empty, "type": F.lit("text"), "text": text}.items())))


def format_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                    learned: tuple[str, ...] = ("assistant",), expansion: Expansion = Expansion()) -> DataFrame:
    """One row per message: conv_id, turn, role, ``place`` (from 0 in its conversation), ``start`` (code points of the conversation before
    it), ``piece``, ``loss`` (spans in the piece), ``attachments`` (starts in the piece) and ``expanded_tokens``.

    ``parts`` is an array of ``PART``. Messages are ordered by turn (null first), then role and content, so rows that repeat are all
    kept and equal in place to one another. Rows with a null conversation are one conversation. Messages are dealt by ranges: a
    conversation with most of the rows is many tasks, and its starts are put together from the tasks' lengths. Other columns do not
    pass; an empty table gives an empty one.
    """
    rows = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"),
                           F.col(f"`{parts}`").cast(f"array<{PART}>").alias("parts"))
    order = ["conv_id", "turn", "role", "content"]  # a hash: texts are no bounds of ranges
    dealt = rows.withColumn("content", F.xxhash64("parts")).repartitionByRange(*order).sortWithinPartitions(*order, "parts")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = (f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, place bigint, start bigint, chars bigint, piece string, loss {SPANS}, "
              f"attachments {ATTACHMENTS}, expanded_tokens bigint")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, start = object(), 0, 0
        for batch in batches:
            for some in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                convs, made = some.column("conv_id").to_pylist(), []
                for c, r, p in zip(convs, some.column("role").to_pylist(), some.column("parts").to_pylist()):
                    if c != now:
                        now, place, start = c, 0, 0
                    v = message(r, p, frozenset(learned), expansion)
                    made.append((place, start, v.at, "".join(v.out), [{"start": a, "length": n} for a, n in v.spans], v.attachments,
                                 sum(x["tokens"] for x in v.attachments)))
                    place, start = place + 1, start + v.at
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("conv_id", "turn", "role")),
                                                  *(pa.array(x, t) for x, t in zip(zip(*made), ARROW))], names=NAMES)

    pieces = saved(dealt.mapInArrow(formatted, schema).withColumn("range", F.spark_partition_id()))
    return _joined(pieces)


ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])),
         pa.list_(pa.struct([("part", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])), pa.int64()]
NAMES = ["conv_id", "turn", "role", "place", "start", "chars", "piece", "loss", "attachments", "expanded_tokens"]


def _joined(pieces: DataFrame) -> DataFrame:
    """Places and starts counted on over the ranges. Only conversations that go on in a further range need it: one a range at most."""
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("conv_id", "range").agg(F.count("*").alias("rows"), F.sum("chars").alias("length"))
    bases = (sums.withColumns({"rows": F.sum("rows").over(before), "length": F.sum("length").over(before)}).where("rows IS NOT NULL")
             .select(F.col("conv_id").alias("of"), F.col("range").alias("in"), "rows", "length"))
    joined = pieces.join(saved(bases), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")), "left")
    return joined.select("conv_id", "turn", "role", (F.col("place") + F.coalesce("rows", F.lit(0))).alias("place"),
                         (F.col("start") + F.coalesce("length", F.lit(0))).alias("start"), "piece", "loss", "attachments", "expanded_tokens")


def digests(pieces: DataFrame) -> DataFrame:
    """What is read back from formatted messages, per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, expanded_tokens.

    A digest needs a conversation's messages one after another: they come sorted from the shuffle, and a task keeps a running state,
    never a conversation. Placeholders are no part of a turn's text.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, id_type = object(), None, [], None
        for batch in batches:
            id_type = batch.column("conv_id").type
            for c, piece, loss, tokens in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "piece", "loss", "expanded_tokens"))):
                if c != now or state is None:
                    if state is not None:
                        done.append((now, *state.row()))
                    now, state = c, _Running()
                state.add(piece, loss, tokens)
            if done:
                yield _batch(done, [id_type, *types[1:]], names)
                done = []
        if state is not None:
            yield _batch([(now, *state.row())], [id_type, *types[1:]], names)

    dealt = pieces.select("conv_id", "place", "piece", "loss", "expanded_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(read, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
                                  "expanded_tokens bigint")


class _Running:
    """Digests of the conversation so far."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.tokens = 0

    def add(self, piece: str, loss: list[dict], tokens: int) -> None:
        role, parts = read_back(piece)
        text = "".join(t for kind, t in parts if kind == "text")
        self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            learned = unescaped(piece[span["start"]:span["start"] + span["length"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.n_turns, self.chars, self.tokens = self.n_turns + 1, self.chars + len(piece), self.tokens + tokens

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.tokens


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
