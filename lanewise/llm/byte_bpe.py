"""Byte-level BPE by prefix-sharing trie traversal.

A text is cut at white space into chunks, equal chunks are encoded once. The
distinct words of new chunks form a trie that is walked depth first. The state
of a node is the last token of the encoding of its prefix: the one token t that
ends the prefix and that byte-pair merging leaves apart from the last token
before it. The encoding of a prefix is then the chain of last tokens, and words
with a common prefix share the states of its nodes.
"""
from __future__ import annotations

import json
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lanewise.llm.common import remembered, slices_of

WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# a cut here never falls inside a word; its white space is that of WORD but for four separators
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
SEPARATORS = re.compile("[\x1c-\x1f]")
KEPT = 400_000  # pairs that a worker remembers, times four
ENTRY = 200  # bytes that a remembered chunk takes besides its text and ids
KEPT_BYTES = 80_000_000  # memory of the chunks that a worker remembers, about


def byte_of() -> dict[str, int]:
    """Which byte each character of the vocabulary file stands for: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


CODE = byte_of()


def raw(shown: str) -> bytes:
    return bytes(CODE[c] for c in shown)


class Vocabulary:
    """Tokens as bytes, merge ranks and special tokens of a tokenizer file. Merges are read when something asks for them."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = {i: s.encode() for s, i in self.special.items()}
        self.tokens = {i: b for b, i in self.ids.items()} | special
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """(token, token) -> rank of their merge."""
        with open(self.path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        split = (m.split(" ") if isinstance(m, str) else m for m in merges)
        return {(self.ids[raw(a)], self.ids[raw(b)]): rank for rank, (a, b) in enumerate(split)}

    @cached_property
    def made(self) -> dict[int, tuple[int, int, int]]:
        """Token -> rank of the merge that makes it, and its parts."""
        return {self.ids[self.tokens[a] + self.tokens[b]]: (rank, a, b) for (a, b), rank in reversed(self.pairs.items())}

    @cached_property
    def unclear(self) -> set[int]:
        """Tokens that several merges make, and what is made of them."""
        counts = Counter(self.ids[self.tokens[a] + self.tokens[b]] for a, b in self.pairs)
        out = {t for t, n in counts.items() if n > 1}
        for token, (_, a, b) in sorted(self.made.items(), key=lambda x: x[1][0]) if out else ():
            if a in out or b in out:
                out.add(token)
        return out

    def merged(self, data: bytes) -> list[int]:
        """Byte-pair merging as defined: the lowest-ranked pair first, from the left."""
        parts = [self.ids[data[i:i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [self.pairs.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            best = min(ranked)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranked) and ranked[i] == best:
                    out.append(self.ids[self.tokens[parts[i]] + self.tokens[parts[i + 1]]])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts


class TrieEncoder:
    """Encodes sets of words; remembers which neighbouring tokens stay apart."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.apart: dict[int, bool] = {}

    @cached_property
    def tails(self) -> dict[bytes, int]:
        """Every end of a token, with the token's id if it is a whole one: a walk back from a place stops where no token goes on."""
        ids = self.vocabulary.ids
        out = {t[i:]: -1 for t in ids for i in range(1, len(t))}
        out.update(ids)
        return out

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens yields just these two; ``left`` -1 stands for the word's start."""
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= 4 * KEPT:
                self.apart.clear()
            v = self.vocabulary
            if left < 0:
                known = v.merged(v.tokens[right]) == [right]
            elif not self.stays_apart(-1, right):
                known = False
            elif left in v.unclear or right in v.unclear:
                known = v.merged(v.tokens[left] + v.tokens[right]) == [left, right]
            else:
                known = self.never_met(left, right)
            self.apart[key] = known
        return known

    def never_met(self, left: int, right: int) -> bool:
        """Undoes merges from the last one back. The neighbours at the border would have been merged if their pair comes before the
        merge undone last; of equal ranks the one further left comes first."""
        pairs, made = self.vocabulary.pairs, self.vocabulary.made
        limit, alone = 1 << 60, (-1, 0, 0)
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            a, b = made.get(left, alone), made.get(right, alone)
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def last_token(self, word: bytes, end: int, states: list[int]) -> int:
        tails, found, start = self.tails, [], end - 1
        while start >= 0 and (token := tails.get(word[start:end])) is not None:
            if token >= 0:
                found.append((start, token))
            start -= 1
        for start, token in reversed(found):
            if self.stays_apart(states[start], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Token ids of every word.

        Sorted words are the trie's leaves in preorder; ``states`` holds the
        nodes from the root to the current one. What the next word shares with
        the path stays, the rest is dropped and walked anew.
        """
        out, path, states = {}, b"", [-1]
        tokens = self.vocabulary.tokens
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                states.append(self.last_token(word, end, states))
            path, at, ids = word, len(word), []
            while at:
                ids.append(states[at])
                at -= len(tokens[states[at]])
            out[word] = ids[::-1]
        return out


class ChunkEncoder:
    """Texts to little-endian 32-bit ids; equal chunks are encoded once while the worker remembers them."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.trie = TrieEncoder(self.vocabulary)
        self.known: dict[str, bytes] = {}
        self.held = 0

    @cached_property
    def pool(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes on end, where each begins and how long it is."""
        tokens = self.vocabulary.tokens
        sizes = np.zeros(max(tokens) + 1, np.int64)
        sizes[list(tokens)] = [len(b) for b in tokens.values()]
        return np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8), sizes.cumsum() - sizes, sizes

    def cut(self, text: str) -> list[str]:
        special = self.vocabulary.special
        if self.vocabulary.split_special and any(s in text for s in special):
            return [c for part in self.vocabulary.split_special.split(text) if part
                    for c in ([part] if part in special else self._cut_plain(part))]
        return self._cut_plain(text)

    def _cut_plain(self, text: str) -> list[str]:
        return WORD.findall(text) if SEPARATORS.search(text) else CHUNK.findall(text)

    def learn(self, chunks: set[str]) -> None:
        words = {c: WORD.findall(c) for c in chunks}
        ids = self.trie.encode({w.encode() for ws in words.values() for w in ws})
        blob = {w: struct.pack(f"<{len(i)}I", *i) for w, i in ids.items()}
        self.known.update((c, b"".join([blob[w.encode()] for w in ws])) for c, ws in words.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) if t else [] for t in texts]
        rows = [list(map(self.known.get, c)) for c in cut]
        gaps = [[i for i, x in enumerate(row) if x is None] if None in row else [] for row in rows]
        missing = {c[i] for c, gap in zip(cut, gaps) for i in gap}
        new = sum(map(len, missing)) * 4 + ENTRY * len(missing)
        if self.held + new > KEPT_BYTES:
            self.known.clear()
            self.held = 0
        self.held += new
        special = self.vocabulary.special
        for s in missing & special.keys():
            self.known[s] = np.array([special[s]], "<u4").tobytes()
        self.learn(missing - special.keys())
        for row, c, gap in zip(rows, cut, gaps):
            for i in gap:
                row[i] = self.known[c[i]]
        return [b"".join(row) for row in rows]

    def decode(self, ids: bytes) -> str:
        pool, begin, size = self.pool
        every, out = np.frombuffer(ids, "<u4"), []
        for some in (every[i:i + 50_000] for i in range(0, len(every), 50_000)):
            n = size[some]
            ends = n.cumsum()
            out.append(pool[np.repeat(begin[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def encoder(path: str, kind: type = ChunkEncoder) -> ChunkEncoder:
    """One per worker process and file: what it has learned serves its later tasks."""
    return remembered((kind, path), lambda: kind(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids binary of little-endian unsigned 32-bit ids[, decoded text]) of every row's whole text.

    A null or empty text has no ids; repeated rows give repeated results; no row is
    dropped; other columns, whatever their names, are not read. An occurrence of
    a special token's string is that token, as in the tokenizer library.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for b in slices_of(whole, "text"):
                ids = enc.encode(b.column("text").to_pylist())
                columns = {"id": b.column("id"), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    columns["decoded"] = pa.array(map(enc.decode, ids), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(
        run, f"id {kind}, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of rows with ``ids`` as ``encode`` makes them; null ids give an empty text, broken UTF-8 replacement characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "text": pa.array(texts, pa.string())})

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.selectExpr(f"`{id_col}` AS id", "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
