"""License scanning by conditional compression.

A block of text is compressed alone and with each license template as the
dictionary of zstandard, in overlapping windows of a few templates' length, so
that the dictionary stays in reach in a block of any size. What a template saves
ranks the templates: text that repeats the template costs almost nothing. They
are confirmed in that order by the exact difference of the wordings, wherever a
run of words stands that no allowed difference can break up. Little saved alone
rules nothing out: a short notice beside long lines saves little.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lanewise.llm.common import slices_of

# Public license notices and the opening words of license texts
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                   'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-2.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as "
                 "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
                "this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer.", "Released under the BSD 3-Clause License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
}

CUE = re.compile(r"licen[cs]e|permission|redistribut|copyright|warrant|software|public domain|unencumbered|\bCC0?\b|creative commons|\bGPL|\bMIT\b|\bBSD\b|SPDX", re.I)
SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")
SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
WORD = re.compile(r"\w+(?:[.\-]\w+)*")
NAMING = re.compile(r"\d|\b(?:affero|lesser|noncommercial|sharealike|noderiv\w*|nc|sa|nd)\b")  # a difference in these is another license
BESIDE = 4  # lines before and after one with a cue that belong to its block
LINE = 200  # characters of a line that may go on a notice from the line beside it; longer ones are prose
WINDOW = 4  # of the longest template's words that are compressed together; windows overlap by one such length
AGREE = 0.9  # of a template's words, in order, that a block has to hold
KEPT = 32_000_000  # characters of blocks that a worker remembers


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    coder: zstandard.ZstdCompressor
    size: int
    slack: int  # words that a notice may have added
    run: int  # words that any notice has in common with the template without a break
    runs: dict[tuple[str, ...], list[int]]  # where in the template each run of that length begins


_plain: list[zstandard.ZstdCompressor] = []
_templates: dict[str, list[Template]] = {}
_known: dict[str, list[tuple]] = {}
_held = [0]  # characters of the blocks in _known


def plain(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def anchors(words: tuple[str, ...]) -> tuple[int, int, dict[tuple[str, ...], list[int]]]:
    """Added words allowed, the length of run that no allowed set of differences can break up, and where each such run begins."""
    n = len(words)
    slack, kept = int((1 - AGREE) * n + 0.5), math.ceil(AGREE * n)
    run = max(1, math.ceil(kept / (n - kept + slack + 1)))
    runs: dict[tuple[str, ...], list[int]] = {}
    for i in range(n - run + 1):
        runs.setdefault(words[i:i + run], []).append(i)
    return slack, run, runs


def templates(texts: dict[str, list[str]]) -> list[Template]:
    key = repr(texts)
    if key not in _templates:
        _templates.clear()
        _known.clear()
        _held[0] = 0
        _plain[:] = [zstandard.ZstdCompressor(level=9)]
        made = []
        for name, variants in texts.items():
            for t in variants:
                words = plain(t)
                coder = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                made.append(Template(name, w := tuple(words.split()), coder, len(_plain[0].compress(words.encode())), *anchors(w)))
        _templates[key] = made
    return _templates[key]


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(start, block): passages of lines with a cue and the lines next to them, and of long lines the sentences with a cue and their neighbours."""
    spans: list[tuple[int, int, bool]] = []
    at = 0
    for line in text.split("\n"):
        if len(line) > 600:
            begin = 0
            for m in SENTENCE.finditer(line):
                spans.append((at + begin, at + m.start(), bool(CUE.search(line, begin, m.start()))))
                begin = m.end()
            spans.append((at + begin, at + len(line), bool(CUE.search(line, begin))))
        elif line.strip():
            spans.append((at, at + len(line), bool(CUE.search(line))))
        at += len(line) + 1
    run: list[tuple[int, int]] = []
    for i, (a, b, cue) in enumerate(spans):
        beside = any(x[2] for x in spans[max(0, i - BESIDE):i + BESIDE + 1])
        near = cue or beside and b - a <= LINE
        if near:
            run.append((a, b))
        elif run:
            yield run[0][0], text[run[0][0]:run[-1][1]]
            run = []
    if run:
        yield run[0][0], text[run[0][0]:run[-1][1]]


def confirmed(words: list[str], t: Template) -> tuple[float, int, int, list[str], list[str]] | None:
    """How much of the template stands in ``words``, from which to which word, and the words lacking and added between them."""
    common = set(t.words)
    window = len(t.words)
    if sum(w in common for w in words) < AGREE * window:
        return None
    m = SequenceMatcher(None, t.words, words, autojunk=False)
    found = [b for b in m.get_matching_blocks() if b.size]
    # a lone word far from the rest isn't part of the notice
    while len(found) > 1 and found[0].size < 3 and found[1].b - found[0].b - found[0].size > 5:
        found = found[1:]
    while len(found) > 1 and found[-1].size < 3 and found[-1].b - found[-2].b - found[-2].size > 5:
        found = found[:-1]
    share = sum(b.size for b in found) / window
    if share < AGREE:
        return None
    first, last = found[0].b, found[-1].b + found[-1].size
    kept = {i for b in found for i in range(b.a, b.a + b.size)}
    used = {i for b in found for i in range(b.b, b.b + b.size)}
    return share, first, last, [w for i, w in enumerate(t.words) if i not in kept], [w for i, w in enumerate(words[first:last], first) if i not in used]


Place = tuple[int, int]  # where a run begins in the text and in the template


def anchored(words: list[str], all_templates: list[Template]) -> dict[int, list[Place]]:
    """For each template, by its number, where its runs stand in ``words``."""
    out: dict[int, list[Place]] = {}
    for run in {t.run for t in all_templates}:
        begins: dict[tuple[str, ...], list[Place]] = {}
        for i, t in enumerate(all_templates):
            if t.run == run:
                for key, at in t.runs.items():
                    begins.setdefault(key, []).extend((i, a) for a in at)
        first = {key[0] for key in begins}
        for b, w in enumerate(words):
            if w in first:
                for i, a in begins.get(tuple(words[b:b + run]), ()):
                    out.setdefault(i, []).append((b, a))
    return out


def notices(words: list[str], t: Template, places: list[Place]) -> Iterator[tuple[float, int, int, list[str], list[str]]]:
    """Every copy of the template in ``words``: each place where a run of it stands is confirmed by itself, in a window of one copy's length."""
    at, tried = 0, set()
    for b, a in places:
        if b < at:
            continue  # part of the copy before
        low = max(at, b - a - t.slack)
        if (low, b - a) in tried:
            continue
        tried.add((low, b - a))
        c = confirmed(words[low:b - a + len(t.words) + t.slack], t)
        if c and len(c[4]) <= t.slack and not NAMING.search(" ".join(c[3] + c[4])):
            yield c[0], low + c[1], low + c[2], c[3], c[4]
            at = low + c[2]


def savings(words: list[str], places: dict[int, list[Place]], all_templates: list[Template]) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    """The step between windows, and for each window in which a run stands what (each template saves, the window costs alone)."""
    longest = max(len(t.words) + 2 * t.slack for t in all_templates)
    step = (WINDOW - 1) * longest
    last = max(0, -(-(len(words) - longest) // step) - 1)  # the window that reaches the end
    out: dict[int, list[tuple[int, int]]] = {}
    for at in sorted({min(b // step, last) for found in places.values() for b, _ in found}):
        data = " ".join(words[at * step:at * step + WINDOW * longest]).encode()
        alone = len(_plain[0].compress(data))
        out[at] = [(alone - len(t.coder.compress(data)), alone) for t in all_templates]
    return step, out


def match(block: str, all_templates: list[Template]) -> list[tuple]:
    """(license, start, end, share, saving, missing, added) of the notices in a block; of those that overlap the closest wording."""
    if block in _known:
        return _known[block]
    found: list[tuple] = [(m[1], m.start(), m.end(), 1.0, 1.0, [], []) for m in SPDX.finditer(block)]
    spots = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(block)]
    words = [p[2] for p in spots]
    places = anchored(words, all_templates)
    step, saved = savings(words, places, all_templates) if places else (1, {})
    best = {i: max(window[i][0] for window in saved.values()) / all_templates[i].size for i in places}
    for i in sorted(places, key=lambda i: (-best[i], i)):
        t = all_templates[i]
        for share, first, last, missing, added in notices(words, t, places[i]):
            saving, alone = max((saved[w][i] for w in (first // step - 1, first // step) if w in saved), key=lambda x: x[0] / x[1], default=(0, 1))
            found.append((t.license, spots[first][0], spots[last - 1][1], share, saving / alone, missing, added))
    kept: list[tuple] = []  # by place; they don't overlap
    for f in sorted(found, key=lambda f: (len(f[5]) + len(f[6]) > 0, -(f[2] - f[1]), len(f[5]) + len(f[6]), -f[4], f[0])):
        i = bisect_left(kept, f[1], key=lambda k: k[1])
        if (i == 0 or kept[i - 1][2] <= f[1]) and (i == len(kept) or f[2] <= kept[i][1]):
            insort(kept, f, key=lambda k: k[1])
    _held[0] += len(block)
    if _held[0] > KEPT:
        _known.clear()
        _held[0] = len(block)
    if len(block) <= KEPT:
        _known[block] = kept
    return kept


def scan(docs: DataFrame, texts: dict[str, list[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, start, end, share, saving, missing, added): every license notice in every whole text.

    ``start`` and ``end`` count characters from 0; ``share`` is the part of the template's words that are there in order, ``saving`` the
    part of the block's compressed size that the template saves; ``missing`` and ``added`` are the differing words. Null and
    empty texts have none, repeated rows are reported each, without templates only SPDX identifiers count. Other columns are not read.
    """
    fields = pa.schema([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("saving", pa.float64()),
                        ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = templates(texts)
        for whole in batches:
            for b in slices_of(whole, "text"):
                owner, rows = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for at, block in blocks(text) if text and CUE.search(text) else ():
                        for name, start, end, *more in match(block, known):
                            owner.append(i)
                            rows.append((name, at + start, at + end, *more))
                if rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)]
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner)), *columns], names=["id", *fields.names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.selectExpr(f"`{id_col}` AS id", f"CAST(`{text_col}` AS string) AS text").mapInArrow(
        run, f"id {kind}, license string, start bigint, end bigint, share double, saving double, missing array<string>, added array<string>")
    return out.withColumnRenamed("id", id_col)
