"""License scan by conditional compression.

Paragraphs, lines and sentences that mention licensing are candidate blocks; one
longer than twice the longest template is read in overlapping windows of that
size, so what prose stands around a notice, and how much, does not matter.  Each
block is compressed alone and once with every template as a zstandard raw
dictionary; templates are ranked by the bytes they save, as a share of what the
block takes alone.  Every template that saves bytes and whose words the block
holds is confirmed by its exact wording: the
block's words are aligned with the template's, and the differences (words
missing, words added inside) decide whether the notice is that license, exact
or reworded.

Defined results: a null or empty text has no blocks; a block that no template
explains gives no row; repeated rows give repeated results.  ``templates`` may be
replaced by the caller's own ``{(license, form): wording}``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontaminate import align

# fixed values: words that every notice holds one of
MENTIONS = ("licen", "copyright", "permission", "warrant", "public domain", "redistribut", "spdx", "creative commons",
            "all rights reserved", "cc by", "cc0")

# fixed values: public notice wordings
TEMPLATES = {
    ("Apache-2.0", "line"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "header"): (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    ("MIT", "line"): "Released under the MIT License.",
    ("MIT", "text"): (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "text"): (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "text"): (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "text"): (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."),
    ("BSD", "line"): "Released under the BSD License.",
    ("GPL-3.0", "line"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "header"): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."),
    ("GPL-2.0", "header"): (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version."),
    ("LGPL-3.0", "line"): "This work is licensed under the GNU Lesser General Public License, version 3.",
    ("AGPL-3.0", "line"): "This work is licensed under the GNU Affero General Public License, version 3.",
    ("MPL-2.0", "header"): (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "text"): "This is free and unencumbered software released into the public domain.",
    ("CC0-1.0", "line"): "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ("CC-BY-4.0", "line"): "Licensed under CC BY 4.0.",
    ("CC-BY-SA-4.0", "line"): "Licensed under CC BY-SA 4.0.",
    ("CC-BY-NC-4.0", "line"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "long"): "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ("CC-BY-SA-4.0", "long"): "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ("CC-BY-NC-4.0", "long"): "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ("proprietary", "line"): "All rights reserved.",
}

_WORD = re.compile(r"[^\W_]+(?:[.+][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def word_list(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """``(number of words before it, block)``: every paragraph of several lines
    that mentions licensing, then every line, then every sentence that does."""
    at = 0
    for par in _PARAGRAPH.split(text):
        if mentions(par):
            lines = par.split("\n")
            if len(lines) > 1:
                yield at, par
            for line in lines:
                size = len(word_list(line))
                if mentions(line):
                    yield at, line
                    parts = _SENTENCE.split(line)
                    before = at
                    for p in parts if len(parts) > 1 else []:
                        if mentions(p):
                            yield before, p
                        before += len(word_list(p))
                at += size
        else:
            at += len(word_list(par))


def windows(block: str, words: int) -> Iterator[tuple[int, str]]:
    """``(words before it, window)``: the whole block if it has at most twice
    ``words`` words, else overlapping windows of that size that mention licensing,
    so that anything of up to ``words`` words lies whole in one of them."""
    place = [m.span() for m in _WORD.finditer(block)]
    if len(place) <= 2 * words:
        yield 0, block
        return
    for at in range(0, len(place) - words, words):
        last = at + 2 * words >= len(place)
        part = block[place[at][0] if at else 0:len(block) if last else place[at + 2 * words - 1][1]]
        if mentions(part):
            yield at, part


def mentions(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in MENTIONS)


def lines_of(text: str, wanted: list[int]) -> list[int]:
    """The line of each word number in ``wanted``."""
    ends = np.cumsum([len(word_list(line)) for line in text.split("\n")])
    return np.searchsorted(ends, wanted, "right").tolist()


def best_places(hits: list[tuple]) -> list[tuple]:
    """Of hits ``(first word, end, size, ...)`` that share words the largest
    stays, of equal ones the last."""
    kept: list[tuple] = []
    for h in sorted(reversed(hits), key=lambda h: -h[2]):
        if all(h[1] <= k[0] or k[1] <= h[0] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h[0])


class Scanner:
    """Compressors and words of a set of templates."""

    def __init__(self, templates: dict[tuple[str, str], str], level: int = 9):
        import zstandard as z

        self.names, texts = list(templates), list(templates.values())
        self.plain = z.ZstdCompressor(level=level)
        self.with_template = [z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(
            t.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for t in texts]
        self.words = [word_list(t) for t in texts]
        self.bags = [Counter(w) for w in self.words]
        self.longest = max(map(len, self.words), default=1)

    def rank(self, block: str) -> list[tuple[float, int]]:
        """``(share of bytes saved, template)``, best first."""
        data = " ".join(block.lower().split()).encode()
        alone = len(self.plain.compress(data))
        saved = [(alone - len(c.compress(data))) / alone for c in self.with_template]
        return sorted(((s, -k) for k, s in enumerate(saved)), reverse=True)

    def wording(self, block: list[str], k: int) -> tuple[float, int, int, int]:
        """``(score, words missing, words added, first word)`` of template ``k`` at
        its best place in the block's words."""
        want = self.words[k]
        code = {w: i + 1 for i, w in enumerate(dict.fromkeys(want))}
        region = np.array([[code.get(w, 0) for w in block]], np.int64)
        _, end = align(np.array([[code[w] for w in want]], np.int64), np.array([len(want)]), region, np.array([len(block)]))
        end = int(end[0])
        start = max(0, end - len(want) - len(want) // 2 - 2)
        found = SequenceMatcher(None, want, block[start:end], autojunk=False).get_matching_blocks()
        found = [m for m in found if m.size]
        hits = sum(m.size for m in found)
        if not hits:
            return 0.0, len(want), 0, 0
        span = found[-1].b + found[-1].size - found[0].b
        return 2 * hits / (len(want) + span), len(want) - hits, span - hits, start + found[0].b

    def scan(self, block: str, least: float):
        """The best confirmed template: ``(template, saved, score, missing, added, first word)``."""
        words = word_list(block)
        if not words:
            return None
        best, bag = None, Counter(words)
        for saved, k in self.rank(block):
            if saved <= 0:
                break
            # a score of 2 h / (n + span) with h words found, span >= h, needs h >= least n / (2 - least)
            if (self.bags[-k] & bag).total() < least / (2 - least) * len(self.words[-k]) - 1e-9:
                continue
            score, missing, added, first = self.wording(words, -k)
            value = len(self.words[-k]) - 2 * missing - added  # words that agree less those that differ
            if score >= least and (best is None or value > best[0]):
                best = value, (-k, saved, score, missing, added, first)
        return best and best[1]

    def scan_all(self, block: str, least: float) -> Iterator[tuple]:
        """Hits ``(first word, end, size, template, saved, score, missing, added)``: the
        best of the block, then those of what stands before and after it."""
        todo = [(0, block.lower())]
        while todo:
            at, part = todo.pop()
            hit = self.scan(part, least)
            if not hit:
                continue
            k, saved, score, missing, added, first = hit
            end = first + len(self.words[k]) - missing + added
            yield at + first, at + end, score * len(self.words[k]), k, saved, score, missing, added
            place = [m.span() for m in _WORD.finditer(part)]
            rest = [(at, part[:place[first][0]]), (at + end, part[place[end - 1][1]:])]
            todo += [r for r in rest if mentions(r[1])]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.85,
         templates: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """One row per notice: ``(key, line, license, form, saved, score, n_missing,
    n_added, exact)``, ``line`` being where its wording starts.  Hits of a
    paragraph, its lines and their sentences that share words are one notice,
    the longest template's; notices side by side are all reported."""
    table = dict(templates or TEMPLATES)
    low = F.lower(F.col(text))
    some = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in MENTIONS])
    src = docs.where(some).select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table)
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hits = [(at + before + h[0], at + before + h[1], *h[2:]) for at, block in blocks(text)
                        for before, part in windows(block, scanner.longest) for h in scanner.scan_all(part, least)]
                hits = best_places(hits)
                if hits:
                    rows += [(i, line, *h[3:]) for line, h in zip(lines_of(text, [h[0] for h in hits]), hits)]
            if rows:
                i, line, k, saved, score, missing, added = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(i)), pa.array(line, pa.int64()),
                     pa.array([scanner.names[x][0] for x in k]), pa.array([scanner.names[x][1] for x in k]),
                     pa.array(saved, pa.float64()), pa.array(score, pa.float64()), pa.array(missing, pa.int64()),
                     pa.array(added, pa.int64()), pa.array([not a and not b for a, b in zip(missing, added)])],
                    names=["id", "line", "license", "form", "saved", "score", "n_missing", "n_added", "exact"])

    got = src.mapInArrow(run, f"id {kind}, line long, license string, form string, saved double, score double, "
                              "n_missing long, n_added long, exact boolean")
    return got.withColumnRenamed("id", key)
