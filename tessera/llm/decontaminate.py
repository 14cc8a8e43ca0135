"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, A-Z folded.  Each test
item's seeds are the rarest of its ``GRAM``-word grams by document frequency
over the whole corpus (at least half of them, so common wording never starts an
alignment and an item that was copied thousands of times still has seeds).
Where a text holds seeds of an item, the words around them are aligned with the
item by Smith-Waterman on words (match 2, mismatch -1, gap -1), many regions at
a time; the score is divided by that of a perfect match, so an edited or
partly paraphrased copy scores by the share that survives.

Texts are read twice and never shuffled: seeds join passages inside the tasks.
Items are worked through in blocks of at most ``ITEM_BLOCK`` against all texts, so
what a task holds of the test set is bounded.

Defined results: a null or empty text or item matches nothing; an item of fewer
than ``GRAM`` words has no seeds and matches nothing; repeated items and repeated
rows each get their own result rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.flat import chunks, lower_table, mix, span_hashes

GRAM = 3
ITEM_BLOCK = 20_000
MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 4_000_000


def plain_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word hashes, row offsets)`` of folded words."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    solid = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:-1]))
    ends = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
    return span_hashes(lower_table()[raw], starts, ends), np.searchsorted(starts, off)


def grams(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(gram hashes, position of each one's first word)``, inside rows only."""
    n = len(code) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pos = np.flatnonzero(row[:n] == row[GRAM - 1:])
    out = np.zeros(len(pos), np.uint64)
    for k in range(GRAM):
        out = mix(out + code[pos + k])
    return out, pos


class Items:
    """Words and grams of a block of test items, and the seed index."""

    def __init__(self, ids: list, texts: list[str]):
        data = [t.encode() for t in texts]
        off = np.r_[0, np.cumsum([len(t) for t in data])].astype(np.int64)
        self.ids = ids
        self.code, self.at = plain_words(np.frombuffer(b"".join(data), np.uint8), off)
        gram, pos = grams(self.code, self.at)
        self.item = np.searchsorted(self.at, pos, "right") - 1
        self.pos, (self.every, self.which) = pos - self.at[self.item], np.unique(gram, return_inverse=True)
        self.use(np.ones(len(gram), bool))

    def use(self, chosen: np.ndarray) -> None:
        """Index the chosen (item, gram) occurrences as seeds."""
        which, item, pos = self.which[chosen], self.item[chosen], self.pos[chosen]
        order = np.argsort(which, kind="stable")
        self.seed, first = np.unique(which[order], return_index=True)
        self.seed = self.every[self.seed]
        self.first = np.r_[first, len(order)]
        self.seed_item, self.seed_pos = item[order], pos[order]
        self.filter = np.zeros(1 << 18, bool)
        self.filter[self.seed >> np.uint64(46)] = True

    def choose(self, frequency: np.ndarray) -> None:
        """Keep each item's rarest grams: the rarer half, ties included."""
        rare = np.zeros(len(self.item), bool)
        for i in np.unique(self.item):
            mine = np.flatnonzero(self.item == i)
            f = frequency[self.which[mine]]
            rare[mine] = f <= np.sort(f)[(len(f) - 1) // 2]
        self.use(rare)

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(gram index, seed index)`` of the grams that are seeds."""
        near = np.flatnonzero(self.filter[gram >> np.uint64(46)])
        if not len(near) or not len(self.seed):
            return near[:0], near[:0]
        at = np.minimum(np.searchsorted(self.seed, gram[near]), len(self.seed) - 1)
        ok = self.seed[at] == gram[near]
        return near[ok], at[ok]


def align(items: np.ndarray, sizes: np.ndarray, regions: np.ndarray, widths: np.ndarray
          ) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of padded word rows, item ``k`` with region ``k``: ``(best
    score, region column where it ends)``.  Item words go one by one, all
    regions at once; a row's gaps along the region come from a running maximum."""
    n, width = regions.shape
    best, where = np.zeros(n, np.int32), np.zeros(n, np.int64)
    row = np.zeros((n, width + 1), np.int32)
    step = np.arange(width + 1, dtype=np.int32) * -GAP
    inside = np.arange(width)[None, :] < widths[:, None]
    for k in range(items.shape[1]):
        same = (regions == items[:, k, None]) & inside & (k < sizes)[:, None]
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, MATCH, MISMATCH), row[:, 1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step, axis=1) - step
        top = row.argmax(axis=1)
        score = row[np.arange(n), top]
        better = (score > best) & (k < sizes)
        best[better], where[better] = score[better], top[better]
    return best, where


def _regions(items: Items, row: np.ndarray, pos: np.ndarray, seed: np.ndarray):
    """``(row, item, first word, last word, seeds)`` of the places to align: the
    expected span of the item around its seeds, joined where seeds of one item
    lie within its length."""
    count = items.first[seed + 1] - items.first[seed]
    each = np.repeat(np.arange(len(seed)), count)
    k = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + items.first[seed][each]
    item = items.seed_item[k]
    start = pos[each] - items.seed_pos[k]                     # where the item would start
    order = np.lexsort((start, item, row[each]))
    r, i, s = row[each][order], item[order], start[order]
    size = np.diff(items.at)[i]
    fresh = np.r_[True, (r[1:] != r[:-1]) | (i[1:] != i[:-1]) | (s[1:] - s[:-1] > size[1:] // 2)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(r)] - 1
    slack = size[first] // 2 + GRAM
    return r[first], i[first], s[first] - slack, s[last] + size[first] + slack, last - first + 1


def find_items(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", least: float = 0.6) -> DataFrame:
    """``(key, item_key, score, first_word, last_word, n_seeds)``: the best
    alignment of each text with each test item that scores ``least`` or more."""
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = (tests.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0))
    kind, item_kind = src.schema["id"].dataType.simpleString(), rows.schema["i"].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, score double, first_word long, last_word long, n_seeds long"
    out = None
    block: list = []

    def search(block):
        items = Items([b["i"] for b in block], [b["t"] for b in block])
        items.choose(_frequency(src, items))
        return src.mapInArrow(lambda batches: _search(batches, items, least), schema)

    for r in rows.toLocalIterator():                          # a block of items at a time on the driver
        block.append(r)
        if len(block) == ITEM_BLOCK:
            out = search(block) if out is None else out.unionByName(search(block))
            block = []
    if block or out is None:
        out = search(block) if out is None else out.unionByName(search(block))
    return out.withColumnsRenamed({"id": key, "item": item_key})


def _frequency(src: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each distinct gram of the items, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(items.seed), np.int64)
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text"):
                code, at = plain_words(raw, off)
                gram, pos = grams(code, at)
                hit, seed = items.hits(gram)
                row = np.searchsorted(at, pos[hit], "right") - 1
                once = np.unique(row * len(count) + seed) % max(1, len(count))
                count += np.bincount(once, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["gram", "n"])

    got = src.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.every), np.int64)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


def _search(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(items.at)
    for batch in batches:
        for i, j, raw, off in chunks(batch, "text"):
            code, at = plain_words(raw, off)
            gram, pos = grams(code, at)
            hit, seed = items.hits(gram)
            if not len(hit):
                continue
            row = np.searchsorted(at, pos[hit], "right") - 1
            row, item, first, last, n_seeds = _regions(items, row, pos[hit], seed)
            first, last = np.maximum(first, at[row]), np.minimum(last, at[row + 1])
            score, end = np.zeros(len(row)), np.zeros(len(row), np.int64)
            order = np.argsort(last - first, kind="stable")
            s = 0
            while s < len(order):                             # groups of like width, bounded cells
                width = last[order[s:]] - first[order[s:]]
                e = s + max(1, int(np.searchsorted(np.arange(1, len(width) + 1) * np.maximum.accumulate(width), CELLS // 16)))
                g = order[s:e]
                words = np.zeros((len(g), int(sizes[item[g]].max())), np.uint64)
                region = np.zeros((len(g), int((last[g] - first[g]).max())), np.uint64)
                for k, x in enumerate(g.tolist()):
                    words[k, :sizes[item[x]]] = items.code[items.at[item[x]]:items.at[item[x] + 1]]
                    region[k, :last[x] - first[x]] = code[first[x]:last[x]]
                got, where = align(words, sizes[item[g]], region, last[g] - first[g])
                score[g] = got / (MATCH * sizes[item[g]])
                end[g] = first[g] + where
                s = e
            order = np.lexsort((first, -score, item, row))    # best region of each text and item
            head = np.r_[True, (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])]
            keep = order[head]
            keep = keep[score[keep] >= least]
            if not len(keep):
                continue
            base = at[row[keep]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i).take(pa.array(row[keep])),
                 pa.array([items.ids[x] for x in item[keep].tolist()]), pa.array(score[keep]),
                 pa.array(np.maximum(first[keep] - base, 0)), pa.array(end[keep] - base), pa.array(n_seeds[keep])],
                names=["id", "item", "score", "first_word", "last_word", "n_seeds"])
