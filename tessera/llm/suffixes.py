"""Suffix-array deduplication of byte strings.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
earlier (smaller id, or the same document and an earlier start).

1. Every window of ``LENGTH`` bytes is assigned to one anchor inside it, the
   ``GRAM``-byte gram of smallest hash, leftmost on ties.  Equal windows have equal
   anchors at equal offsets, so windows of an anchor hash that occurs once are
   unique and need no more work.  Neighbouring windows mostly share an anchor;
   what a document sends on is one row per anchor: hash, window range and a
   digest of the bytes that those windows span (the anchor's context).
2. Rows are dealt by anchor hash.  A context equal to an earlier one is a
   repeat throughout; of an anchor with several different contexts, the first
   row of each context goes on.
3. Those contexts' bytes form shards of bounded size.  In each shard a suffix
   array is built by Larsson-Sadakane refinement (eight bytes first, then rank
   pairs of doubled depth, only unsorted groups being sorted again), common
   prefixes follow by Kasai's method run over all contexts side by side, and
   windows that share ``LENGTH`` bytes form groups whose first occurrence stays.
4. An anchor whose contexts fill more than one shard (dealt over several tasks
   when there are many) is merged across shards: each shard sends its distinct
   windows' digests in sorted runs, and runs are merged by binary search.

Defined results: a null or empty text, or one shorter than ``LENGTH``, loses
nothing; rows of equal id and equal text are one document and treated alike; a
null id sorts first; ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.data import materialize
from tessera.llm.flat import BASE, INVERSE, chunks, mix, mixed_bytes, powers, ranges, span_hashes, text_bytes

LENGTH = 100
GRAM = 32
SHARD_BYTES = 1 << 20
HOT_CONTEXTS = 5000
POSITION_BITS = 24
PIECE = 1 << 23


def anchors(raw: np.ndarray, off: np.ndarray):
    """``(row, first window, last window, anchor hash, context digest)`` of the
    anchors of flat texts; windows are numbered from their row's start."""
    width = LENGTH - GRAM + 1
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(mixed_bytes()[raw] * powers(BASE, len(raw)), out=prefix[1:])
    inverse = powers(INVERSE, len(raw) + 1)
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * inverse[:len(raw) - GRAM + 1])
    low = (gram >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= width:                                  # least of ``span`` neighbours, doubling
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span:width - span + n])
    at = (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    valid = np.zeros(n + 1, np.int32)                         # windows inside one row
    size = np.diff(off)
    full = np.flatnonzero(size >= LENGTH)
    np.add.at(valid, off[full], 1)
    np.add.at(valid, off[full] + size[full] - LENGTH + 1, -1)
    inside = np.cumsum(valid[:n]) > 0
    first = inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]]
    starts_row = np.zeros(n, bool)
    starts_row[off[full]] = True
    first |= starts_row
    last = np.r_[first[1:] | ~inside[1:], True] & inside
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    row = np.searchsorted(off, s, "right") - 1
    body = (prefix[e + LENGTH] - prefix[s]) * inverse[s]
    context = mix(mix(body + (at[s] - s).astype(np.uint64)) + (e - s).astype(np.uint64))
    return row, s - off[row], e - off[row], gram[at[s]], context


def _long_anchors(raw: np.ndarray):
    """Anchors of one long text, in pieces whose windows follow on each other."""
    got = []
    for p in range(0, len(raw), PIECE):
        part = raw[p:p + PIECE + LENGTH - 1]
        row, s, e, h, c = anchors(part, np.array([0, len(part)]))
        got.append((row, s + p, e + p, h, c))
    return tuple(np.concatenate(x) for x in zip(*got))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("part"),
                       F.encode(F.col(text), "UTF-8").alias("text"))


def anchor_rows(rows: DataFrame) -> DataFrame:
    """``(h, c, doc, part, s, e)`` of every anchor of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part = batch.column("doc"), batch.column("part")
            for i, j, raw, off in chunks(batch, "text", 2 << 20):
                row, s, e, h, c = _long_anchors(raw) if len(raw) > PIECE else anchors(raw, off)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), doc.take(take), part.take(take),
                     pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], names=["h", "c", "doc", "part", "s", "e"])

    return rows.mapInArrow(run, "h long, c long, doc long, part long, s int, e int")


def _same_place(table: pa.Table) -> np.ndarray:
    """Whether a row equals the one before it in all columns (nulls are equal)."""
    same = np.ones(max(0, table.num_rows - 1), bool)
    for column in table.columns:
        none = column.is_null().to_numpy()
        v = column.fill_null(0).to_numpy()
        same &= (v[1:] == v[:-1]) & (none[1:] == none[:-1])
    return np.r_[False, same] if table.num_rows else same


def split_repeats(found: DataFrame) -> DataFrame:
    """``(h, doc, part, s, e, whole)`` from anchor rows: ``whole`` rows repeat an
    earlier context; the others are the first rows of the contexts of an anchor
    that has several.  Rows of a partition are read in order (anchor, context,
    place), so an anchor of any size passes through in batches."""
    names = ["h", "doc", "part", "s", "e", "whole"]

    def out(table: pa.Table, whole: bool) -> pa.RecordBatch:
        made = table.select(names[:-1]).append_column("whole", pa.array(np.full(table.num_rows, whole)))
        return made.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], made.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None                          # the last anchor's only first row so far
        last: tuple[int, int] | None = None                   # the last row's anchor and context
        spread = False                                        # whether the last anchor has several contexts
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            h, c = batch.column("h").to_numpy(), batch.column("c").to_numpy()
            before_h = np.r_[last[0] if last else ~h[0], h[:-1]]
            before_c = np.r_[last[1] if last else 0, c[:-1]]
            new_h = h != before_h
            new = new_h | (c != before_c)
            again = ~new & ~_same_place(table.select(["doc", "part", "s"]))   # not a repeated row
            yield out(table.filter(pa.array(again)), True)
            firsts = np.flatnonzero(new)
            if len(firsts):
                fh = h[firsts]
                more = np.r_[fh[1:] == fh[:-1], False]        # another context of the same anchor follows here
                less = np.r_[False, fh[1:] == fh[:-1]]        # or came before, in this batch
                carried = not new_h[firsts[0]]                # the first ones go on with the last batch's anchor
                lead = int((fh == fh[0]).sum()) if carried else 0
                several = more | less
                several[:lead] = True
                if carried and held is not None:
                    yield out(held, False)
                send = firsts[several]
                yield out(table.take(pa.array(send)), False)
                end = len(firsts) - 1
                spread = bool(several[end])
                held = None if spread else table.slice(int(firsts[end]), 1)
            last = int(h[-1]), int(c[-1])

    parts = found.repartition(F.col("h")).sortWithinPartitions("h", "c", "doc", "part", "s")
    return parts.mapInArrow(run, "h long, doc long, part long, s int, e int, whole boolean")


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(suffix array, rank)`` of all positions of ``data``, whose strings end at
    ``ends`` (a suffix ends with its string; equal suffixes keep text order).
    Larsson-Sadakane: ranks of depth h refine to depth 2h by sorting, inside
    each unsorted group only, on the rank h places on."""
    n = len(data)
    stop = np.repeat(ends, np.diff(np.r_[0, ends]))
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    place = np.arange(n)
    for k in range(7):                                        # seven bytes, then how many of them are real
        byte = np.where(place + k < stop, padded[k:n + k], 0).astype(np.uint64)
        key = key << np.uint64(8) | byte
    key = key << np.uint64(8) | np.minimum(stop - place, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = group                                       # a group's rank is its first place
    depth = 7
    slots = np.flatnonzero(~(head & np.r_[head[1:], True]))   # places in groups of more than one
    while len(slots) and depth < 1 << 40:
        pos = order[slots]
        nxt = pos + depth
        second = np.where(nxt < stop[pos], rank[np.minimum(nxt, n - 1)], -1)
        old = rank[pos]
        by = np.lexsort((pos, second, old))
        pos, old, second = pos[by], old[by], second[by]
        order[slots] = pos
        head = np.r_[True, (old[1:] != old[:-1]) | (second[1:] != second[:-1])]
        rank[pos] = np.maximum.accumulate(np.where(head, slots, 0))
        alone = head & np.r_[head[1:], True]
        ended = second < 0                                    # equal to the very end: text order is final
        slots = slots[~alone & ~ended]
        depth *= 2
    final = np.empty(n, np.int64)
    final[order] = np.arange(n)
    return order, final


def kasai(data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with its predecessor in the array, by
    suffix-array place.  Each string is walked from its start and keeps what is
    left of the prefix found one byte before; all strings are walked together."""
    n = len(data)
    starts = np.r_[0, ends[:-1]]
    stop = np.repeat(ends, ends - starts)
    lcp = np.zeros(n, np.int64)
    lane = np.flatnonzero(ends > starts)
    at, h = starts[lane].copy(), np.zeros(len(lane), np.int64)
    while len(lane):
        place = rank[at]
        other = order[np.maximum(place - 1, 0)]
        most = np.where(place > 0, np.minimum(stop[at] - at, stop[other] - other), 0)
        h = np.minimum(h, most)
        grow = np.flatnonzero(h < most)
        while len(grow):
            same = data[at[grow] + h[grow]] == data[other[grow] + h[grow]]
            grow = grow[same]
            h[grow] += 1
            grow = grow[h[grow] < most[grow]]
        lcp[place] = h
        at, h = at + 1, np.maximum(h - 1, 0)
        on = at < ends[lane]
        lane, at, h = lane[on], at[on], h[on]
    return lcp


def shard_repeats(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts of a shard of contexts (in order of occurrence):
    ``(starts, whether an equal window starts earlier in the shard)``."""
    order, rank = suffix_array(data, ends)
    lcp = kasai(data, ends, order, rank)
    stop = np.repeat(ends, np.diff(np.r_[0, ends]))
    starts = np.flatnonzero(np.arange(len(data)) + LENGTH <= stop)
    group = np.cumsum(lcp < LENGTH)[rank[starts]]             # one group per distinct prefix of LENGTH bytes
    _, first = np.unique(group, return_index=True)            # starts ascend: the first is the earliest
    again = np.ones(len(starts), bool)
    again[first] = False
    return starts, again


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of runs ``(digests, places)`` sorted by both: the places whose digest some
    run holds with a smaller place.  Each run is looked up in the merged ones
    before it by binary search."""
    digests, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
    late = []
    for d, p in runs:
        first = np.r_[True, d[1:] != d[:-1]]
        late.append(p[~first])
        d, p = d[first], p[first]
        at = np.searchsorted(digests, d)
        hit = np.zeros(len(d), bool)
        near = at < len(digests)
        hit[near] = digests[at[near]] == d[near]
        old = places[at[hit]]
        late.append(np.maximum(old, p[hit]))
        places[at[hit]] = np.minimum(old, p[hit])
        digests, places = np.insert(digests, at[~hit], d[~hit]), np.insert(places, at[~hit], p[~hit])
    return np.concatenate(late) if late else digests


def _contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h, salt, split, doc, part, s, bytes)``: the contexts' bytes, cut from whole texts."""
    lists = wanted.groupBy("doc", "part").agg(F.collect_list(F.struct("h", "salt", "split", "s", "e")).alias("at"))
    lists = lists.select(F.col("doc").alias("doc_"), F.col("part").alias("part_"), "at")
    both = rows.join(lists, [F.col("doc").eqNullSafe(F.col("doc_")), F.col("part") == F.col("part_")])
    names = ["h", "salt", "split", "doc", "part", "s", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            size = at.value_lengths().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if not size[i]:
                    continue
                text = batch.column("text")[i].as_buffer()
                item = at.slice(i, 1).flatten()
                s, e = item.field("s").to_numpy(), item.field("e").to_numpy()
                raw = np.frombuffer(text, np.uint8)
                cut = raw[ranges(s.astype(np.int64), (e - s).astype(np.int64) + LENGTH)]
                ends = np.r_[0, np.cumsum(e - s + LENGTH)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [item.field("h"), item.field("salt"), item.field("split"),
                     batch.column("doc").take(pa.array(np.full(len(s), i))), batch.column("part").take(pa.array(np.full(len(s), i))),
                     pa.array(s), pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends.tobytes()),
                                                                             pa.py_buffer(cut.tobytes())])], names=names)

    return both.select("text", "doc", "part", "at").mapInArrow(
        run, "h long, salt int, split boolean, doc long, part long, s int, bytes binary")


def shard_results(contexts: DataFrame) -> DataFrame:
    """``(doc, part, s, e, digest)`` per shard: repeated window ranges (digest
    null), and for anchors that other shards hold too the digest of each window
    that is first here."""
    names = ["doc", "part", "s", "e", "digest"]

    def shard(held: list[pa.RecordBatch], split: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.filter(pa.array(~_same_place(table.select(["h", "doc", "part", "s"]))))
        data, off = text_bytes(table.column("bytes").combine_chunks())
        starts, again = shard_repeats(data, off[1:])
        row = np.searchsorted(off[1:], starts, "right")
        s = starts - off[row] + table.column("s").to_numpy()[row]
        doc, part = (table.column(c).combine_chunks() for c in ("doc", "part"))

        def rows(row, s, e, digest):
            take = pa.array(row)
            return pa.RecordBatch.from_arrays([doc.take(take), part.take(take), pa.array(s.astype(np.int32)),
                                               pa.array(e.astype(np.int32)), digest], names=names)

        r, w = row[again], s[again]
        if len(r):
            first = np.r_[True, (r[1:] != r[:-1]) | (w[1:] != w[:-1] + 1)]
            yield rows(r[first], w[first], w[np.r_[first[1:], True]], pa.nulls(int(first.sum()), pa.int64()))
        if split:
            mine = starts[~again]
            yield rows(row[~again], s[~again], s[~again], pa.array(span_hashes(data, mine, mine + LENGTH).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors gather until a shard is full; a split anchor's part is a shard of its own."""
        held: list[pa.RecordBatch] = []
        volume, now = 0, None                                 # bytes held, last row's (anchor, salt, split)
        for batch in batches:
            h, salt = batch.column("h").to_numpy(), batch.column("salt").to_numpy()
            split = batch.column("split").to_numpy(zero_copy_only=False)
            size = np.r_[0, np.cumsum(pa.compute.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False))]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]) if len(h) else []
            begin = 0
            for f in first:
                new = int(h[f]), int(salt[f]), bool(split[f])
                if now is not None and new != now:
                    filled = volume + int(size[f] - size[begin])
                    if now[2] or new[2] or filled > SHARD_BYTES:
                        held.append(batch.slice(begin, f - begin))
                        yield from shard(held, now[2])
                        held, volume, begin = [], 0, f
                now = new
            held.append(batch.slice(begin))
            volume += int(size[-1] - size[begin])
        if held and now is not None:
            yield from shard(held, now[2])

    parts = contexts.repartition(F.col("h"), F.col("salt")).sortWithinPartitions("h", "salt", "doc", "part", "s")
    return parts.mapInArrow(run, "doc long, part long, s int, e int, digest long")


def merge_shards(found: DataFrame) -> DataFrame:
    """``(doc, part, s, e)``: windows of split anchors that another shard holds
    earlier.  Digests are dealt over tasks; a task merges its sorted runs."""
    placed = found.where("digest is not null").select("doc", "part", "s", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        place = table.select(["doc", "part", "s"]).combine_chunks()
        order = pa.compute.sort_indices(place.append_column("i", pa.array(np.arange(place.num_rows))), sort_keys=[
            ("doc", "ascending"), ("part", "ascending"), ("s", "ascending"), ("i", "ascending")], null_placement="at_start")
        rank = np.empty(place.num_rows, np.int64)
        rank[order.to_numpy()] = np.arange(place.num_rows)
        digest, runs, at = table.column("digest").to_numpy(), [], 0
        for b in tables:
            d, p = digest[at:at + b.num_rows], rank[at:at + b.num_rows]
            by = np.lexsort((p, d))
            runs.append((d[by], p[by]))
            at += b.num_rows
        late = np.unique(merge_runs(runs))
        got = place.take(order.take(pa.array(late)))
        yield from got.append_column("e", got.column("s")).to_batches()

    return placed.repartition(F.col("digest")).mapInArrow(run, "doc long, part long, s int, e int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(key, n_bytes, n_removed, spans, kept)``; ``spans``
    are the maximal removed byte ranges ``[start, end)``, ``kept`` the other bytes."""
    rows = _rows(docs, key, text)
    parts = materialize(split_repeats(anchor_rows(rows)), "suffix-repeats")
    wanted = parts.where("not whole").drop("whole")
    hot = (wanted.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
           .select(F.col("h").alias("h_"), F.when(F.col("n") > HOT_CONTEXTS, F.ceil(F.col("n") / HOT_CONTEXTS)).otherwise(1).alias("n")))
    hot = hot.where("n > 1")
    wanted = (wanted.join(hot, F.col("h") == F.col("h_"), "left")
              .select("h", F.coalesce(F.pmod(F.xxhash64("doc", "part", "s"), F.col("n")), F.lit(0)).cast("int").alias("salt"),
                      F.col("n").isNotNull().alias("split"), "doc", "part", "s", "e"))
    found = materialize(shard_results(_contexts(rows, wanted)), "suffix-shards")
    cover = (parts.where("whole").select("doc", "part", "s", "e")
             .unionByName(found.where("digest is null").select("doc", "part", "s", "e"))
             .unionByName(merge_shards(found)))
    cover = cover.groupBy("doc", "part").agg(F.collect_list(F.struct("s", "e")).alias("at"))
    cover = cover.select(F.col("doc").alias("doc_"), F.col("part").alias("part_"), "at")
    both = rows.join(cover, [F.col("doc").eqNullSafe(F.col("doc_")), F.col("part") == F.col("part_")], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, off = batch.column("at"), [0]
            n_bytes, gone, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column("text")[i]
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                item = at[i].values if at[i].is_valid else None
                n_bytes.append(len(raw))
                if item is None:
                    gone.append(0), kept.append(raw.tobytes()), off.append(off[-1])
                    continue
                mark = np.zeros(len(raw) + 1, np.int32)
                np.add.at(mark, item.field("s").to_numpy(), 1)
                np.add.at(mark, item.field("e").to_numpy() + LENGTH, -1)
                out = np.cumsum(mark[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                gone.append(int(out.sum())), kept.append(raw[~out].tobytes())
                spans.append(edge), off.append(off[-1] + len(edge) // 2)
            edges = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(edges[::2], pa.int64()), pa.array(edges[1::2], pa.int64())], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pairs), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "spans", "kept"])

    got = both.select("doc", "text", "at").mapInArrow(
        run, "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return got.withColumnRenamed("doc", key)
