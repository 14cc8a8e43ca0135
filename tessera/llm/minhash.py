"""MinHash near-duplicates with tensored banding.

A text's set holds the hashes of its distinct five-word shingles.  Instead of
one independent group of minhashes per table, two small collections of ``m``
half keys (three minhashes each) are computed, and each of the ``m * m`` tables
is keyed by a pair of one half key of either collection: 100 tables from 60
minhashes instead of 600.  Two texts of similarity s share a table with
probability (1 - (1 - s^3)^m)^2: 0.9998 at s = 0.85, 0.998 at s = 0.8.

Equal sets are one class before anything is compared.  Buckets of up to
``SMALL`` classes propose all their pairs of compatible size; a larger bucket
proposes a star per size band, and whatever it still holds in different
components afterwards is compared inside the bucket by an exact prefix filter
that writes only the links that join components.  Every link is confirmed on
the full sets.  No bucket, however large, drops a candidate.

Defined results: a null, empty or blank text has an empty set, no links, and
is its own component; a text of fewer than five words has its whole sequence as
one shingle; repeated rows are one class and the smallest id stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.data import materialize
from tessera.llm.flat import chunks, lower_table, mix, span_hashes, words

WORDS = 5
HALF, COLLECTION = 3, 10
SMALL = 12
BLOCK_SHINGLES = 2_000_000
SEED = 0x5851F42D4C957F2D


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted in a row: ``(flat, row offsets)``."""
    low = lower_table()[raw]
    starts, ends, at = words(low, off)
    code, n_words = span_hashes(low, starts, ends), np.diff(at)
    count = np.where(n_words > 0, np.maximum(n_words - WORDS + 1, 1), 0)
    row = np.repeat(np.arange(len(count)), count)
    first = np.repeat(at[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    padded = np.concatenate([code, np.zeros(WORDS, np.uint64)])
    last, out = at[1:][row], np.zeros(len(row), np.uint64)
    for k in range(WORDS):
        inside = first + k < last
        out = np.where(inside, mix(out + padded[first + k] + np.uint64(k + 1)), out)
    ends = np.r_[0, np.cumsum(count)]
    flat, size = [], np.zeros(len(count), np.int64)
    for r in np.flatnonzero(count).tolist():
        u = np.unique(out[ends[r]:ends[r + 1]])
        flat.append(u)
        size[r] = len(u)
    return (np.concatenate(flat) if flat else out[:0]), np.r_[0, np.cumsum(size)]


def half_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two collections of ``COLLECTION`` half keys per non-empty row."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), 2 * COLLECTION), np.uint64)
    for c in range(2 * COLLECTION):
        key = np.full(len(starts), c + 1, np.uint64)
        for h in range(HALF):
            seed = np.uint64((SEED * (2 * (c * HALF + h) + 1)) % (1 << 64))
            x = (flat ^ seed) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            key = mix(key + np.minimum.reduceat(x, starts))
        out[:, c] = key
    return out


def _set_ids(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash per row's set; 0 for an empty set."""
    size = np.diff(at)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        out[full] = mix(np.add.reduceat(mix(flat), at[:-1][full]) + size[full].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, digest, n, sid, halves)``: digest of the text, set size, set hash, half
    keys (empty set: none)."""
    kind = docs.schema[key].dataType.simpleString()
    width = 2 * COLLECTION

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text"):
                flat, at = shingles(raw, off)
                size = np.diff(at)
                ends = np.r_[0, np.cumsum((size > 0) * width)].astype(np.int32)
                halves = half_keys(flat, at) if len(flat) else np.zeros((0, width), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("digest").slice(i, j - i), pa.array(size), pa.array(_set_ids(flat, at)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(halves.ravel().view(np.int64)))],
                    names=["id", "digest", "n", "sid", "halves"])

    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_digest(F.col(text)).alias("digest"))
            .mapInArrow(run, f"id {kind}, digest string, n long, sid long, halves array<long>"))


def tables(classes: DataFrame) -> DataFrame:
    """``(slot, n, sid)``: the keys of all tables, pairs of half keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                h = part.column("halves").flatten().to_numpy().view(np.uint64).reshape(-1, 2, COLLECTION)
                slot = mix(h[:, 0, :, None] * np.uint64(SEED) + h[:, 1, None, :]).reshape(len(h), -1)
                times = slot.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot.ravel().view(np.int64)),
                     pa.array(np.repeat(part.column("n").to_numpy(), times).astype(np.int32)),
                     pa.array(np.repeat(part.column("sid").to_numpy(), times))], names=["slot", "n", "sid"])

    return classes.select("n", "sid", "halves").mapInArrow(run, "slot long, n int, sid long")


def _alike(small, large, percent: int):
    """Whether sets of these sizes can reach the similarity."""
    return 100 * small >= percent * large


def proposals(slots: DataFrame, percent: int) -> DataFrame:
    """``(a, b, slot)`` from sorted buckets: every pair of a small bucket (slot
    null); in a larger one each class with the first of its size band, under
    the bucket's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        star: tuple[int, int, int] | None = None              # slot, size and class of an open large bucket's pivot

        def emit(slot, n, sid, star):
            """Proposals of whole buckets, or of the next part of an open one."""
            a, b, s = [], [], []
            first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            size = np.diff(np.r_[first, len(slot)])
            for gap in range(1, SMALL):
                i = np.flatnonzero(slot[:-gap] == slot[gap:]) if len(slot) > gap else first[:0]
                i = i[np.repeat(size, size)[i] <= SMALL]
                if star is not None:
                    i = i[slot[i] != star[0]]
                i = i[_alike(n[i], n[i + gap], percent)]
                a.append(sid[i]), b.append(sid[i + gap]), s.append(np.full(len(i), 0))
            for f, k in zip(first.tolist(), size.tolist()):
                opened = star is not None and star[0] == slot[f]
                if k <= SMALL and not opened:
                    continue
                pivot = star if opened else (int(slot[f]), int(n[f]), int(sid[f]))
                at = f
                while at < f + k:
                    stop = f + int(np.searchsorted(n[f:f + k], pivot[1] * 100 // percent, "right"))
                    if stop > at:
                        a.append(np.full(stop - at, pivot[2])), b.append(sid[at:stop]), s.append(slot[at:stop])
                    at = max(at, stop)
                    if at < f + k:
                        pivot = (int(slot[at]), int(n[at]), int(sid[at]))
                star = pivot
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, s)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["a", "b", "slot"]), star

        for batch in batches:
            slot, n, sid = (np.concatenate([r, c.to_numpy().astype(np.int64)]) for r, c in zip(rest, batch.columns))
            open_at = int(np.searchsorted(slot, slot[-1])) if len(slot) else 0
            cut = open_at if len(slot) - open_at <= SMALL else len(slot)
            if star is not None and len(slot) and star[0] == slot[-1]:
                cut = len(slot)
            rest = [slot[cut:], n[cut:], sid[cut:]]
            if cut:
                out, star = emit(slot[:cut], n[:cut], sid[:cut], star)
                yield out
        if len(rest[0]):
            yield emit(*rest, star)[0]

    parts = slots.repartition(F.col("slot")).sortWithinPartitions("slot", "n", "sid")
    return parts.mapInArrow(run, "a long, b long, slot long")


def sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``(sid, items)``: the sorted set (8 bytes an item) of the classes whose
    representative documents are ``wanted (id, digest)``; the id may be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in chunks(batch, "text"):
                flat, at = shingles(raw, off)
                items = [flat[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(flat, at)), pa.array(items, pa.binary())],
                                                 names=["sid", "items"])

    asked = wanted.select(F.col("id").alias("id_"), F.col("digest").alias("digest_"))
    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"), text_digest(F.col(text)).alias("digest"))
            .join(asked, (F.col("digest") == F.col("digest_")) & F.col("id").eqNullSafe(F.col("id_")), "left_semi")
            .select("text").mapInArrow(run, "sid long, items binary")
            .dropDuplicates(["sid"]))


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirm(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                  for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = (pairs.join(items.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b")
            .join(items.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a"))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def bucket_links(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components inside one bucket (or between two blocks of
    it): candidates share an item of the prefix that is rarest here, which any
    similar pair must."""
    items = [np.frombuffer(x, np.uint64) for x in frame["items"]]
    side = frame["side"].to_numpy()
    every, inv, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(x) for x in items])
    parent = {c: c for c in frame["comp"].tolist()}
    comp = frame["comp"].tolist()

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    posted: dict[int, list[int]] = {}
    sids, out = frame["sid"].tolist(), []
    for i, x in enumerate(items):
        code = inv[ends[i] - len(x):ends[i]]
        code = code[np.lexsort((code, count[code]))]
        prefix = code[:len(x) - -(-percent * len(x) // 100) + 1]
        prefix = prefix[count[prefix] > 1].tolist()
        near = {j for t in prefix for j in posted.get(t, ())}
        for j in sorted(near):
            if side[i] == side[j] == 0 or find(comp[i]) == find(comp[j]):
                continue
            y = items[j]
            if _alike(min(len(x), len(y)), max(len(x), len(y)), percent) and _similar(x, y, percent):
                parent[find(comp[i])] = find(comp[j])
                out.append((sids[i], sids[j]))
        for t in prefix:
            posted.setdefault(t, []).append(i)
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def unresolved(hot: DataFrame, labels: DataFrame, items: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links of large buckets whose classes are still in several components.

    Classes of one bucket share a half key of the first collection, so they are
    gathered by those few half keys instead of all their tables.  A group is
    cut into blocks of bounded set volume and every two blocks are compared in
    a task of their own."""
    members = (hot.select("slot", F.col("a").alias("sid")).union(hot.select("slot", F.col("b").alias("sid"))).distinct()
               .join(labels.withColumnRenamed("node", "sid"), "sid", "left")
               .select("slot", "sid", F.coalesce("comp", "sid").alias("comp")))
    lone = members.groupBy("slot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    apart = members.join(lone.select("slot"), "slot", "left_semi").select("sid", "comp").distinct()
    gathered = (apart.join(reps, "sid").select("sid", "comp", "n", F.explode(F.slice("halves", 1, COLLECTION)).alias("half")))
    by = Window.partitionBy("half").orderBy("n", "sid").rowsBetween(Window.unboundedPreceding, 0)
    blocks = gathered.select("half", "sid", "comp", F.floor(F.sum("n").over(by) / BLOCK_SHINGLES).alias("block"))
    last = (blocks.groupBy("half").agg(F.max("block").alias("last"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            .where("lo != hi"))
    # block pair (i, j), i <= j: side 0 is block i, side 1 block j; a block alone is all side 1
    placed = (blocks.join(last.select("half", "last"), "half")
              .select("*", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("other"))
              .select("half", "sid", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                      F.when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side")))
    return (placed.join(items, "sid").groupBy("half", "i", "j")
            .applyInPandas(lambda frame: bucket_links(frame, percent), "a long, b long"))


def text_digest(text: Column) -> Column:
    """128-bit digest that tells rows of one id apart."""
    return F.md5(text)


def component_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: ``(id, digest, n, comp)``, ``comp`` naming its group (null
    for an empty set)."""
    rows = materialize(sketches(docs, key, text), "minhash-sketches")
    classes = rows.where("n > 0").groupBy("sid").agg(F.min(F.struct("id", "digest")).alias("first"), F.first("n").alias("n"),
                                                     F.first("halves").alias("halves")).select("sid", "first.*", "n", "halves")
    found = materialize(proposals(tables(classes), percent), "minhash-proposals")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    nodes = found.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    reps = materialize(classes.join(nodes, "sid", "left_semi"), "minhash-classes")
    items = materialize(sets(docs, reps.select("id", "digest"), key, text), "minhash-sets")
    links = materialize(confirm(pairs, items, percent), "minhash-links")
    labels = components(links)
    hot = found.where("slot != 0")                           # self pairs too: a class alone in its size band is a member
    if not hot.isEmpty():
        more = materialize(unresolved(hot, labels, items, reps.select("sid", "n", "halves"), percent), "minhash-more")
        if not more.isEmpty():
            labels = components(labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    return (rows.select("id", "digest", "n", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
            .select("id", "digest", "n", F.when(F.col("n") > 0, F.coalesce("comp", "sid")).alias("comp")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: ``(key, n_shingles, component_id, kept)``.  A row without
    an id takes part like any other, and is never the one kept."""
    named = component_rows(docs, key, text, percent)
    first = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    got = named.join(first, "comp", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))
    return got.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
