"""Ranked lexical search over an inverted index in segments: hybrid TAAT-DAAT.

``build_index`` turns the texts into a table of posting lists.  A segment is a
run of documents of bounded size; a row of the index is one term of one segment
with the documents that hold it and how often, and one further row per segment
lists its documents and their lengths.

``search`` ranks all documents for every query.  Document frequencies are a
grouped sum over the index, and only posting lists of query terms are sent on, by
segment.  In a segment, each query's short lists are added up term at a time
into accumulators; these then act as one more iterator, with a bound, beside
the long lists, and all are read document at a time in windows: a window or a
document whose bounds cannot reach the k-th best score so far is skipped, and
long lists are probed only for documents that still can.  A task keeps the k
best documents of each query and passes its thresholds from segment to segment;
the tasks' lists are merged by a window over ``k`` rows a task and query.

Queries are worked through in blocks of at most ``BLOCK_BYTES`` of text, each
block against the whole index, so what is broadcast is bounded.

Score (whole numbers): a term that ``df`` of ``N`` documents with words hold
weighs ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and adds
``w * (10^9 * tf div (1000 * tf + 12 * m))`` per occurrence in the query, with
``m = 75 + (25 * n * N) div L`` for a document of ``n`` words of ``L`` in all.

Defined results: a null or empty text, or one without letters and digits, holds
no term, is not counted and is never found; a query without known terms finds
nothing.  Queries of equal id and text are one query.  Documents that repeat an
id are each ranked; a null document id sorts before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.data import materialize
from tessera.llm.flat import chunks
from tessera.llm.vocab import byte_class, encode, lists

#: Word characters: digits, letters and everything beyond ASCII.
SOLID = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEGMENT_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
WINDOW = 512
SHORT = 8      # lists that together hold at most 1/SHORT of a segment's documents, or LEAST rows, are short
LEAST = 256


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Index rows ``(segment, term, docs, tfs)`` with document numbers inside the
    segment, and one row per segment with a null term, ``ids`` and ``sizes``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = (TaskContext.get().partitionId() << 32)
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text", SEGMENT_BYTES):
                terms, code, starts = encode(raw, off, SOLID)
                row = np.searchsorted(off, starts, "right") - 1
                pair, tf = np.unique(code * (j - i) + row, return_counts=True)
                term, doc = pair // (j - i), pair % (j - i)
                df = np.bincount(term, minlength=len(terms))
                ids = batch.column("id").slice(i, j - i)
                sizes = np.bincount(row, minlength=j - i)
                none = pa.nulls(len(terms), pa.list_(ids.type)), pa.nulls(len(terms), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(terms), segment)), terms, lists(doc, df, pa.int32()),
                     lists(tf, df, pa.int32()), *none], names=["segment", "term", "docs", "tfs", "ids", "sizes"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment]), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())),
                     pa.nulls(1, pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids),
                     lists(sizes, np.array([j - i]), pa.int64())],
                    names=["segment", "term", "docs", "tfs", "ids", "sizes"])
                segment += 1

    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"segment long, term string, docs array<int>, tfs array<int>, ids array<{kind}>, sizes array<long>"))


class Queries:
    """A block of queries as term numbers with weights (weight x occurrences)."""

    def __init__(self, terms: list[list[int]], weights: list[list[int]], n_docs: int, n_words: int):
        self.terms = [np.array(t, np.int64) for t in terms]
        self.weights = [np.array(w, np.int64) for w in weights]
        self.n_docs, self.n_words = n_docs, max(1, n_words)


class Segment:
    """Posting lists of the block's terms in one segment."""

    def __init__(self, ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, first: np.ndarray, docs: np.ndarray,
                 tfs: np.ndarray, queries: Queries):
        self.ids, self.terms, self.first, self.docs, self.tfs = ids, terms, first, docs, tfs
        self.m12 = 12 * (75 + 25 * sizes * queries.n_docs // queries.n_words)
        self.parts: dict[int, np.ndarray] = {}
        if len(docs):
            top, low = np.maximum.reduceat(tfs, first[:-1]), np.minimum.reduceat(self.m12[docs], first[:-1])
            self.most = 1_000_000_000 * top // (1000 * top + low)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place among the wanted terms, list number)`` of those present."""
        if not len(self.terms) or not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        has = np.flatnonzero(self.terms[at] == wanted)
        return has, at[has]

    def postings(self, k: int) -> np.ndarray:
        return self.docs[self.first[k]:self.first[k + 1]]

    def part(self, k: int) -> np.ndarray:
        """What each posting of list ``k`` adds at weight 1."""
        got = self.parts.get(k)
        if got is None:
            tf = self.tfs[self.first[k]:self.first[k + 1]]
            got = self.parts[k] = 1_000_000_000 * tf // (1000 * tf + self.m12[self.postings(k)])
        return got


class Best:
    """The k best ``(score, id)`` of one query so far, equal scores by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, [], []

    @property
    def threshold(self) -> int:
        """No document below this score is among the k best."""
        return self.scores[-1] if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = sorted([*zip(self.scores, self.ids), *zip(scores.tolist(), ids)],
                      key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))[:self.k]
        self.scores, self.ids = [r[0] for r in rows], [r[1] for r in rows]


def rank_segment(seg: Segment, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Add one query's best documents of a segment to ``best``."""
    which, lists_ = seg.lists(terms)
    if not len(lists_):
        return
    weight, length = weights[which], seg.first[lists_ + 1] - seg.first[lists_]
    order = np.argsort(length, kind="stable")
    n_docs = len(seg.m12)
    n_short = int(np.searchsorted(np.cumsum(length[order]), max(LEAST, n_docs // SHORT), "right"))
    # term at a time: the sums of the short lists, then one iterator like the others
    sums = np.zeros(n_docs, np.int64)
    for x in order[:n_short].tolist():
        sums[seg.postings(lists_[x])] += weight[x] * seg.part(lists_[x])
    held = np.flatnonzero(sums)
    long_lists = order[n_short:]
    if not len(long_lists):
        take = held[sums[held] >= best.threshold]
        best.add(*_top(sums[take], take, seg, best.k))
        return
    bound = weight[long_lists] * seg.most[lists_[long_lists]]
    posts = [seg.postings(lists_[x]) for x in long_lists.tolist()]
    edges = np.r_[np.arange(0, n_docs, WINDOW), n_docs]
    cuts = [np.searchsorted(p, edges) for p in posts]
    for b in range(len(edges) - 1):                           # document at a time, in windows
        lo, hi = int(edges[b]), int(edges[b + 1])
        size = np.array([c[b + 1] - c[b] for c in cuts])
        limit = np.where(size > 0, bound, 0)
        floor = best.threshold
        bounds = np.r_[limit, int(sums[lo:hi].max())]         # the accumulators come last
        rising = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[rising])
        if reach[-1] < floor:
            continue
        # iterators that cannot lift a document to the threshold even together are probed only
        n_probed = int(np.searchsorted(reach, floor, "left"))
        probed = rising[:n_probed]
        score = sums[lo:hi].copy()
        alive = np.zeros(hi - lo, bool) if len(posts) in probed else score > 0
        for x in rising[n_probed:].tolist():
            if x < len(posts) and size[x]:
                s, e = cuts[x][b], cuts[x][b + 1]
                at = posts[x][s:e] - lo
                score[at] += weight[long_lists[x]] * seg.part(lists_[long_lists[x]])[s:e]
                alive[at] = True
        docs = np.flatnonzero(alive)
        probed = probed[(probed < len(posts))]
        rest = int(limit[probed].sum())
        for x in probed[::-1].tolist():                       # best bound first
            docs = docs[score[docs] + rest >= floor]
            if not len(docs):
                break
            if size[x]:
                s, e = cuts[x][b], cuts[x][b + 1]
                mine = posts[x][s:e] - lo
                at = np.minimum(np.searchsorted(mine, docs), len(mine) - 1)
                hit = mine[at] == docs
                score[docs[hit]] += weight[long_lists[x]] * seg.part(lists_[long_lists[x]])[s:e][at[hit]]
            rest -= int(limit[x])
        docs = docs[score[docs] >= max(1, floor)]
        if len(docs):
            best.add(*_top(score[docs], docs + lo, seg, best.k))


def _top(scores: np.ndarray, docs: np.ndarray, seg: Segment, k: int) -> tuple[np.ndarray, list]:
    """The documents with the k highest scores, ties of the k-th included."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, docs = scores[keep], docs[keep]
    return scores, seg.ids.take(pa.array(docs)).to_pylist()


def _segments(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[Segment]:
    """Segments of rows sorted by ``segment, t`` (the row with the lengths first)."""
    held: list[pa.RecordBatch] = []

    def made() -> Segment:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, sizes = rows.column("ids").chunk(0)[0].values, rows.column("sizes").chunk(0)[0].values
        rows = rows.slice(1)
        if not len(rows):
            none = np.zeros(0, np.int64)
            return Segment(ids, sizes.to_numpy(), none, np.zeros(1, np.int64), none, none, queries)
        docs, tfs = rows.column("docs").combine_chunks(), rows.column("tfs").combine_chunks()
        first = np.r_[0, np.cumsum(docs.value_lengths().to_numpy())]
        return Segment(ids, sizes.to_numpy(), rows.column("t").to_numpy(), first,
                       docs.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), queries)

    now = None
    for batch in batches:
        seg = batch.column("segment").to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(seg)) + 1, len(seg)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e > s:
                if held and seg[s] != now:
                    yield made()
                    held = []
                now = seg[s]
                held.append(batch.slice(s, e - s))
    if held:
        yield made()


def search(index: DataFrame, queries: DataFrame, k: int = 20, query_key: str = "item_id", text: str = "text",
           key: str = "doc_id") -> DataFrame:
    """``(query_key, rank, key, score)``: each query's ``k`` best documents."""
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    about = index.where("term is null").select(F.explode("sizes").alias("n")).agg(
        F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    n_docs, n_words = int(about[0]), int(about[1] or 0)
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = (queries.select(F.col(query_key).alias("q"), F.col(text).alias("text")).distinct()
             .select("q", "text", F.coalesce(F.regexp_extract_all(lowered.alias("x"), F.lit(PATTERN), F.lit(0)),
                                             F.array().cast("array<string>")).alias("terms")))
    found = None
    for block in _blocks(asked.drop("text"), BLOCK_BYTES):
        got = _search_block(spark, index, block, k, n_docs, n_words, kind)
        q = spark.createDataFrame([(i, r["q"]) for i, r in enumerate(block)],
                                  f"i long, q {queries.schema[query_key].dataType.simpleString()}")
        got = got.join(F.broadcast(q), "i").select(F.col("q").alias(query_key), "rank", F.col("id").alias(key), "score")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], f"{query_key} {queries.schema[query_key].dataType.simpleString()}, rank int, {key} {kind}, score long")
    return found


def _blocks(asked: DataFrame, most: int) -> Iterator[list]:
    """Queries in blocks of bounded size, one block at a time on the driver."""
    block, size = [], 0
    for r in asked.toLocalIterator():
        block.append(r)
        size += 64 + sum(len(t) + 32 for t in r["terms"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search_block(spark, index: DataFrame, block: list, k: int, n_docs: int, n_words: int, kind: str) -> DataFrame:
    number: dict[str, int] = {}
    for r in block:
        for t in r["terms"]:
            number.setdefault(t, len(number))
    terms = F.broadcast(spark.createDataFrame(list(number.items()), "term string, t long"))
    hits = index.join(terms, "term")
    ratio = (F.lit(2 * n_docs + 2).cast("double") / (2 * F.sum(F.size("docs")) + 1))
    weigh = hits.groupBy("t").agg(F.floor(1000 * F.log(ratio)).alias("w"))
    weight = {r["t"]: int(r["w"]) for r in weigh.toLocalIterator()}      # at most the block's terms
    wanted, weights = [], []
    for r in block:
        times: dict[int, int] = {}
        for t in r["terms"]:
            if weight.get(number[t], 0) > 0:
                times[number[t]] = times.get(number[t], 0) + 1
        wanted.append(sorted(times))
        weights.append([times[t] * weight[t] for t in sorted(times)])
    queries = Queries(wanted, weights, n_docs, n_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.terms]
        id_type = None
        for seg in _segments(batches, queries):
            id_type = seg.ids.type
            for q, b in enumerate(best):
                rank_segment(seg, queries.terms[q], queries.weights[q], b)
        if id_type is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best])),
                 pa.array([x for b in best for x in b.ids], id_type),
                 pa.array([x for b in best for x in b.scores], pa.int64())], names=["i", "id", "score"])

    rows = hits.select("segment", "t", "docs", "tfs", F.lit(None).cast(f"array<{kind}>").alias("ids"),
                       F.lit(None).cast("array<long>").alias("sizes"))
    rows = rows.unionByName(index.where("term is null").select("segment", F.lit(-1).cast("long").alias("t"), "docs", "tfs", "ids", "sizes"))
    top = (rows.repartition("segment").sortWithinPartitions("segment", "t")
           .mapInArrow(run, f"i long, id {kind}, score long"))
    by = Window.partitionBy("i").orderBy(F.desc("score"), "id")
    return top.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, **names: str) -> DataFrame:
    """Index ``docs`` and rank them for ``queries``."""
    return search(materialize(build_index(docs), "lexical-index"), queries, k, **names)
