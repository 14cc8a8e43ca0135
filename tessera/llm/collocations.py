"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into ``shards`` shards that are scanned in a cycle.  Counting
of phrases of all lengths is interleaved: single words are counted from the first
shard on; a longer phrase becomes active as soon as both phrases it leaves when
its last or first word is cut have reached the threshold, starts with the next
shard, and is complete after one full cycle.  Mining ends when nothing has been
activated for a whole cycle.

Texts are tokenised once, into chunks that hold the distinct words and flat
codes of one language, and a 96-bit key per word.  A scan step is a map over one
shard: it adds up the active phrases inside each chunk and sends arrays of 96-bit
keys and counts by range of keys, which are added to the table of open counts.  At the end one more scan gives the frequent keys their words.  What a task must know about the active
phrases is one byte per slot of a fixed table: the step at which a phrase hashing
there was first activated.  A phrase counts as active from the later of its two
slots on, and not before its parts.  Since slots only ever go from empty to set, every task at every step
takes the same decision; a clash can only start a phrase early, and it is still
counted for exactly one cycle.  So counts are exact, and the table (at most
``MOST_SLOTS`` bytes) is all that is broadcast.

Defined results: a null text is empty; a null language is ``und``; phrases do not
cross pieces; texts without words give nothing; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm.data import discard, ensure_checkpoint_dir, materialize
from tessera.llm.flat import mix, text_bytes
from tessera.llm.vocab import byte_class, encode, lists, packed, unpacked

LONGEST = 5
CHUNK_BYTES = 4 << 20
MOST_SLOTS = 1 << 26
BUCKET_WORDS = 1 << 19
ADD_BYTES = 8 << 20
ROW_KEYS = 1 << 13
NAME_CHUNKS = 16
#: Bytes that end a piece, and bytes that part words.
BREAKS = byte_class(b".,;:!?\x0a\x0b\x0c\x0d")
SOLID = ~(BREAKS | byte_class(b" \t"))


def _keys(words: list[str]) -> np.ndarray:
    """Key of each word: 64 and 32 bits of its hash, the latter in 64-bit numbers."""
    hi, lo = np.frombuffer(b"".join(xxh3_128_digest(w.encode()) for w in words), np.uint64).reshape(-1, 2).T
    return np.stack([hi, lo >> np.uint64(32)])


def encoded(docs: DataFrame, shards: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(shard, lang, words, hi, lo, codes, n)`` chunks: distinct words and their
    keys, each word occurrence's place in them with -1 between pieces, number of
    occurrences; arrays of numbers are packed."""

    def chunk(lang: str, texts: list[pa.Array], shard: int) -> pa.RecordBatch:
        raw, off = text_bytes(pa.concat_arrays(texts))
        words, code, starts = encode(raw, off, SOLID)
        piece = np.cumsum(BREAKS[raw], dtype=np.int32)[starts] + np.searchsorted(off, starts, "right")
        code = np.insert(code, np.flatnonzero(np.diff(piece)) + 1, -1)
        hi, lo = _keys(words.to_pylist())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([lang]), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
             packed(hi), packed(lo), packed(code.astype(np.int32)), pa.array([len(starts)], pa.int64())],
            names=["shard", "lang", "words", "hi", "lo", "codes", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            code = batch.column("lang").dictionary_encode()
            for k, name in enumerate(code.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(code.indices, k))
                ends = text_bytes(texts)[1]
                i = 0
                while i < len(texts):                         # up to a chunk at a time, or one longer text
                    room = CHUNK_BYTES - size.get(name, 0)
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] + room, "right")) - 1)
                    held.setdefault(name, []).append(texts.slice(i, j - i))
                    size[name] = size.get(name, 0) + int(ends[j] - ends[i])
                    i = j
                    if size[name] >= CHUNK_BYTES or sum(size.values()) >= 2 * CHUNK_BYTES:
                        full = max(size, key=size.get)
                        yield chunk(full, held.pop(full), shard % shards)
                        shard, _ = shard + 1, size.pop(full)
        for name in held:
            yield chunk(name, held[name], shard % shards)
            shard += 1
        pa.default_memory_pool().release_unused()

    return (docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .mapInArrow(run, "shard int, lang string, words array<string>, hi binary, lo binary, codes binary, n long"))


#: Multipliers of the two parts of a key.  Of 10^12 phrases two share a key with
#: probability 10^-5.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _chain(before: tuple, word: tuple) -> tuple:
    """Key of a phrase from those of all but its last word and its last word."""
    hi, lo = (mix(b * f + w) for b, w, f in zip(before, word, FACTORS))
    return hi, lo >> np.uint64(32)


def _active_from(table: np.ndarray, key: tuple) -> np.ndarray:
    """The step from which phrases of these keys count as active; 0: not yet."""
    bits = len(table).bit_length() - 1
    a, b = table[key[0] >> np.uint64(64 - bits)], table[key[1] >> np.uint64(32 - bits)]
    return np.where((a > 0) & (b > 0), np.maximum(a, b), 0).astype(np.int32)


def _phrases(batch: pa.RecordBatch, r: int, table: np.ndarray, longest: int, wanted=None):
    """Of each length, ``(k, first words' places, keys, since)`` of a chunk's phrases
    whose parts are active; ``wanted(since)`` selects what is returned, not what
    is extended."""
    code = unpacked(batch.column("codes"), r, np.int32)
    word = tuple(unpacked(batch.column(x), r, np.uint64) for x in ("hi", "lo"))
    if not len(word[0]):
        return
    start = _keys([batch.column("lang")[r].as_py()])
    key = _chain((start[0], start[1]), word)
    active = np.r_[_active_from(table, key), 0]               # the last place is that of -1
    pos = np.flatnonzero(active[code])
    since, key = active[code[pos]], tuple(x[code[pos]] for x in key)
    yield 1, pos, key, since
    for k in range(2, longest + 1):                           # phrases of k words from two of k - 1
        pair = np.flatnonzero(np.diff(pos) == 1)
        pos, since = pos[pair], np.maximum(since[pair], since[pair + 1])
        key = _chain(tuple(x[pair] for x in key), tuple(x[code[pos + k - 1]] for x in word))
        yield k, pos, key, since
        own = _active_from(table, key)
        keep = np.flatnonzero(own)                            # never active before its parts, clash or not
        pos, key, since = pos[keep], tuple(x[keep] for x in key), np.maximum(own[keep], since[keep])


#: A row of counts holds phrases of one bucket (a range of keys) as packed
#: arrays: the parts of the keys in order, counts, and ``due * 8 + k``, where ``due``
#: is the step that completes the phrase's cycle and ``k`` its length.
COUNTS = "bucket long, hi binary, lo binary, n binary, tag binary"
KINDS = {"hi": np.uint64, "lo": np.uint32, "n": np.int64, "tag": np.int32}


def _scan(batches: Iterator[pa.RecordBatch], now: int, shards: int, table: np.ndarray, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of one step, added up inside each chunk."""
    for batch in batches:
        for r in range(batch.num_rows):
            found = []
            word = tuple(unpacked(batch.column(x), r, np.uint64) for x in ("hi", "lo"))
            if now <= shards and len(word[0]):
                code = unpacked(batch.column("codes"), r, np.int32)
                start = _keys([batch.column("lang")[r].as_py()])
                n = np.bincount(code[code >= 0], minlength=len(word[0]))
                found.append((*_chain((start[0], start[1]), word), n, np.full(len(n), shards * 8 + 1)))
            for k, pos, key, since in _phrases(batch, r, table, longest):
                counted = np.flatnonzero(now - since <= shards) if k > 1 else ()
                if len(counted):
                    first, n = _runs(key[0][counted], key[1][counted])
                    at = counted[first]
                    found.append((key[0][at], key[1][at], n, (since[at] + shards) * 8 + k))
            if found:
                hi, lo, n, tag = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(hi)
                hi = hi[order]
                bucket = ((hi >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                size = np.diff(np.r_[first, len(hi)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first]), packed(hi, size), packed(lo[order].astype(np.uint32), size), packed(n[order], size),
                     packed(tag[order].astype(np.int32), size)], names=["bucket", *KINDS])
    pa.default_memory_pool().release_unused()


def _add(batches: Iterator[pa.RecordBatch], now: int, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts added up bucket by bucket, from rows sorted by bucket: ``was`` marks
    those of the table of open counts, the others are of the step.  Rare phrases
    whose cycle is complete are closed.  ``slots`` are those of the phrases that
    reached the threshold in this step, with their least length in ``shortest``."""
    held: list[pa.RecordBatch] = []                           # all rows so far of a bucket that may go on
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        i = 0
        while i < len(bucket):                                # whole buckets, a bounded number of bytes at a time
            j = min(len(bucket), i + max(1, int(np.searchsorted(np.cumsum(_sizes(batch)[i:]), ADD_BYTES))))
            last = bucket[j - 1]
            cut = i + int(np.searchsorted(bucket[i:j], last))
            if held and held[-1].column("bucket")[0].as_py() != bucket[i]:
                yield _added(held, now, least, bits)
                held = []
            if cut > i:
                yield _added([*held, batch.slice(i, cut - i)], now, least, bits)
                held = []
            held.append(batch.slice(cut, j - cut))
            i = j
    if held:
        yield _added(held, now, least, bits)
    pa.default_memory_pool().release_unused()


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.binary_length(batch.column("hi")).to_numpy()


def _added(rows: list[pa.RecordBatch], now: int, least: int, bits: int) -> pa.RecordBatch:
    hi, lo, n, tag = (np.concatenate([unpacked(b.column(x), r, kind) for b in rows for r in range(b.num_rows)]) for x, kind in KINDS.items())
    size = np.concatenate([_sizes(b) for b in rows]) // 8
    was = np.repeat(np.concatenate([b.column("was").to_numpy(zero_copy_only=False) for b in rows]), size)
    bucket = np.repeat(np.concatenate([b.column("bucket").to_numpy() for b in rows]), size)
    order = np.lexsort((lo, hi))                              # buckets are ranges of hi
    hi, lo, n, tag, was, bucket = hi[order], lo[order], n[order], tag[order], was[order], bucket[order]
    first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    old = np.add.reduceat(np.where(was, n, 0), first) >= least
    hi, lo, n, tag, bucket = hi[first], lo[first], np.add.reduceat(n, first), tag[first], bucket[first]
    new = (n >= least) & ~old
    keep = (n >= least) | (tag // 8 > now)
    slots = np.unique(np.r_[hi[new] >> np.uint64(64 - bits), lo[new].astype(np.uint64) >> np.uint64(32 - bits)]).astype(np.int64)
    shortest = int((tag[new] % 8).min()) if new.any() else 0
    hi, lo, n, tag, bucket = hi[keep], lo[keep], n[keep], tag[keep], bucket[keep]
    first = np.union1d(np.flatnonzero(np.r_[-1, bucket[:-1]] != bucket), np.arange(0, len(bucket), ROW_KEYS))
    size = np.diff(np.r_[first, len(bucket)])
    blank = np.zeros(len(size), np.int64)                     # the slots are a row of their own
    return pa.RecordBatch.from_arrays(
        [pa.array(np.r_[bucket[first], -1]), *(packed(x, np.r_[size, 0]) for x in (hi, lo, n, tag)),
         lists(slots, np.r_[blank, len(slots)], pa.int64()), pa.array(np.r_[blank, shortest], pa.int32())],
        names=["bucket", *KINDS, "slots", "shortest"])


def _runs(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(a place, number)`` of each distinct key."""
    order = np.argsort(hi)
    if (np.diff(hi[order].view(np.int64)) == 0).any():
        order = np.lexsort((lo, hi))
    fresh = np.flatnonzero(np.r_[True, (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])])
    return order[fresh], np.diff(np.r_[fresh, len(order)])


def _names(batches: Iterator[pa.RecordBatch], table: np.ndarray, wanted: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """The words of the phrases whose slots are ``wanted``: ``(hi, lo, lang, phrase)``,
    once a chunk."""
    for batch in batches:
        for r in range(batch.num_rows):
            code, words = unpacked(batch.column("codes"), r, np.int32), batch.column("words")[r].values
            for k, pos, key, _ in _phrases(batch, r, table, longest):
                some = np.flatnonzero(_active_from(wanted, key))
                if not len(some):
                    continue
                some = some[_runs(key[0][some], key[1][some])[0]]
                at = [words.take(pa.array(code[pos[some] + j])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*at, " ") if k > 1 else at[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[0][some].view(np.int64)), pa.array(key[1][some].view(np.int64)),
                     pa.array([batch.column("lang")[r].as_py()] * len(some), pa.string()), phrase], names=["hi", "lo", "lang", "phrase"])


def _named(counts: DataFrame, chunks: DataFrame, table: np.ndarray, longest: int, bits: int) -> DataFrame:
    """``counts`` with ``lang`` and ``phrase``.  Few chunks hold most phrases, so growing
    groups of chunks are read, each for the phrases that still lack their words."""
    share = F.pmod(F.xxhash64("shard", "lang", "n", "codes"), F.lit(1 << 32)) / float(1 << 32)
    low, high, todo, parts = 0.0, min(1.0, NAME_CHUNKS / max(1, chunks.count())), counts, []
    while low < 1.0 and not todo.isEmpty():
        slots = F.explode(F.array(F.shiftrightunsigned("hi", 64 - bits), F.shiftrightunsigned("lo", 32 - bits)))
        wanted = np.zeros(len(table), np.uint8)
        wanted[todo.select(slots.alias("slot")).distinct().toArrow()["slot"].to_numpy()] = 1
        group = chunks.where((share >= low) & (share < high)).select("lang", "words", "hi", "lo", "codes")

        def names(batches):
            return _names(batches, table, wanted, longest)

        found = group.mapInArrow(names, "hi long, lo long, lang string, phrase string")
        found = found.groupBy("hi", "lo").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
        got = materialize(todo.join(found, ["hi", "lo"], "left"), "phrase-names")
        parts.append(got.where("phrase is not null"))
        todo = got.where("phrase is null").select(counts.columns)
        low, high = high, min(1.0, 2 * high)
    return reduce(DataFrame.unionByName, parts) if parts else counts.select("*", F.lit("").alias("lang"), F.lit("").alias("phrase"))


def _unpack(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row for each frequent phrase of packed counts."""
    for batch in batches:
        for r in range(batch.num_rows):
            hi, lo, n, tag = (unpacked(batch.column(x), r, kind) for x, kind in KINDS.items())
            some = n >= least
            yield pa.RecordBatch.from_arrays(
                [pa.array(hi[some].view(np.int64)), pa.array(lo[some].astype(np.int64)), pa.array(tag[some] % 8), pa.array(n[some])],
                names=["hi", "lo", "k", "n"])


def _chunk_table(chunks: DataFrame) -> DataFrame:
    """The chunks as a table with few rows in a row group: a reader holds one
    chunk at a time, not all those of a file."""
    path = f"{ensure_checkpoint_dir(chunks.sparkSession).rstrip('/')}/tessera-phrase-chunks/{uuid4().hex}"
    chunks.write.option("parquet.block.size", CHUNK_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)
    return chunks.sparkSession.read.parquet(path)


def frequent_phrases(chunks: DataFrame, shards: int, least: int = 100, longest: int = LONGEST) -> DataFrame:
    """``(lang, phrase, k, n)``: all phrases of 1 to ``longest`` words that occur
    ``least`` times or more, with their counts, from ``encoded`` chunks."""
    if (longest + 1) * shards > 255:
        raise ValueError("too many shards: a step must fit a byte")
    n_words = int(chunks.agg(F.sum("n")).first()[0] or 0)
    bits = min(max((n_words // 32).bit_length(), 12), MOST_SLOTS.bit_length() - 1)
    buckets = max(1, n_words // BUCKET_WORDS)
    table = np.zeros(1 << bits, np.uint8)
    spark = chunks.sparkSession
    state, now, last = None, 0, 0
    while now < shards or now - last < shards:
        now += 1
        known = spark.sparkContext.broadcast(table)

        def scan(batches):                                    # both are pickled and run within this step
            return _scan(batches, now, shards, known.value, longest, buckets)

        def add(batches):
            return _add(batches, now, least, bits)

        rows = chunks.where(F.col("shard") == (now - 1) % shards).select("lang", "hi", "lo", "codes")
        rows = rows.mapInArrow(scan, COUNTS).withColumn("was", F.lit(False))
        if state is not None:
            rows = rows.unionByName(state.withColumn("was", F.lit(True)))
        kept = materialize(rows.repartition("bucket").sortWithinPartitions("bucket")
                           .mapInArrow(add, f"{COUNTS}, slots array<long>, shortest int"), "phrase-counts")
        got = kept.select(F.explode("slots").alias("slot"), "shortest").groupBy("slot").agg(F.min("shortest").alias("k")).toArrow()
        if len(got):
            table, slots = table.copy(), got["slot"].to_numpy()
            table[slots] = np.where(table[slots] == 0, now, table[slots])
            last = now if (got["k"].to_numpy() < longest).any() else last
        discard(state)
        known.destroy()
        spark._jvm.System.gc()                                # lets Spark delete the shuffle files of finished steps
        state = kept.select("bucket", "hi", "lo", "n", "tag").where("bucket >= 0")
    counts = materialize(state.mapInArrow(lambda batches: _unpack(batches, least), "hi long, lo long, k int, n long"), "phrase-frequent")
    freq = materialize(_named(counts, chunks, table, longest, bits).select("lang", "phrase", "k", "n"), "phrase-frequencies")
    discard(state)
    return freq


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, shards: int = 3, text: str = "text",
                 lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``most`` best
    phrases of 2 to 5 words.  A phrase is scored by the cut where its two
    parts come together least beyond chance, and dropped if a longer frequent
    phrase holds it in all its places."""
    chunks = _chunk_table(encoded(docs, shards, text, lang))
    total = materialize(chunks.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    freq = frequent_phrases(chunks, shards, least)
    discard(chunks)
    words, j = F.split("phrase", " "), F.col("j")
    found = freq.where("k > 1").withColumnRenamed("n", "a")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    cuts = found.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "j", part(F.lit(1), j).alias("left"), part(j + 1, F.col("k") - j).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(freq.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    cuts = cuts.join(total, "lang").withColumn("score", F.expr(
        "(cast(1000 * a as decimal(20, 0)) * cast(total as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "j", "l", "r", "a", "total")).alias("b"))
    # a phrase inside a longer one with the same count is inside one that is one word longer
    longer = found.where("k > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("covered"))
    best = best.join(longer, ["lang", "phrase"], "left").where("covered is null or covered < b.a")
    by = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("b.a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "b.a", "b.l", "b.r",
                       F.col("b.total").alias("n"), "b.score")
