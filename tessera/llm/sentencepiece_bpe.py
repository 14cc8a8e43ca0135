"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat byte array.  It is cut where no piece of the
vocabulary can reach across (no piece holds that pair of neighbouring bytes),
equal words are encoded once, and all distinct words are merged together: each
round finds every word's smallest pair rank (a segmented minimum), merges all
leftmost non-overlapping pairs of that rank and compacts the arrays, until no
pair remains.  A piece that can take part in a pair of a smaller or equal rank
than its own is merged once per word and round, so the result is that of the
library's one-by-one agenda.  Words longer than ``LONG_WORD`` symbols (runs of
spaces, unbroken strings) use a heap over the same pair table.

The model file is read, never trained.  Only identity normalisation (white
space escaping, dummy prefix, white space kept) without user-defined pieces is
supported; another model raises ``ValueError``.

Defined results: a null or empty text has only the end id (when asked for) and
decodes to the empty text; repeated rows are repeated; extra columns are not
carried unless named in ``keep``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.flat import chunks, ranges, span_hashes

LONG_WORD = 300
NO_PAIR = np.int32(2 ** 31 - 1)
SPACE = "▁"


class BpeModel:
    """Pair table, character table and piece bytes of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.eos = sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = np.array([sp.is_byte(i) for i in range(n)])
        special = np.array([sp.is_control(i) or sp.is_unknown(i) for i in range(n)]) | self.byte
        if any(sp.is_unused(i) for i in range(n)) or sp.encode("a  b ") != sp.encode("a  b ", nbest_size=0):
            raise ValueError("models with unused or sampled pieces are not supported")
        if sp.encode("  ") == sp.encode("") or sp.decode(sp.encode(" ﬁ x ")) != " ﬁ x ":
            raise ValueError("only identity normalisation with kept white space is supported")
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.byte):
            self.byte_id[int(pieces[i][3:-1], 16)] = i

        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        left, right, made, unsafe = [], [], [], np.zeros(n, bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
                    unsafe[a] |= rank[i] <= rank[a]
                    unsafe[b] |= rank[i] <= rank[b]
        self.rank, self.unsafe = np.append(rank, NO_PAIR).astype(np.int32), unsafe
        self._hash_pairs(np.array(left, np.int64), np.array(right, np.int64), np.array(made, np.int32))

        self.chars = {ord(p) if p != SPACE else 32: i for p, i in normal.items() if len(p) == 1}
        self.near = np.full(0x10000, -1, np.int32)
        for c, i in self.chars.items():
            if c < 0x10000:
                self.near[c] = i
        self.joint = np.zeros((256, 256), bool)
        texts = [b""] * n
        for i, p in enumerate(pieces):
            if self.byte[i]:
                texts[i] = bytes([int(p[3:-1], 16)])
            elif not special[i]:
                texts[i] = p.replace(SPACE, " ").encode()
                u = np.frombuffer(texts[i], np.uint8)
                self.joint[u[:-1], u[1:]] = True
            elif sp.is_unknown(i):
                texts[i] = " ⁇ ".encode()
        self.joint[:, 0x80:0xC0] = True                       # never inside a character
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_len = np.array([len(t) for t in texts], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        self.spaced = np.array([t[:1] == b" " for t in texts]) & ~special
        self.digits = np.array([list(f"{i} ".encode().ljust(8, b"\0")) for i in range(n)], np.uint8)
        self.n_digits = (self.digits != 0).sum(axis=1)

    def _hash_pairs(self, left, right, made) -> None:
        """Open addressing over a power of two of at least four slots a pair."""
        keys = left << 32 | right
        self.bits = max(8, int(4 * len(keys) - 1).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_made = np.full(1 << self.bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at[todo]] == -1
            won = todo[free]
            self.slot_key[at[won]] = keys[won]                # the last of several stays
            won = won[self.slot_key[at[won]] == keys[won]]
            self.slot_made[at[won]] = made[won]
            todo = todo[self.slot_key[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged piece of each pair, -1 where there is none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_made[at], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_made[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


@lru_cache(maxsize=2)
def load_model(path: str) -> BpeModel:
    return BpeModel(path)


def _merge_long(model: BpeModel, symbols: np.ndarray) -> np.ndarray:
    """The same merges for one long word: a heap of (rank, position)."""
    ids = symbols.tolist()
    n = len(ids)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    made = model.pair(symbols[:-1], symbols[1:])
    heap = [(int(model.rank[m]), int(i), ids[i], ids[i + 1], int(m)) for i, m in enumerate(made) if m >= 0]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        if i >= 0 and j < n:
            m = int(model.pair(np.array([ids[i]]), np.array([ids[j]]))[0])
            if m >= 0:
                heapq.heappush(heap, (int(model.rank[m]), i, ids[i], ids[j], m))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = m, -3
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        offer(i), offer(prev[i])
    return np.array([x for x in ids if x != -3], np.int32)


def merge_words(model: BpeModel, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word (flat symbols, symbols a word) to the end; returns the
    same layout."""
    n_words = len(lengths)
    done_symbols, done_word = [], []
    word = np.repeat(np.arange(n_words), lengths)
    ends = np.cumsum(lengths)
    for w in np.flatnonzero(lengths > LONG_WORD):
        out = _merge_long(model, symbols[ends[w] - lengths[w]:ends[w]])
        done_symbols.append(out), done_word.append(np.full(len(out), w))
    short = np.repeat(lengths <= LONG_WORD, lengths)
    sym, word = symbols[short], word[short]

    sizes = lengths[(lengths <= LONG_WORD) & (lengths > 0)]
    made = np.full(len(sym), -1, np.int32)
    same = np.flatnonzero(word[:-1] == word[1:])
    made[same] = model.pair(sym[same], sym[same + 1])
    rank = model.rank[made]                                   # index -1 holds NO_PAIR
    while len(sym):
        least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
        if (over := least == NO_PAIR).any():
            live = np.repeat(~over, sizes)
            done_symbols.append(sym[~live]), done_word.append(word[~live])
            sym, word, made, rank = sym[live], word[live], made[live], rank[live]
            sizes, least = sizes[~over], least[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, sizes))
        # leftmost, non-overlapping: every second one of a run of neighbours
        fresh = np.r_[True, np.diff(hit) != 1]
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        again = np.r_[False, word[hit][1:] == word[hit][:-1]]
        if again.any():
            first = np.maximum.accumulate(np.where(~again, np.arange(len(hit)), 0))
            hit = hit[~(again & model.unsafe[made[hit[first]]])]
        sym[hit] = made[hit]
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        changed = hit - np.arange(len(hit))                   # one symbol goes for each earlier merge
        sizes = sizes - np.bincount(np.searchsorted(np.cumsum(sizes), hit, "right"), minlength=len(sizes))
        sym, word, made, rank = sym[stay], word[stay], made[stay], rank[stay]
        flag = np.zeros(len(sym) + 1, bool)
        flag[changed] = flag[changed - 1] = True              # the last cell takes what -1 writes
        changed = np.flatnonzero(flag[:-1])
        made[changed] = -1
        inner = changed[changed + 1 < len(sym)]
        inner = inner[word[inner] == word[inner + 1]]
        made[inner] = model.pair(sym[inner], sym[inner + 1])
        rank[changed] = model.rank[made[changed]]
    flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int32)
    owner = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=n_words)


def _escaped(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before every text that is not empty; a literal escape mark
    counts as a space."""
    mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else []
    if len(mark):
        raw = raw.copy()
        raw[mark] = 32
        stay = np.ones(len(raw), bool)
        stay[mark + 1] = stay[mark + 2] = False
        off = np.r_[0, np.cumsum(stay)][off]
        raw = raw[stay]
    full = np.diff(off) > 0
    return np.insert(raw, off[:-1][full], 32), off + np.r_[0, np.cumsum(full)]


def _first_symbols(model: BpeModel, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of words as symbols: ``(symbols, symbols a word, code points)``;
    a character without a piece is -1 - its code point."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    ends = np.cumsum(lengths)
    counts = lead[ends] - lead[ends - lengths]
    symbols = np.where(points < 0x10000, model.near[np.minimum(points, 0xFFFF)], -1)
    for p in np.unique(points[points >= 0x10000]):
        symbols[points == p] = model.chars.get(int(p), -1)
    return np.where(symbols < 0, -1 - points, symbols).astype(np.int32), counts, points


def encode_words(model: BpeModel, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as flat bytes: ``(flat ids, ids a word)``."""
    symbols, counts, _ = _first_symbols(model, data, lengths)
    flat, counts = merge_words(model, symbols, counts)
    odd = flat < 0
    if odd.any():                                             # characters outside the vocabulary, as bytes
        point = -1 - flat[odd]
        texts = [chr(c).encode() for c in point.tolist()]
        width = np.ones(len(flat), np.int64)
        width[odd] = [len(t) for t in texts]
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(flat, width)
        out[np.repeat(odd, width)] = model.byte_id[np.frombuffer(b"".join(texts), np.uint8)]
        counts = np.bincount(owner, weights=width, minlength=len(counts)).astype(np.int64)
        flat = out
    return flat, counts


def encode_flat(model: BpeModel, raw: np.ndarray, off: np.ndarray, end: bool = True
                ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts of a flat array: ``(flat ids, row offsets)``."""
    raw, off = _escaped(raw, off)
    rows = len(off) - 1
    if len(raw):
        cut = np.empty(len(raw), bool)
        cut[0] = True
        cut[1:] = ~model.joint.ravel()[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(raw)]
        code, unique = pd.factorize(span_hashes(raw, starts, ends))
        first = np.empty(len(unique), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        sizes = (ends - starts)[first]
        flat, count = encode_words(model, raw[ranges(starts[first], sizes)], sizes)
        at = np.cumsum(count) - count
        ids = flat[ranges(at[code], count[code])]
        per_word = np.r_[0, np.cumsum(count[code])]
        row_off = per_word[np.searchsorted(starts, off)]
    else:
        ids, row_off = np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    if end:
        ids = np.insert(ids, row_off[1:], model.eos)
        row_off = row_off + np.arange(rows + 1)
    return ids, row_off


def decode_flat(model: BpeModel, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of id rows as ``(bytes, offsets)``: pieces joined, one leading
    space dropped, byte pieces read as UTF-8 (an invalid byte is U+FFFD)."""
    width = model.text_len[ids]
    data = model.text[ranges(model.text_at[ids], width)]
    ends = np.r_[0, np.cumsum(width)]
    out_off = ends[off]
    shown = np.flatnonzero(width)                             # first token of a row that has bytes
    first = np.searchsorted(shown, off[:-1])
    has = first < len(shown)
    tok = shown[first[has]]
    rows = np.flatnonzero(has)
    ok = (tok < off[1:][rows]) & model.spaced[ids[tok]]
    drop = ends[tok[ok]]
    odd = np.flatnonzero(model.byte[ids] & (width > 0) & (ids >= model.byte_id[0x80]))
    fixes = {}
    for r in np.unique(np.searchsorted(off, odd, "right") - 1).tolist():
        piece = data[out_off[r]:out_off[r + 1]].tobytes()
        try:
            piece.decode()
            if not (width[off[r]:off[r + 1] - 1] == 0).any():  # a piece without bytes ends a run of byte pieces
                continue
        except UnicodeDecodeError:
            pass
        fixes[r] = _mend(model, ids[off[r]:off[r + 1]])
    stay = np.ones(len(data), bool)
    stay[drop] = False
    out_off = np.r_[0, np.cumsum(stay)][out_off]
    data = data[stay]
    if fixes:
        parts = [fixes.get(r, data[out_off[r]:out_off[r + 1]].tobytes()) for r in range(len(off) - 1)]
        data = np.frombuffer(b"".join(parts), np.uint8)
        out_off = np.r_[0, np.cumsum([len(p) for p in parts])]
    return data, out_off


def _mend(model: BpeModel, ids: np.ndarray) -> bytes:
    """One row whose byte pieces are not all valid UTF-8."""
    out, run, first = [], b"", True

    def flush(run: bytes) -> str:
        text, i = "", 0
        while i < len(run):
            for k in (1, 2, 3, 4):
                try:
                    text += run[i:i + k].decode()
                    break
                except UnicodeDecodeError:
                    continue
            else:
                text, k = text + "�", 1
            i += k
        return text

    for t in ids.tolist():
        piece = model.text[model.text_at[t]:model.text_at[t] + model.text_len[t]].tobytes()
        if model.byte[t]:
            run, first = run + piece, False
            continue
        out.append(flush(run))
        run = b""
        if first and model.spaced[t]:
            piece = piece[1:]
        first &= not model.text_len[t]
        out.append(piece.decode())
    return "".join([*out, flush(run)]).encode()


def _strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32).tobytes()),
                                       pa.py_buffer(np.ascontiguousarray(data).tobytes()))


def _decimal(model: BpeModel, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids of each row joined by one space."""
    cells = model.digits[ids]                                 # eight bytes an id, zeros at the end
    ends = np.r_[0, np.cumsum(model.n_digits[ids])]
    data, row = cells[cells != 0], ends[off]
    full = np.diff(row) > 0                                   # without the space after a row's last id
    stay = np.ones(len(data), bool)
    stay[row[1:][full] - 1] = False
    return data[stay], np.r_[0, np.cumsum(stay)][row]


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",),
           end: bool = True, ids: str = "array", decoded: bool = False) -> DataFrame:
    """Ids of every whole text.

    Returns the ``keep`` columns, ``n_tokens`` (long), ``ids`` (array<int>, or
    with ``ids="text"`` decimal ids joined by one space) and, if ``decoded``,
    the text that the ids decode to.  ``model_path`` must be readable on every
    executor (a file installed with the tokenizer package, or shipped with
    ``SparkContext.addFile``)."""
    src = docs.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)], F.col(text).alias("text"))
    fields = [T.StructField(f"k_{i}", docs.schema[k].dataType) for i, k in enumerate(keep)]
    fields += [T.StructField("n_tokens", T.LongType()),
               T.StructField("ids", T.ArrayType(T.IntegerType()) if ids == "array" else T.StringType())]
    fields += [T.StructField("decoded", T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            for i, j, raw, off in chunks(batch):
                flat, row = encode_flat(model, raw, off, end)
                if ids == "array":
                    out = pa.ListArray.from_arrays(pa.array(row.astype(np.int32)), pa.array(flat.astype(np.int32)))
                else:
                    out = _strings(*_decimal(model, flat, row))
                cols = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                cols += [pa.array(np.diff(row)), out]
                if decoded:
                    cols.append(_strings(*decode_flat(model, flat, row)))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    got = src.mapInArrow(run, T.StructType(fields))
    return got.withColumnsRenamed({f"k_{i}": k for i, k in enumerate(keep)})


def decode(rows: DataFrame, model_path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Texts of id lists (``array<int>``): the ``keep`` columns and ``text``.
    A null list decodes to the empty text; an id outside the vocabulary raises."""
    src = rows.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)],
                      F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    fields = [T.StructField(f"k_{i}", rows.schema[k].dataType) for i, k in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(model_path)
        for batch in batches:
            col = batch.column(len(keep))
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= model.size):
                raise ValueError("an id is outside the vocabulary")
            off = np.r_[0, np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            text = _strings(*decode_flat(model, flat, off))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(keep))], text],
                                             names=[*[f"k_{i}" for i in range(len(keep))], "text"])

    got = src.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
    return got.withColumnsRenamed({f"k_{i}": k for i, k in enumerate(keep)})
