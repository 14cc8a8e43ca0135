"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over quantile bins, learnt by cyclic boosting:
round after round, one small tree per feature is fitted to the gradient of the
log loss and added to that feature's table; then the pairs of features that
still explain most of the gradient get small two-way tables the same way.  A
score is the logistic of an intercept plus one table cell per feature and pair
(vectorised bin additions).

Features are read off whole texts in one pass (see ``FEATURES``); the model is
fitted on a hash sample of at most about ``max_train`` labelled rows, a
documented bound: a table has at most 48 cells.

Defined results: null and empty texts have all features 0 and are scored like
any other; repeated rows score alike; without training labels every score is
0.5.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.flat import BASE, chunks, mix, rows_of, span_hashes, words

FEATURES = ("log_words", "word_len", "upper", "digit", "symbol", "end_mark", "bare_words", "distinct",
            "repeated_triples", "words_a_line", "repeated_lines", "long_words", "same_byte", "top_symbol")

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SYMBOL = range(6)


def byte_classes() -> np.ndarray:
    """Class of each byte; bytes of other scripts count as lower-case letters."""
    kind = np.full(256, _LOWER)
    kind[:128] = _SYMBOL
    kind[65:91], kind[97:123], kind[48:58] = _UPPER, _LOWER, _DIGIT
    kind[[32, *range(9, 14)]] = _SPACE
    kind[[ord(c) for c in ".,;:'\"-()?"]] = _STOP
    return kind


_KIND: list[np.ndarray] = []


def feature_rows(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text of a flat array."""
    if not _KIND:
        _KIND.append(byte_classes())
    n = len(off) - 1
    row = rows_of(off)
    kind = _KIND[0][raw]
    by = np.bincount(row * 6 + kind, minlength=6 * n).reshape(n, 6).astype(float)
    share = lambda a, b: a / np.maximum(b, 1)
    solid, letters = by.sum(axis=1) - by[:, _SPACE], by[:, _UPPER] + by[:, _LOWER]

    starts, ends, at = words(raw, off)
    count = np.diff(at).astype(float)
    word_row = np.repeat(np.arange(n), np.diff(at))
    in_row = lambda mask, r: np.bincount(r[mask], minlength=n)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    code = span_hashes(raw, starts, ends)
    fresh = ~pd.Series(code ^ salt[word_row]).duplicated().to_numpy()
    triple = (code[:-2] * np.uint64(BASE) + code[1:-1]) * np.uint64(BASE) + code[2:] if len(code) > 2 else code[:0]
    ok = word_row[:-2] == word_row[2:] if len(code) > 2 else np.zeros(0, bool)
    again = pd.Series(mix(triple[ok]) ^ salt[word_row[:-2][ok]]).duplicated().to_numpy() if ok.any() else np.zeros(0, bool)
    triple_row = word_row[:-2][ok] if ok.any() else word_row[:0]

    is_letter = np.r_[0, np.cumsum((kind == _LOWER) | (kind == _UPPER))]
    bare = is_letter[ends] == is_letter[starts] if len(starts) else np.zeros(0, bool)
    marked = np.isin(raw[ends - 1], [ord(c) for c in ".!?"]) if len(ends) else np.zeros(0, bool)
    doubled = np.zeros(len(raw), bool)
    if len(raw) > 1:
        doubled[1:] = (raw[1:] == raw[:-1]) & (row[1:] == row[:-1]) & (kind[1:] >= _STOP)

    breaks = np.flatnonzero(raw == 10)
    line_start = np.sort(np.concatenate([off[:-1][np.diff(off) > 0], breaks + 1]))
    line_start = line_start[line_start < len(raw)]
    line_row = np.searchsorted(off, line_start, "right") - 1
    line_end = np.minimum(np.r_[line_start[1:], len(raw)], off[1:][line_row])
    line_dup = pd.Series(span_hashes(raw, line_start, line_end) ^ salt[line_row]).duplicated().to_numpy()
    lines = np.bincount(line_row, minlength=n).astype(float)

    codes = np.bincount(row[kind == _SYMBOL] * 128 + raw[kind == _SYMBOL], minlength=128 * n).reshape(n, 128)
    return np.column_stack([
        np.log1p(count), share(solid, count), share(by[:, _UPPER], letters), share(by[:, _DIGIT], solid),
        share(by[:, _SYMBOL], solid), share(in_row(marked, word_row), count), share(in_row(bare, word_row), count),
        share(in_row(fresh, word_row), count), share(in_row(again, triple_row), np.maximum(count - 2, 1)),
        np.log1p(share(count, lines)), share(in_row(line_dup, line_row), lines),
        share(in_row(ends - starts > 20, word_row), count), share(in_row(doubled, row), solid),
        share(codes.max(axis=1), solid)])


@dataclass
class AdditiveModel:
    """Bin edges and table of each feature, two-way tables, intercept."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], "right")]
        for a, b, ea, eb, t in self.pairs:
            total += t[np.searchsorted(ea, x[:, a], "right"), np.searchsorted(eb, x[:, b], "right")]
        return 1.0 / (1.0 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(grad: np.ndarray, hess: np.ndarray, splits: int, ridge: float = 1.0) -> np.ndarray:
    """Newton leaf values of a tree with ``splits`` greedy cuts over ordered cells."""
    g, h = np.r_[0.0, np.cumsum(grad)], np.r_[0.0, np.cumsum(hess)]
    cuts = [0, len(grad)]
    for _ in range(splits):
        best, where = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            left = (g[at] - g[lo]) ** 2 / (h[at] - h[lo] + ridge)
            right = (g[hi] - g[at]) ** 2 / (h[hi] - h[at] + ridge)
            gain = left + right - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + ridge)
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], lo + 1 + k
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(grad))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + ridge)
    return out


def _corners(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """Best cut in four quadrants of a two-way table: ``(gain, leaf table)``."""
    g, h = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (grad, hess))
    best, out = 0.0, np.zeros_like(grad)
    total = g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            q = [(x[i, j], x[i, -1] - x[i, j], x[-1, j] - x[i, j], x[-1, -1] - x[i, -1] - x[-1, j] + x[i, j]) for x in (g, h)]
            gain = sum(a * a / (b + ridge) for a, b in zip(*q)) - total
            if gain > best:
                v = [a / (b + ridge) for a, b in zip(*q)]
                best, out = gain, np.zeros_like(grad)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, n_pairs: int = 5,
          pair_bins: int = 8, pair_rounds: int = 40) -> AdditiveModel:
    """Fit the additive model by cyclic boosting."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    total = np.full(len(y), model.intercept)
    model.edges = [_edges(x[:, k], bins) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    cell = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]

    def slopes():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(cell[k], g, len(t)), np.bincount(cell[k], h, len(t)), 2)
            t += step
            total += step[cell[k]]
    coarse = [_edges(x[:, k], pair_bins) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def grid(a, b, v):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(at[a] * shape[1] + at[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = [(_corners(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)]
    chosen = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in sorted(gains)[::-1][:n_pairs]]
    for _ in range(pair_rounds):
        for a, b, t in chosen:
            g, h = slopes()
            step = rate * _corners(grid(a, b, g), grid(a, b, h))[1]
            t += step
            total += step[at[a], at[b]]
    model.pairs = [(a, b, coarse[a], coarse[b], t) for a, b, t in chosen]
    return model


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, x array<double>)`` with the features of every whole text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text"):
                x = feature_rows(raw, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(FEATURES)),
                                                pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), flat], names=["id", "x"])

    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"id {kind}, x array<double>").withColumnRenamed("id", key))


def fit(train: DataFrame, key: str = "doc_id", max_train: int = 20_000) -> AdditiveModel | None:
    """Model of ``(key, x, label)`` rows; the caller leaves out held-out rows."""
    train = train.where(F.col("label").isNotNull())
    n = train.count()
    if not n:
        return None
    cut = int(min(1.0, max_train / n) * (1 << 30))
    got = (train.where(F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 30)) < cut)
           .select(F.xxhash64(F.col(key)).alias("h"), "x", F.col("label").cast("double").alias("y")).toArrow())
    if not got.num_rows:
        return None
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    y = got["y"].to_numpy()
    order = np.lexsort((*x.T, y, got["h"].to_numpy()))
    return boost(x[order], y[order])


def score(rows: DataFrame, model: AdditiveModel | None, key: str = "doc_id") -> DataFrame:
    """``(key, score)`` of feature rows."""
    if model is None:
        return rows.select(key, F.lit(0.5).alias("score"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(x))], names=["id", "score"])

    return (rows.select(F.col(key).alias("id"), "x").mapInArrow(run, f"id {kind}, score double")
            .withColumnRenamed("id", key))
