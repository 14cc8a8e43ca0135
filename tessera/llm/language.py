"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, fitted by follow-the-regularised-leader with elastic-net
penalties and calibrated by a temperature.

Letters are folded to lower case and to one of 255 symbols, every run of other
characters is one border symbol; features are all symbol pairs and hashed
symbol triples of the whole text.  A text's vector is term frequency (count
over the number of n-grams) times inverse document frequency, the latter
counted over every training document.  The classifier is fitted on a hash
sample of at most about ``max_train`` training documents, split evenly over
the languages (a documented bound: four languages part after a few hundred
texts each); a fifth of the sample sets the temperature.

Defined results: a null text or one without any letter (``str.isalpha``) is
``und`` with score 0; so is every text when no training row has a label.
Repeated rows get equal results; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.flat import chunks

PAIRS = TRIPLES = 1 << 16
WIDTH = PAIRS + TRIPLES
BYTES = 1 << 20       # text worked through at once: its grams and weights take about a hundred times as much
SCALE = 20.0
UNKNOWN = "und"


def symbol_table() -> np.ndarray:
    """Symbol of each code point of the basic plane: 0 for what is no letter,
    1 to 127 for Latin letters in order, 128 to 254 shared by all others."""
    table = np.zeros(0x10000, np.uint8)
    latin: dict[str, int] = {}
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()[0]
            if ord(low) < 0x180:
                table[c] = min(latin.setdefault(low, len(latin) + 1), 127)
            else:
                table[c] = 128 + ord(low) * 40503 % 127
    return table


_TABLE: list[np.ndarray] = []


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each row of flat texts: ``(features, row offsets, letters a row)``."""
    if not _TABLE:
        _TABLE.append(symbol_table())
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][off]
    sym = _TABLE[0][np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):
        sym[points == p] = 128 + int(p) % 127 if chr(int(p)).isalpha() else 0
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    stay = sym > 0
    letters = np.bincount(row[stay], minlength=len(off) - 1)
    stay[1:] |= sym[:-1] > 0                                   # one border symbol after each letter run
    stay[at[:-1][np.diff(at) > 0]] = True
    sym, row = sym[stay].astype(np.int32), row[stay]
    if len(sym) < 3:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64), letters
    two, three = sym[:-1] * 256 + sym[1:], sym[:-2] * 65536 + sym[1:-1] * 256 + sym[2:]
    three = ((three.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32) + PAIRS
    ok2, ok3 = row[:-1] == row[1:], row[:-2] == row[2:]
    feats = np.concatenate([two[ok2], three[ok3]])
    rows = np.concatenate([row[:-1][ok2], row[:-2][ok3]])
    order = np.argsort(rows, kind="stable")
    return feats[order], np.r_[0, np.cumsum(np.bincount(rows, minlength=len(off) - 1))], letters


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, weight table (feature, language), bias, temperature."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(best language, its probability, letters)`` of each row."""
        feats, at, letters = grams(raw, off)
        n = np.diff(at)
        logit = np.zeros((len(n), len(self.languages)))
        full = n > 0
        if full.any():
            logit[full] = np.add.reduceat(self.weights[feats], at[:-1][full], axis=0, dtype=np.float64)
            logit[full] *= SCALE / n[full, None]
        p = softmax((logit + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best], letters


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequency(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents holding each feature, and documents, over all rows of ``texts``.
    Each task returns one row per feature; what reaches the driver is bounded
    by the number of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(WIDTH, np.int64), 0
        seen = np.empty(WIDTH, bool)
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text", BYTES):
                feats, at, _ = grams(raw, off)
                total += j - i
                for r in range(j - i):
                    seen[:] = False
                    seen[feats[at[r]:at[r + 1]]] = True
                    count += seen
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(count[some], total))],
                                         names=["feature", "n"])

    got = (texts.select(F.col(text).alias("text")).mapInArrow(run, "feature long, n long")
           .groupBy("feature").agg(F.sum("n").alias("n")).toArrow())
    feature, n = got["feature"].to_numpy(), got["n"].to_numpy()
    out = np.zeros(WIDTH, np.int64)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def _vectors(sample: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(label, part, features, counts) of each sampled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text", BYTES):
                feats, at, _ = grams(raw, off)
                made = [np.unique(feats[at[r]:at[r + 1]], return_counts=True) for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(i, j - i), batch.column("part").slice(i, j - i),
                     pa.array([m[0].astype(np.int32) for m in made], pa.list_(pa.int32())),
                     pa.array([m[1].astype(np.int32) for m in made], pa.list_(pa.int32()))],
                    names=["label", "part", "f", "n"])

    got = sample.mapInArrow(run, "label string, part long, f array<int>, n array<int>").toArrow()
    cols = [got[c].combine_chunks() for c in ("f", "n")]
    at = np.r_[0, np.cumsum(cols[0].value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    f, n = (c.flatten().to_numpy(zero_copy_only=False) for c in cols)
    keys = zip(got["label"].to_pylist(), got["part"].to_pylist())
    rows = [(a, b, f[at[i]:at[i + 1]], n[at[i]:at[i + 1]]) for i, (a, b) in enumerate(keys)]
    return sorted(rows, key=lambda r: (r[1], r[0], r[2].tobytes(), r[3].tobytes()))


def ftrl(rows, classes: int, width: int, epochs: int = 4, batch: int = 16, alpha: float = 0.3, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal, one learning rate a weight) on
    sparse rows ``(features, values, class)``: ``(weights, bias)``.  A weight
    stays zero until its summed gradient passes ``l1``."""
    z, g2 = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(g2[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        for s in range(0, len(rows), batch):
            part = rows[s:s + batch]
            idx = np.concatenate([np.append(f, width) for f, _, _ in part])
            val = np.concatenate([np.append(v, 1.0) for _, v, _ in part])
            row = np.repeat(np.arange(len(part)), [len(f) + 1 for f, _, _ in part])
            touched, inv = np.unique(idx, return_inverse=True)
            w = weights(touched)
            logit = np.zeros((len(part), classes))
            np.add.at(logit, row, w[inv] * val[:, None])
            p = softmax(logit)
            p[np.arange(len(part)), [y for _, _, y in part]] -= 1.0
            grad = np.zeros((len(touched), classes))
            np.add.at(grad, inv, p[row] * val[:, None])
            old = g2[touched]
            z[touched] += grad - (np.sqrt(old + grad ** 2) - np.sqrt(old)) / alpha * w
            g2[touched] = old + grad ** 2
    out = weights(np.arange(width + 1))
    return out[:-1], out[-1]


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature in [0.05, 20] of least log loss (golden section on its log)."""
    if not len(classes):
        return 1.0

    def loss(log_t):
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(classes)), classes], 1e-12)).mean()

    lo, hi, r = np.log(0.05), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id",
        max_train: int = 4000) -> LanguageModel | None:
    """Model of the labelled rows of ``train`` (None without any); the caller
    leaves out held-out rows.  Document frequencies cover all rows."""
    sizes = {r["l"]: r["n"] for r in train.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("l"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    df, n = document_frequency(train.where(F.col(label).isNotNull()), text)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0

    most, draw = max_train / len(languages), F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, most / v) * (1 << 30))])
    sample = (train.where(F.col(label).isNotNull()).where(draw < share[F.col(label)])
              .select(F.col(label).alias("label"), F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)).alias("part"),
                      F.col(text).alias("text")))
    rows = [(f, c / max(1, c.sum()) * SCALE * idf[f], languages.index(y), part) for y, part, f, c in _vectors(sample)]
    held = [r for r in rows if r[3] % 5 == 0]
    weights, bias = ftrl([r[:3] for r in rows if r[3] % 5], len(languages), WIDTH)
    logits = np.array([(weights[f] * v[:, None]).sum(axis=0) + bias for f, v, _, _ in held]).reshape(len(held), len(languages))
    t = temperature(logits, np.array([r[2] for r in held], np.int64))
    return LanguageModel(languages, (weights * idf[:, None]).astype(np.float32), bias, t)


def predict(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The ``keep`` columns, and language (``pred``) and ``score`` of every whole text."""
    names = {f"k_{i}": k for i, k in enumerate(keep)}
    src = docs.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)],
                      *[F.col(text).alias("text")] * (text not in keep))
    column = f"k_{keep.index(text)}" if text in keep else "text"
    if model is None:
        return (src.select(*names, F.lit(UNKNOWN).alias("pred"), F.lit(0.0).alias("p"))
                .withColumnsRenamed({**names, "pred": pred, "p": score}))
    labels = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch, column, BYTES):
                best, p, letters = model.scores(raw, off)
                none = letters == 0
                best[none], p[none] = len(labels) - 1, 0.0
                cols = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(labels[best], pa.string()), pa.array(p)],
                                                 names=[*names, "pred", "p"])

    kinds = "".join(f"k_{i} {docs.schema[k].dataType.simpleString()}, " for i, k in enumerate(keep))
    return (src.mapInArrow(run, f"{kinds}pred string, p double")
            .withColumnsRenamed({**names, "pred": pred, "p": score}))


def held_out(key: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of a decimal id leaves ``rest`` modulo ``parts``."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(parts)) == rest
