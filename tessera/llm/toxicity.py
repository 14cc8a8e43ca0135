"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded one character to one (lower case, look-alike letters of other
scripts to Latin ones, digits and signs that stand for letters), so terms
written to slip through are found at their place.  A term matches at the start
of a word; an exception phrase (a longer word or phrase that starts with a
term but is seen in clean texts) cancels the term matches inside it.  A text's
evidence is the summed term weight, also divided by the square root of its
number of words, and a logistic fit turns it into a score.

The lexicon is learnt from labelled rows: whole words and word beginnings of
``STEMS`` letters whose share of toxic documents is high and beyond chance
(a likelihood-ratio test); the shortest such beginning stands for all longer
ones.  Learning reads a hash sample of at most about ``max_train`` labelled
documents (a documented bound), one of each group that shares its smallest
five-word shingle hash, so copies do not count as evidence; the lexicon has at
most ``max_terms`` terms.

Defined results: null and empty texts hold no term and get the score of no
evidence; repeated rows score alike; without training labels every score is 0.
Other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.data import materialize
from tessera.llm.flat import chunks, mix, span_hashes, words

STEMS = (3, 4, 5, 6, 7)

# fixed values: letters of other scripts that look like Latin ones
LOOK_ALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
               "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r",
               "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "η": "n",
               "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ո": "n", "օ": "o", "ѵ": "v"}
# fixed values: digits and signs that stand for letters
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# fixed values: harmless words and phrases that start with a common term
HARMLESS = ("trash can", "trash bin", "trashcan", "scumble", "clown fish", "clownfish")


def fold_table() -> np.ndarray:
    """Folded code point of each code point of the basic plane."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if 0xFF01 <= c <= 0xFF5E:                             # full-width forms
            low = chr(c - 0xFEE0).lower()
        if len(low) == 1:
            table[c] = ord(LOOK_ALIKES.get(low, STAND_INS.get(low, low)))
    return table


def word_table() -> np.ndarray:
    """Whether a code point of the basic plane is a letter or digit."""
    return np.array([chr(c).isalnum() for c in range(0x10000)])


_TABLES: list[np.ndarray] = []


def fold(raw: np.ndarray) -> tuple[str, np.ndarray]:
    """Folded characters of flat UTF-8, and which originals are letters or digits."""
    if not _TABLES:
        _TABLES.extend([fold_table(), word_table()])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    near = np.minimum(points, 0xFFFF)
    folded = np.where(points > 0xFFFF, points, _TABLES[0][near])
    return folded.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), _TABLES[1][near]


def char_offsets(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][off]


@dataclass(frozen=True)
class ToxicityModel:
    """Weighted terms, exception phrases and the logistic over the evidence."""

    terms: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: np.ndarray

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for p in self.exceptions:
            made.add_word(p, (len(p), -1.0))
        for p, w in self.terms.items():
            made.add_word(p, (len(p), w))
        made.make_automaton()
        return made

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.coefficients[0] + x @ self.coefficients[1:], -50, 50)))


def evidence(automaton, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per row: summed weight over the square root of words, log of the summed
    weight, largest weight."""
    n = len(off) - 1
    text, alnum = fold(raw)
    at = char_offsets(raw, off)
    count = np.diff(words(raw, off)[2])
    hits = [(end, size, w) for end, (size, w) in automaton.iter(text)] if len(automaton) else []
    total, most = np.zeros(n), np.zeros(n)
    if hits:
        end, size, weight = (np.array(v) for v in zip(*hits))
        start = end - size + 1
        row = np.searchsorted(at, start, "right") - 1
        ok = (end < at[row + 1]) & ((start == at[row]) | ~alnum[np.maximum(start - 1, 0)])
        start, end, weight, row = start[ok], end[ok], weight[ok], row[ok]
        free = weight < 0
        if free.any():
            inside = np.zeros(len(text) + 1, np.int64)
            np.add.at(inside, start[free], 1)
            np.add.at(inside, end[free] + 1, -1)
            free |= np.cumsum(inside)[start] > 0
        np.add.at(total, row[~free], weight[~free])
        np.maximum.at(most, row[~free], weight[~free])
    return np.column_stack([total / np.sqrt(np.maximum(count, 1)), np.log1p(total), most])


def _candidates(text: str) -> set[str]:
    """Folded words and word beginnings of one text."""
    found = set()
    for w in set(text.split()):
        w = w.strip("\"'()[]{}<>.,;:!?|#%&*_-+=~`/\\")
        found.update(w[:k] for k in STEMS if k <= len(w))
        if 2 < len(w) <= 40:
            found.add(w + " ")                                # the blank marks a whole word
    return found


def _one_of_each(sample: DataFrame) -> DataFrame:
    """The row of smallest id of each group with the same smallest shingle hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text"):
                starts, ends, at = words(raw, off)
                code = span_hashes(raw, starts, ends)
                low = [int(_shingles(code[a:b]).min()) if b > a else 0 for a, b in zip(at, at[1:])]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.array(low, np.uint64).view(np.int64))],
                                                 names=["id", "text", "label", "low"])

    kind = sample.schema["id"].dataType.simpleString()
    return (sample.select("id", "text", F.col("label").cast("int").alias("label"))
            .mapInArrow(run, f"id {kind}, text string, label int, low long")
            .groupBy("low", F.when(F.col("low") == 0, F.col("id")).alias("own"))
            .agg(F.min_by(F.struct("text", "label"), "id").alias("r")).select("r.text", "r.label"))


def _shingles(code: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one text (of all its words if fewer)."""
    n = max(1, len(code) - 4)
    out = np.zeros(n, np.uint64)
    for k in range(min(5, len(code))):
        out = mix(out + code[k:k + n])
    return out


def term_counts(sample: DataFrame) -> DataFrame:
    """``(term, toxic, clean)``: documents of each kind that hold a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("label").to_pylist()
            counts = Counter(), Counter()
            for i, j, raw, off in chunks(batch, "text"):
                text, _ = fold(raw)
                at = char_offsets(raw, off)
                for r in range(j - i):
                    counts[int(marks[i + r] == 1)].update(_candidates(text[at[r]:at[r + 1]]))
            terms = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                 pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    return (sample.select("text", "label").mapInArrow(run, "term string, toxic long, clean long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (intercept first) by Newton steps on the penalised log loss."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    pen = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + pen, a.T @ (y - p) - pen @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fit(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = 30_000,
        max_terms: int = 2000, least: int = 4, chance: float = 24.0) -> ToxicityModel | None:
    """Model from ``marks`` (key, label), which leaves out held-out rows.

    The sampled ids are at most about ``max_train`` rows, so they are broadcast
    and the documents are not shuffled."""
    n = marks.count()
    if not n:
        return None
    cut = int(min(1.0, max_train / n) * (1 << 30))
    ids = marks.where(F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1 << 30)) < cut)
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(ids.withColumnRenamed(key, "id")), "id")
    sample = materialize(_one_of_each(sample), "toxicity-sample")
    totals = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return ToxicityModel({}, (), np.array([-50.0 if not totals.get(1) else 50.0, 0, 0, 0]))
    rate = totals[1] / (totals[0] + totals[1])
    counts = term_counts(sample)
    # a term's toxic share, pulled to the base rate by two documents, stands far above that rate
    share = (F.col("toxic") + 2 * rate) / (F.col("toxic") + F.col("clean") + 2)
    hits, seen = F.col("toxic"), F.col("toxic") + F.col("clean")
    gain = 2 * (hits * F.log(hits / seen / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(
        F.col("clean") / seen / (1 - rate))).otherwise(0.0))
    got = (counts.where(F.col("toxic") >= least).withColumn("share", share)
           .where((F.col("share") >= (1 + rate) / 2) & (gain >= chance))
           .orderBy(F.desc(F.col("toxic") * F.col("share")), "term").limit(20 * max_terms).collect())
    weight = {r["term"]: float(np.log(r["share"] / (1 - r["share"])) - np.log(rate / (1 - rate))) for r in got}
    terms: dict[str, float] = {}
    for t in sorted(weight, key=lambda t: (len(t.strip()), t)):
        if len(terms) < max_terms and not any(t.strip()[:k] in terms for k in range(3, len(t.strip()) + 1)):
            terms[t.strip()] = weight[t]
    seen = counts.where((F.col("clean") >= least) & (F.col("toxic") < F.col("clean") / 4))
    first = [F.substring("term", 1, k).alias(f"s{k}") for k in (3, *STEMS)]
    longer = seen.select("term", F.explode(F.array(*[f.alias("s") for f in first])).alias("stem")).where("term != stem")
    stems = docs.sparkSession.createDataFrame([(t,) for t in terms] or [("",)], "stem string")
    phrases = {r["term"].strip() for r in longer.join(F.broadcast(stems), "stem").select("term").distinct()
               .orderBy("term").limit(max_terms).collect()}
    model = ToxicityModel(terms, tuple(sorted(phrases - set(terms) | set(HARMLESS))), np.zeros(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text"):
                x = evidence(automaton, raw, off)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i),
                                                  *[pa.array(x[:, k]) for k in range(3)]], names=["y", "a", "b", "c"])

    rows = (sample.select("text", F.col("label").cast("int").alias("label"))
            .mapInArrow(run, "y int, a double, b double, c double").toArrow())
    x = np.column_stack([rows[c].to_numpy() for c in "abc"])
    y = rows["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return ToxicityModel(model.terms, model.exceptions, _logistic(x[order], y[order]))


def score(docs: DataFrame, model: ToxicityModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` of every whole text."""
    if model is None:
        return docs.select(key, F.lit(0.0).alias("score"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            for i, j, raw, off in chunks(batch, "text"):
                p = model.score(evidence(automaton, raw, off))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(p)],
                                                 names=["id", "score"])

    return (docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
            .mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", key))
