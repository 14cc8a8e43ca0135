"""Exact and approximate quantiles of columns, with pandas' linear
interpolation (``h = (n - 1) * p``, value = x[floor h] + frac * (x[ceil h] - x[floor h])).

Spark's exact ``percentile`` merges a value->count map of the whole column in
one task; at scale that is an unbounded group in one task.  ``quantiles_of``
instead narrows one value band around each wanted rank, for all columns and
probabilities in the same scans: one aggregate sketches every column
(``percentile_approx``), one counts every band, and when the bands are small one
scan reads what they hold back, bounded by ``max_band`` rows a band.  Bands
that are still too full (beyond about 10^7 rows a column) are sketched again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 10_000
DEFAULT_MAX_BAND = 5_000


def _number(col: str):
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


class _Band:
    """The open value band ``(a, b)`` of a column that holds the wanted ranks;
    ``below`` values lie under it and ``size`` in it."""

    def __init__(self, col: str, ranks: set[int], n: int, accuracy: int):
        self.col, self.todo, self.found = col, sorted(ranks), {}
        self.a, self.b, self.below, self.size, self.margin = None, None, 0, n, 2.0 / accuracy

    def inside(self):
        """The value where it lies in the band, else null."""
        x = _number(self.col)
        return x if self.a is None else F.when((x > self.a) & (x < self.b), x)

    def fractions(self) -> list[float]:
        return [max(0.0, (self.todo[0] - self.below) / self.size - self.margin),
                min(1.0, (self.todo[-1] - self.below + 1) / self.size + self.margin)]

    def counts(self, a: float, b: float) -> list:
        x = self.inside()
        return [F.count_if(x < a), F.count_if(x == a), F.count_if((x > a) & (x < b)), F.count_if((x == b) & (x > a))]

    def narrow(self, a: float, b: float, lt: int, at_a: int, mid: int, at_b: int) -> None:
        """A rank on one of the ends is answered and both leave the band, so heavy
        ties make progress like any other values."""
        low = self.below + lt
        inner, upper = low + at_a, low + at_a + mid
        if self.todo[0] < low or self.todo[-1] >= upper + at_b:
            self.margin *= 4.0                                # the sketch missed: widen and retry
            return
        self.found.update({r: a if r < inner else b for r in self.todo if r < inner or r >= upper})
        self.todo = [r for r in self.todo if r not in self.found]
        self.a, self.b, self.below, self.size = a, b, inner, mid


def quantiles_of(df: DataFrame, wanted: dict[str, list[float]], approx: bool = False, accuracy: int = DEFAULT_ACCURACY,
                 max_band: int = DEFAULT_MAX_BAND) -> dict[str, list[float | None]]:
    """Quantiles of several columns (nulls and NaN ignored; ``None`` for a column
    without values), all in the same few scans."""
    wanted = {c: list(p) for c, p in wanted.items()}
    cols = [c for c in wanted if wanted[c]]
    if not cols:
        return {c: [] for c in wanted}
    if approx:
        row = df.agg(*[F.percentile_approx(_number(c), wanted[c], accuracy) for c in cols]).first()
        got = dict(zip(cols, row))
        return {c: (list(got[c]) if got.get(c) is not None else [None] * len(p)) for c, p in wanted.items()}
    # first scan: counts, and a sketch around every probability
    around = lambda p: [max(0.0, p - 2.0 / accuracy), min(1.0, p + 2.0 / accuracy)]
    row = df.agg(*[F.count(_number(c)) for c in cols],
                 *[F.percentile_approx(_number(c), [f for p in wanted[c] for f in around(p)], accuracy) for c in cols]).first()
    count, sketch = dict(zip(cols, row[:len(cols)])), dict(zip(cols, row[len(cols):]))
    bands: dict[tuple[str, int], _Band] = {}
    ends: dict[tuple[str, int], tuple[float, float]] = {}
    for c in cols:
        for i, p in enumerate(wanted[c]):
            if count[c]:
                h = (count[c] - 1) * p
                bands[c, i] = _Band(c, {math.floor(h), math.ceil(h)}, count[c], accuracy)
                ends[c, i] = tuple(sketch[c][2 * i:2 * i + 2])
    open_bands = dict(bands)
    while open_bands:
        wide = {k: b for k, b in open_bands.items() if b.size > max_band}
        if not wide:                                          # last scan: the values of every band
            keys = list(open_bands)
            whole = {c: k for k in keys if open_bands[k].a is None for c in [open_bands[k].col]}
            held = [F.struct(F.lit(j).alias("j"), open_bands[k].inside().alias("x")) for j, k in enumerate(keys)
                    if open_bands[k].a is not None or whole[open_bands[k].col] == k]
            rows = df.select(F.explode(F.array(*held)).alias("r")).where("r.x is not null").select("r.j", "r.x").toArrow()
            j, x = rows["j"].to_numpy(), rows["x"].to_numpy()
            for n, k in enumerate(keys):
                b = open_bands[k]
                own = n if b.a is not None else keys.index(whole[b.col])
                values = np.sort(x[j == own])
                b.found.update({r: float(values[r - b.below]) for r in b.todo})
            break
        asked = {k: ends.pop(k) for k in wide if k in ends}
        again = [k for k in wide if k not in asked]
        if again:                                             # a further sketch, inside the bands
            row = df.agg(*[F.percentile_approx(wide[k].inside(), wide[k].fractions(), accuracy) for k in again]).first()
            asked.update({k: tuple(v) for k, v in zip(again, row)})
        row = df.agg(*[x for k, (a, b) in asked.items() for x in wide[k].counts(a, b)]).first()
        for n, (k, (a, b)) in enumerate(asked.items()):
            wide[k].narrow(a, b, *row[4 * n:4 * n + 4])
        open_bands = {k: b for k, b in open_bands.items() if b.todo}
    out: dict[str, list[float | None]] = {}
    for c, probs in wanted.items():
        out[c] = []
        for i, p in enumerate(probs):
            if (c, i) not in bands:
                out[c].append(None)
                continue
            h = (count[c] - 1) * p
            v0, v1 = (bands[c, i].found[r] for r in (math.floor(h), math.ceil(h)))
            out[c].append(v0 if v0 == v1 else v0 + (h - math.floor(h)) * (v1 - v0))
    return out


def quantiles(df: DataFrame, col: str, probs: list[float], approx: bool = False,
              accuracy: int = DEFAULT_ACCURACY, max_band: int = DEFAULT_MAX_BAND) -> list[float | None]:
    """Quantiles of ``col`` (nulls/NaN ignored); ``None`` for an empty column."""
    return quantiles_of(df, {col: list(probs)}, approx, accuracy, max_band)[col]


def median(df: DataFrame, col: str, approx: bool = False) -> float | None:
    return quantiles(df, col, [0.5], approx=approx)[0]


def medians(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles_of(df, {c: [0.5] for c in cols}, approx=approx).items()}
