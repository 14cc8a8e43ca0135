"""Ordered-frame operators: moving average, EWMA, Gaussian filter, lag
windows and series change.

Skew-safe layout.  ``Window.partitionBy(series)`` sends a whole series to one
task, so a series holding a third of all rows would run in a single task.
Instead :func:`series_positions` numbers rows inside each series from a
range-partitioned sort (per-partition counts + prefix offsets over a tiny
count table), and :func:`with_blocks` cuts every series into blocks of
``block_rows`` rows, copying the ``before``/``after`` halo rows a stencil
needs into the neighbouring block.  Windows then run over
``partitionBy(series, block)``: every group is bounded by
``block_rows + before + after`` rows, whatever the skew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import require_columns
from tessera.functions.joins import broadcast_if_bounded
from tessera.session import cut_lineage

DEFAULT_BLOCK_ROWS = 100_000
_LOC_BITS = 33


def series_positions(df: DataFrame, series: list[str], order: list[str],
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``_rn`` (1-based position in its series by ``order``) and ``_n``
    (series length).  ``order`` must make the order total.  Rows with a NULL
    series key are dropped (pandas group-by semantics)."""
    require_columns(df, series + order)
    keep = F.lit(True)
    for s in series:
        keep = keep & F.col(s).isNotNull()
    # without an explicit count AQE sizes the range exchange from runtime statistics
    keyed = df.where(keep)
    ranged = (keyed.repartitionByRange(num_partitions, *series, *order) if num_partitions
              else keyed.repartitionByRange(*series, *order))
    ranged = (ranged.sortWithinPartitions(*series, *order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.select("*", F.shiftright("_mid", _LOC_BITS).alias("_pid"),
                           F.col("_mid").bitwiseAND((1 << _LOC_BITS) - 1).alias("_loc"))
    # Range bounds are re-sampled each time the exchange runs (the sample seed
    # follows the RDD id), so the numbered rows are checkpointed once and both
    # the counts and the join read the same copy.
    ranged = cut_lineage(ranged)
    counts = ranged.groupBy("_pid", *series).agg(F.count(F.lit(1)).alias("_c"),
                                                 F.min("_loc").alias("_first"))
    before = Window.partitionBy(*series).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", *series, "_first",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(Window.partitionBy(*series)).alias("_n"))
    joined = ranged.join(broadcast_if_bounded(offsets), on=["_pid", *series])
    return joined.select(*df.columns,
                         (F.col("_off") + F.col("_loc") - F.col("_first") + 1).alias("_rn"),
                         F.col("_n"))


def with_blocks(pos: DataFrame, before: int, after: int,
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Assign ``_blk`` (the block a copy lives in) and ``_home`` (the copy is
    the row's own).  Rows within ``before`` of a block end are copied into
    the next block, rows within ``after`` of a block start into the previous."""
    b = max(block_rows, before, after, 1)
    blk = F.floor((F.col("_rn") - 1) / b)
    within = F.col("_rn") - 1 - blk * b
    targets = F.array(blk)
    if before > 0:
        targets = F.when(within >= b - before, F.array_append(targets, blk + 1)).otherwise(targets)
    if after > 0:
        targets = F.when((within < after) & (blk > 0), F.array_append(targets, blk - 1)).otherwise(targets)
    return pos.select("*", blk.alias("_home_blk"), F.explode(targets).alias("_blk")) \
        .withColumn("_home", F.col("_blk") == F.col("_home_blk")).drop("_home_blk")


def stencil(df: DataFrame, series: list[str], order: list[str], before: int, after: int,
            compute, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Run ``compute(frame_df, window_spec)`` over bounded blocks and keep home rows.

    ``compute`` receives the blocked frame (with ``_rn``/``_n``) and the
    ordered window spec ``partitionBy(series, _blk).orderBy(_rn)`` and returns
    a DataFrame with the same rows and extra columns."""
    pos = series_positions(df, series, order)
    blocked = with_blocks(pos, before, after, block_rows)
    w = Window.partitionBy(*series, "_blk").orderBy("_rn")
    out = compute(blocked, w)
    return out.where("_home").drop("_blk", "_home")


# ------------------------------------------------------------------ operators
def moving_average(df: DataFrame, series: list[str], order: list[str], columns: list[str],
                   window: int = 5, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Trailing mean over ``window`` rows, min 1 row, nulls ignored:
    adds ``<col>_smoothed``."""
    def compute(d, w):
        frame = w.rowsBetween(-(window - 1), 0)
        return d.select("*", *[F.avg(c).over(frame).alias(f"{c}_smoothed") for c in columns])
    return stencil(df, series, order, window - 1, 0, compute, block_rows).drop("_n")


def ewm_terms(window: int, tol_digits: int = 12) -> tuple[float, int]:
    """(decay 1-alpha, rows K) of a span-``window`` EWMA: terms K rows back weigh
    under 10^-tol_digits (alpha = 2/(span+1))."""
    alpha = 2.0 / (window + 1.0)
    decay = 1.0 - alpha
    k = math.ceil(tol_digits * math.log(10) / -math.log(decay)) if decay > 0 else 1
    return decay, max(k, 1)


_EWM_DIGITS = 100     # weights inside a block span at most so many decimal digits
_EWM_EXACT = 18       # terms of smaller weight (digits) do not reach a double


def ewm_mean(df: DataFrame, series: list[str], order: list[str], columns: list[str],
             window: int = 5, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Bias-adjusted EWMA with span ``window``:
    y_t = sum_i decay^i x_{t-i} / sum_i decay^i over non-null x (i by row
    distance).  A null or NaN row repeats the last value, however long the gap.

    A scan of affine steps: inside a block, numerator and denominator are running
    sums of values scaled by ``decay^-position``; a block's pair at its end, decayed by
    the distance, is carried into the blocks after it that it still reaches
    (one, unless the span is longer than a block).  Work per row does not
    depend on the span, and no task sees more than a block of a series."""
    decay, longest = ewm_terms(window, _EWM_DIGITS)
    size = min(max(block_rows, 1), longest)
    reach = max(1, math.ceil(ewm_terms(window, _EWM_EXACT)[1] / size))
    pos = series_positions(df, series, order)
    if decay <= 0:                                            # span 1: every value is its own mean
        own = pos.select("*", *[_number(c).alias(f"{c}_smoothed") for c in columns]).drop("_n")
        return _carry_forward(own, series, [f"{c}_smoothed" for c in columns], block_rows)
    at = F.pmod(F.col("_rn") - 1, F.lit(size))
    rows = pos.withColumn("_blk", F.floor((F.col("_rn") - 1) / size)).withColumn("_up", F.pow(F.lit(1.0 / decay), at))
    down = F.pow(F.lit(decay), at)
    pairs = [(i, c, _number(c) * F.col("_up"), F.when(_number(c).isNotNull(), F.col("_up"))) for i, c in enumerate(columns)]
    last = F.lit(decay) ** F.lit(size - 1)
    ends = rows.groupBy(*series, "_blk").agg(*[x for i, _, num, den in pairs for x in (
        (F.sum(num) * last).alias(f"_en{i}"), (F.sum(den) * last).alias(f"_ed{i}"))])
    ends = ends.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    far = F.pow(F.lit(decay), (F.col("_j") - 1) * size + 1)
    ends = ends.groupBy(*series, (F.col("_blk") + F.col("_j")).alias("_blk")).agg(*[x for i, *_ in pairs for x in (
        F.sum(F.col(f"_en{i}") * far).alias(f"_cn{i}"), F.sum(F.col(f"_ed{i}") * far).alias(f"_cd{i}"))])
    run = Window.partitionBy(*series, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("*", *[x for i, _, num, den in pairs for x in (
        F.sum(num).over(run).alias(f"_rn{i}"), F.sum(den).over(run).alias(f"_rd{i}"))])
    got = sums.join(ends, [*series, "_blk"], "left")
    total = lambda kind, i: F.coalesce(F.col(f"_r{kind}{i}"), F.lit(0.0)) + F.coalesce(F.col(f"_c{kind}{i}"), F.lit(0.0))
    got = got.select(*df.columns, "_rn", *[
        F.when(_number(c).isNotNull(), (total("n", i) * down) / (total("d", i) * down)).alias(f"{c}_smoothed") for i, c, *_ in pairs])
    return _carry_forward(got, series, [f"{c}_smoothed" for c in columns], block_rows)


def _number(column: str) -> Column:
    """The value as a double; NaN counts as missing."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def _carry_forward(pos: DataFrame, series: list[str], columns: list[str], block_rows: int) -> DataFrame:
    """Fill NULLs of ``columns`` with the last non-null value of the series
    (rows numbered by ``_rn``): inside blocks by a window, across blocks by the
    blocks' last values, one row per block."""
    pos = cut_lineage(pos.withColumn("_b", F.floor((F.col("_rn") - 1) / block_rows)))
    rows = Window.partitionBy(*series, "_b").orderBy("_rn")
    last = pos.groupBy(*series, "_b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(f"_l{i}")
                                            for i, c in enumerate(columns)])
    blocks = Window.partitionBy(*series).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*series, "_b", *[F.last(f"_l{i}", ignorenulls=True).over(blocks).alias(f"_l{i}")
                                        for i in range(len(columns))])
    out = pos.select("*", *[F.last(c, ignorenulls=True).over(rows).alias(f"_f{i}") for i, c in enumerate(columns)])
    out = out.join(broadcast_if_bounded(last), [*series, "_b"])
    return out.select(*[F.coalesce(F.col(f"_f{columns.index(c)}"), F.col(f"_l{columns.index(c)}")).alias(c)
                        if c in columns else F.col(c) for c in pos.columns if c != "_b"])


def gaussian_kernel(window: int, truncate: float = 4.0) -> tuple[list[float], int]:
    """Normalised Gaussian weights with sigma = window/3 and radius
    int(truncate*sigma + 0.5)."""
    sigma = window / 3.0
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (j / sigma) ** 2) for j in range(-radius, radius + 1)]
    s = sum(w)
    return [x / s for x in w], radius


def _reflect(p: Column, n: Column) -> Column:
    """Index reflection (d c b a | a b c d | d c b a) for any offset."""
    m = F.pmod(p, n * 2)
    return F.when(m >= n, n * 2 - 1 - m).otherwise(m)


def gaussian_smooth(df: DataFrame, series: list[str], order: list[str], columns: list[str],
                    window: int = 5, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """1-D Gaussian filter (sigma = window/3, reflected edges); NULL where the
    window holds a NULL."""
    weights, r = gaussian_kernel(window)

    def compute(d, w):
        frame = w.rowsBetween(-r, r)
        out = []
        for c in columns:
            vals = F.collect_list(F.struct(F.col(c).cast("double").alias("x"))).over(frame)   # keeps nulls in place
            first = F.greatest(F.col("_rn") - r, F.lit(1))
            terms = []
            for j, wt in zip(range(-r, r + 1), weights):
                q = _reflect(F.col("_rn") - 1 + j, F.col("_n"))      # 0-based position
                terms.append(F.lit(wt) * F.element_at(vals, (q + 2 - first).cast("int"))["x"])
            out.append(sum(terms[1:], terms[0]).alias(f"{c}_smoothed"))
        return d.select("*", *out)

    return stencil(df, series, order, r, r, compute, block_rows).drop("_n")


def lag_windows(df: DataFrame, series: list[str], order: list[str], column: str, length: int,
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Samples ``(series..., position, history[length], target)``: the ``length``
    previous values and the current one; samples with a NULL are dropped."""
    def compute(d, w):
        frame = w.rowsBetween(-length, -1)
        hist = F.collect_list(F.col(column).cast("double")).over(frame)
        cnt = F.count(F.lit(1)).over(frame)
        return d.select("*", hist.alias("history"), cnt.alias("_cnt"))

    out = stencil(df, series, order, length, 0, compute, block_rows)
    return (out.where((F.col("_cnt") == length) & (F.size("history") == length)
                      & F.col(column).isNotNull())
            .select(*series, F.col("_rn").alias("position"), "history",
                    F.col(column).cast("double").alias("target")))


def series_change(df: DataFrame, series: list[str], time_col: str, value: str) -> DataFrame:
    """First / last value by time, delta and percent change per series
    (partial-aggregatable ``min_by`` / ``max_by``: no per-series task)."""
    g = df.where(F.col(value).isNotNull()).groupBy(*series).agg(
        F.min_by(value, time_col).alias("first_value"), F.max_by(value, time_col).alias("last_value"))
    return g.select(*series, "first_value", "last_value",
                    (F.col("last_value") - F.col("first_value")).alias("delta"),
                    (F.try_divide(F.col("last_value") - F.col("first_value"), F.col("first_value"))
                     * 100).alias("pct_change"))


def series_prefix_sum(df: DataFrame, series: list[str], order: list[str], value: Column,
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``_cum``: the running (inclusive) sum of ``value`` inside each
    series by ``order``.  Range-partitioned like :func:`series_positions`:
    partial sums per (partition, series) get prefix offsets from a tiny
    table, and the local running sum is a window over one partition's slice
    of a series, so no series is ever a single task."""
    keep = F.lit(True)
    for s in series:
        keep = keep & F.col(s).isNotNull()
    keyed = df.where(keep).withColumn("_v", value)
    ranged = (keyed.repartitionByRange(num_partitions, *series, *order) if num_partitions
              else keyed.repartitionByRange(*series, *order))
    ranged = ranged.withColumn("_pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sums = ranged.groupBy("_pid", *series).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*series).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", *series, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_pid", *series).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(broadcast_if_bounded(offsets), on=["_pid", *series])
    return joined.select(*df.columns, (F.col("_off") + F.sum("_v").over(local)).alias("_cum"))


def _loess_fit(rows: Column, rn: Column, n: Column, k: int, x0: Column) -> Column:
    """Local linear fit at ``x0``, the row of position ``rn`` (1-based): the
    window of ``k`` consecutive rows nearest to it (the leftmost on ties),
    tricube distance weights times robustness weights.  ``rows``: structs
    ``(x, y, w)`` of the frame rows ``rn - k .. rn + k``."""
    first = F.greatest(rn - k, F.lit(1))

    def at(j):
        return F.get(rows, (j - first).cast("int"))           # NULL outside the frame

    starts = F.sequence(F.greatest(rn - k + 1, F.lit(1)), rn)
    left = F.element_at(F.filter(starts, lambda j: (j + k > n) | (x0 <= (at(j)["x"] + at(j + k)["x"]) / 2)), 1)
    right = F.least(left + k - 1, n)
    radius = F.greatest(x0 - at(left)["x"], at(right)["x"] - x0)

    def w_at(r):
        d = F.abs(r["x"] - x0)
        tri = F.when(d < radius, F.pow(1 - F.pow(d / radius, 3), 3)).otherwise(F.lit(0.0))
        return tri * r["w"]

    terms = F.transform(F.slice(rows, (left - first + 1).cast("int"), (right - left + 1).cast("int")),
                        lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), w_at(r).alias("w")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("sw", "sx", "sy", "sxx", "sxy")])
    acc = F.aggregate(terms, zero, lambda a, t: F.struct(
        (a["sw"] + t["w"]).alias("sw"), (a["sx"] + t["w"] * t["x"]).alias("sx"),
        (a["sy"] + t["w"] * t["y"]).alias("sy"), (a["sxx"] + t["w"] * t["x"] * t["x"]).alias("sxx"),
        (a["sxy"] + t["w"] * t["x"] * t["y"]).alias("sxy")))
    return F.struct(acc.alias("s"), at(rn)["y"].alias("own"))


def _loess_finish(st: Column, x0: Column) -> Column:
    """Fitted value from the weighted sums struct of :func:`_loess_fit` (kept
    in its own column so the window arrays are walked once per row)."""
    sw, sx, sy, sxx, sxy = (st["s"][c] for c in ("sw", "sx", "sy", "sxx", "sxy"))
    xbar = sx / sw
    var = sxx / sw - xbar * xbar
    slope = F.when(var > 1e-12, (sxy / sw - xbar * (sy / sw)) / var).otherwise(F.lit(0.0))
    fit = sy / sw + slope * (x0 - xbar)
    return F.when(sw > 0, fit).otherwise(st["own"])


def loess(df: DataFrame, series: list[str], order: list[str], column: str, window: int = 5,
          iterations: int = 3, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """LOWESS of ``column`` against its position (frac = window / n, i.e. the
    ``window`` nearest positions), ``iterations`` bisquare robustness passes
    with the per-series median absolute residual.  Adds
    ``<column>_smoothed``.  Rows whose value is NULL are dropped; the others
    keep their position in the whole series."""
    k = max(int(window), 2)
    known = F.col(column).isNotNull()
    if df.where(~known).isEmpty():
        pos = series_positions(df, series, order).withColumn("_x", F.col("_rn").cast("double"))
    else:
        placed = series_positions(df, series, order).withColumn("_x", F.col("_rn").cast("double")).drop("_rn", "_n")
        pos = series_positions(placed.where(known), series, ["_x"])
    pos = cut_lineage(pos.withColumn("_rw", F.lit(1.0)))
    fitted = None
    for it in range(iterations + 1):
        blocked = with_blocks(pos, k, k, block_rows)
        w = Window.partitionBy(*series, "_blk").orderBy("_rn").rowsBetween(-k, k)
        rows = F.collect_list(F.struct(F.col("_x").alias("x"), F.col(column).cast("double").alias("y"),
                                       F.col("_rw").alias("w"))).over(w)
        fitted = blocked.select("*", rows.alias("_frame")).where("_home").drop("_blk", "_home")
        fitted = fitted.withColumn("_st", _loess_fit(F.col("_frame"), F.col("_rn"), F.col("_n"), k, F.col("_x")))
        fitted = fitted.withColumn("_fit", _loess_finish(F.col("_st"), F.col("_x"))).drop("_st", "_frame")
        fitted = cut_lineage(fitted)
        if it == iterations:
            break
        res = fitted.select(*series, F.col("_rn").alias("_pos"),
                            F.abs(F.col(column) - F.col("_fit")).alias("_ares"))
        ranked = series_positions(res, series, ["_ares", "_pos"]).withColumnRenamed("_rn", "_rk")
        # median of |residual| per series: mean of the middle one or two ranks
        mid = ranked.where((F.col("_rk") == F.floor((F.col("_n") + 1) / 2))
                           | (F.col("_rk") == F.ceil((F.col("_n") + 1) / 2)))
        med = mid.groupBy(*series).agg(F.avg("_ares").alias("_med"))
        u = F.col("_res") / (6.0 * F.col("_med"))
        pos = cut_lineage(
            fitted.join(broadcast_if_bounded(med), series)
            .withColumn("_res", F.col(column) - F.col("_fit"))
            .withColumn("_rw", F.when(F.col("_med") <= 0, F.when(F.col("_res") == 0, 1.0).otherwise(0.0))
                        .when(F.abs(u) < 1, F.pow(1 - u * u, 2)).otherwise(0.0))
            .drop("_fit", "_res", "_med"))
    return fitted.select(*df.columns, F.col("_fit").alias(f"{column}_smoothed"))
