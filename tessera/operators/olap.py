"""Star-schema split, data cubes, drill-down / roll-up and batched export.

All cubes of a fact table are computed in ONE scan: a GROUPING SETS
aggregate (Expand + partial HashAggregate + one Exchange) instead of one
group-by per dimension combination.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import exact_sum, require_columns
from tessera.functions.joins import broadcast_if_bounded

CUBE_SEP = " × "


@dataclass(frozen=True)
class Dimension:
    """A dimension of a star schema: its columns, primary key and hierarchy
    (coarse to fine).  Hierarchy and key must be among the columns."""

    name: str
    columns: tuple[str, ...]
    primary_key: str
    hierarchy: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.primary_key not in self.columns:
            raise ValueError(f"primary key {self.primary_key!r} not among {self.columns}")
        bad = [h for h in self.hierarchy if h not in self.columns]
        if bad:
            raise ValueError(f"hierarchy levels {bad} not among {self.columns}")


def _check_measures(df: DataFrame, measures: list[str]) -> None:
    require_columns(df, measures)
    types = dict(df.dtypes)
    bad = [m for m in measures if types[m] in ("string", "boolean", "binary")]
    if bad:
        raise ValueError(f"measures must be numeric: {bad}")


def _check_disjoint(dimensions: list[Dimension]) -> None:
    seen: dict[str, str] = {}
    for d in dimensions:
        for c in d.columns:
            if c in seen:
                raise ValueError(f"column {c!r} is in dimensions {seen[c]!r} and {d.name!r}")
            seen[c] = d.name


def star_fact(df: DataFrame, measures: list[str], dimensions: list[Dimension]) -> DataFrame:
    """Fact table = measures + each dimension's primary key (a projection)."""
    _check_disjoint(dimensions)
    _check_measures(df, measures)
    keys = [d.primary_key for d in dimensions]
    require_columns(df, keys)
    return df.select(*measures, *keys)


def star_dimension(df: DataFrame, dimension: Dimension) -> DataFrame:
    """Dimension table = distinct rows of the dimension's columns."""
    require_columns(df, dimension.columns)
    return df.select(*dimension.columns).distinct()


def data_cube(fact: DataFrame, dims: list[str], measures: list[str],
              money_scale: int | None = None) -> DataFrame:
    """One cube: SUM of every measure grouped by ``dims``; null keys dropped."""
    require_columns(fact, dims)
    _check_measures(fact, measures)
    keep = F.lit(True)
    for d in dims:
        keep = keep & F.col(d).isNotNull()
    return (fact.where(keep).groupBy(*dims)
            .agg(*[exact_sum(m, money_scale).alias(m) for m in measures]))


def cube_name(dims: tuple[str, ...] | list[str]) -> str:
    return CUBE_SEP.join(dims)


def all_cube_sets(dims: list[str]) -> list[tuple[str, ...]]:
    """Every non-empty combination of the dimensions (2^n - 1, no grand total),
    in size order then column order."""
    return [c for k in range(1, len(dims) + 1) for c in combinations(dims, k)]


def data_cubes(fact: DataFrame, dims: list[str], measures: list[str],
               money_scale: int | None = None) -> DataFrame:
    """All cubes in one long table ``(cube, cube_no, dims..., measures...)``.

    A dimension not in a cube is NULL in that cube's rows.  Rows whose key is
    NULL in one of the cube's own dimensions are dropped from that cube (pandas
    group-by drops null keys).  Empty cubes simply have no rows.
    """
    require_columns(fact, dims)
    _check_measures(fact, measures)
    sets = all_cube_sets(dims)
    n = len(dims)
    # grouping_id bit i (from the left, MSB first) is 1 when dims[i] is aggregated away.
    gid_to = {}
    for no, s in enumerate(sets, start=1):
        gid = sum(1 << (n - 1 - i) for i, d in enumerate(dims) if d not in s)
        gid_to[gid] = (no, cube_name(s))
    grouped = fact.groupingSets([list(s) for s in sets], *dims).agg(
        *[exact_sum(m, money_scale).alias(m) for m in measures],
        F.grouping_id().alias("_gid"))
    name_expr: Column = F.lit(None).cast("string")
    no_expr: Column = F.lit(None).cast("int")
    for gid, (no, name) in sorted(gid_to.items()):
        name_expr = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(name_expr)
        no_expr = F.when(F.col("_gid") == gid, F.lit(no)).otherwise(no_expr)
    # a row belongs to its cube only if all of the cube's own keys are non-null
    valid = F.lit(True)
    for i, d in enumerate(dims):
        active = (F.col("_gid").bitwiseAND(1 << (n - 1 - i)) == 0)
        valid = valid & ~(active & F.col(d).isNull())
    return (grouped.where(valid)
            .select(name_expr.alias("cube"), no_expr.alias("cube_no"), *dims, *measures))


def merge_cubes(cubes: DataFrame, dims: list[str], measures: list[str], money_scale: int | None = None) -> DataFrame:
    """One table of cubes from the cubes of disjoint parts of the facts."""
    return cubes.groupBy("cube", "cube_no", *dims).agg(*[exact_sum(m, money_scale).alias(m) for m in measures])


def cube_batches(cubes: DataFrame, batch_size: int) -> DataFrame:
    """Assign cubes to export batches of ``batch_size`` cubes:
    ``batch = floor((cube_no - 1) / batch_size) + 1`` and file name ``cube_a_b``."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    return cubes.select(
        (F.floor((F.col("cube_no") - 1) / batch_size) + 1).cast("int").alias("batch"),
        F.concat(F.lit("cube_"), F.regexp_replace(F.col("cube"), CUBE_SEP, "_")).alias("cube_file"),
        *[c for c in cubes.columns])


def write_cube_batches(batched: DataFrame, path: str, fmt: str = "csv") -> None:
    """Sink: one directory per batch and cube (``batch=b/cube_file=cube_a_b``)."""
    (batched.write.mode("overwrite").partitionBy("batch", "cube_file")
     .option("header", True).format(fmt).save(path))


def olap_levels(fact: DataFrame, dimension_table: DataFrame, key: str,
                hierarchy: list[str], level: int, measures: list[str],
                money_scale: int | None = None,
                fact_key: str | None = None, unique_key: bool = True) -> DataFrame:
    """Drill-down / roll-up: join the fact to its dimension (LEFT, on the key) and
    group by ``hierarchy[:level + 1]``.  Null hierarchy values are dropped.

    ``unique_key`` checks that the dimension has one row per key (a duplicated
    key would fan facts out); the dimension is broadcast only under a checked
    row bound, otherwise the join shuffles."""
    if not 0 <= level < len(hierarchy):
        raise ValueError(f"level must be in [0, {len(hierarchy) - 1}]")
    fact_key = fact_key or key
    dim = dimension_table.select(key, *[h for h in hierarchy if h != key]).distinct()
    if unique_key:
        dup = dim.groupBy(key).count().where("count > 1").limit(1).count()
        if dup:
            raise ValueError(f"dimension key {key!r} is not unique")
    joined = fact.join(broadcast_if_bounded(dim), fact[fact_key] == dim[key], "left")
    cols = hierarchy[: level + 1]
    return data_cube(joined, cols, measures, money_scale)


def olap_all_levels(fact: DataFrame, hierarchy: list[str], measures: list[str],
                    money_scale: int | None = None) -> DataFrame:
    """Every drill level in one pass: ROLLUP minus the grand total, long form
    with a ``level`` column (1 = coarsest)."""
    grouped = fact.rollup(*hierarchy).agg(
        *[exact_sum(m, money_scale).alias(m) for m in measures],
        F.grouping_id().alias("_gid"))
    n = len(hierarchy)
    level = F.lit(n) - F.expr(f"bit_count(_gid)").cast("int")
    ok = F.lit(True)
    for i, h in enumerate(hierarchy):
        active = F.col("_gid").bitwiseAND(1 << (n - 1 - i)) == 0
        ok = ok & ~(active & F.col(h).isNull())
    return (grouped.where((F.col("_gid") != (1 << n) - 1) & ok)
            .select(level.alias("level"), *hierarchy, *measures))
