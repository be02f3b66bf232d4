"""Depth profiles and water columns.

Sampled profiles may be long, so their segments come from bucketed neighbours and plain sums. Model columns have
a fixed number of levels: after averaging per (column, level) a column is one short array, and every reduction
is an expression on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import with_next

BUCKET_M = 50.0
G_N_PER_MMOL = 14.0067 / 1000.0


def _segments(df: DataFrame, keys: Sequence[str], depth: str, conc: str) -> DataFrame:
    """Depth-averaged samples with their lower neighbour: (keys, z, c, next_z, next_c)."""
    d = df.where(F.col(depth).isNotNull() & F.col(conc).isNotNull())
    d = d.groupBy(*keys, F.col(depth).cast("double").alias("z")).agg(F.avg(conc).alias("c"))
    return with_next(d, keys, "z", ["z", "c"], F.floor(F.col("z") / BUCKET_M))


def _clipped_area(zmin: float, zmax: float) -> Column:
    """Trapezoid of one segment inside [zmin, zmax]; NULL when it does not reach inside."""
    z, c, nz, nc = F.col("z"), F.col("c"), F.col("next_z"), F.col("next_c")
    lo, hi = F.greatest(z, F.lit(float(zmin))), F.least(nz, F.lit(float(zmax)))
    slope = F.try_divide(nc - c, nz - z)
    return F.when(hi > lo, (hi - lo) * ((c + slope * (lo - z)) + (c + slope * (hi - z))) / 2)


def profile_integral(df: DataFrame, keys: Sequence[str], depth: str, conc: str, *, zmin: float, zmax: float, pad_surface: float,
                     pad_deep: float, full_coverage: bool = False, allow_single: bool = True, extrapolate: bool = False) -> DataFrame:
    """Integral over [zmin, zmax] per profile with constant end pads, and the coverage flags.

    A gap at an end within the pad tolerance is padded with the nearest value; a larger gap rejects the profile
    unless ``extrapolate``. A single depth stands for the whole range when allowed.
    """
    s = _segments(df, keys, depth, conc)
    p = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_depths"), F.min("z").alias("min_depth"), F.max("z").alias("max_depth"),
        F.min_by("c", "z").alias("__c1"), F.max_by("c", "z").alias("__cn"),
        F.coalesce(F.sum(_clipped_area(zmin, zmax)), F.lit(0.0)).alias("__area"))
    top = F.greatest(F.lit(0.0), F.col("min_depth") - zmin)
    low = F.greatest(F.lit(0.0), F.lit(float(zmax)) - F.col("max_depth"))
    single = F.col("n_depths") == 1
    p = p.withColumns({
        "pad_surface": single | ((top > 0) & (top <= pad_surface)),
        "pad_deep": single | ((low > 0) & (low <= pad_deep)),
        "extrap_surface": single | (top > pad_surface),
        "extrap_deep": single | (low > pad_deep),
    })
    ends = F.col("__c1") * F.greatest(F.lit(0.0), F.least(F.col("min_depth"), F.lit(float(zmax))) - zmin) + F.col("__cn") * F.greatest(
        F.lit(0.0), F.lit(float(zmax)) - F.greatest(F.col("max_depth"), F.lit(float(zmin))))
    covered = (top <= pad_surface) & (low <= pad_deep)
    ok = F.lit(True)
    if full_coverage:
        ok = ok & covered
    if not allow_single:
        ok = ok & ~single
    if not extrapolate:
        ok = ok & (single | covered)
    p = p.where(ok).withColumn("integral", F.when(single, F.col("__c1") * (zmax - zmin)).otherwise(F.col("__area") + ends))
    return p.withColumn("average", F.col("integral") / (zmax - zmin)).drop("__c1", "__cn", "__area")


def profile_integral_sampled(df: DataFrame, keys: Sequence[str], depth: str, conc: str, *, zmin: float, zmax: float,
                             factor: float = 0.014) -> DataFrame:
    """Integral over the sampled part of [zmin, zmax] only, times a unit factor; needs two depths."""
    d = df.withColumn(depth, F.greatest(F.col(depth), F.lit(0.0)))
    s = _segments(d, keys, depth, conc)
    return s.groupBy(*keys).agg((F.sum(_clipped_area(zmin, zmax)) * factor).alias("integral"))


def casts(df: DataFrame, keys: Sequence[str], depth: str, conc: str, *, min_depths: int | None = None,
          min_max_depth: float | None = None, **integral_args) -> DataFrame:
    """One integrated value per cast, with minimum sampling requirements."""
    c = profile_integral(df, keys, depth, conc, **integral_args)
    if min_depths is not None:
        c = c.where(F.col("n_depths") >= min_depths)
    if min_max_depth is not None:
        c = c.where(F.col("max_depth") >= min_max_depth)
    return c


def at_levels(df: DataFrame, keys: Sequence[str], depth: str, value: str, levels: Sequence[float], max_depth: float | None = None,
              sentinels: Sequence[float] = (-999.0, -999.9)) -> DataFrame:
    """Profile values at fixed levels, linear between samples and never beyond them."""
    d = df.where(~F.col(value).isin(list(sentinels)))
    if max_depth is not None:
        d = d.where(F.col(depth) <= max_depth)
    s = _segments(d, keys, depth, value)
    arr = F.array(*[F.lit(float(v)) for v in levels])
    inside = F.filter(arr, lambda v: ((v >= F.col("z")) & (v < F.col("next_z"))) | (v == F.col("z")))
    s = s.withColumn("level", F.explode(inside))
    step = F.try_divide(F.col("level") - F.col("z"), F.col("next_z") - F.col("z"))
    return s.select(*keys, "level", F.when(F.col("level") == F.col("z"), F.col("c")).otherwise(
        F.col("c") + step * (F.col("next_c") - F.col("c"))).alias("value"))


def columns(df: DataFrame, keys: Sequence[str], *, level: str, depth: str, thickness: str, value: str) -> DataFrame:
    """One row per column with ``col_levels``: levels in order as (level, z, e, v); zero and NULL values are not water."""
    d = df.groupBy(*keys, F.col(level).alias("level")).agg(
        F.avg(depth).alias("z"), F.avg(thickness).alias("e"), F.avg(F.when(F.col(value) != 0, F.col(value))).alias("v"))
    d = d.where("v IS NOT NULL")
    return d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("level", "z", "e", "v"))).alias("col_levels"))


def _lerp(a: Column, b: Column, z: Column) -> Column:
    return a.v + F.try_divide(z - a.z, b.z - a.z) * (b.v - a.v)


def _value_at(arr: Column, z: Column) -> Column:
    """Linear through the two levels around z; the end segments are extended outwards."""
    below = F.size(F.filter(arr, lambda x: x.z <= z))
    i = F.greatest(F.lit(0), F.least(below - 1, F.size(arr) - 2))
    return _lerp(F.get(arr, i), F.get(arr, i + 1), z)


def _weighted(arr: Column) -> Column:
    use = F.filter(arr, lambda x: x.e != 0)
    acc = F.aggregate(use, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
                      lambda a, x: F.struct((a.s + x.v * x.e).alias("s"), (a.w + x.e).alias("w")))
    return F.try_divide(acc.s, acc.w)


def value_at(z: float) -> Callable[[Column], Column]:
    """Interpolated value at one depth; NULL above the first or below the last level."""
    def fn(arr: Column) -> Column:
        first, last = F.get(arr, F.lit(0)), F.get(arr, F.size(arr) - 1)
        return F.when((F.size(arr) >= 2) & (last.z >= z) & (first.z <= z), _value_at(arr, F.lit(float(z))))
    return fn


def _grid_mean(arr: Column, start: float, n: Column, dz: float) -> Column:
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, k: a + _value_at(arr, F.lit(float(start)) + k * dz))
    return total / n


def mean_between(z1: float, z2: float, dz: float = 1.0) -> Callable[[Column], Column]:
    """Mean of values interpolated on a regular grid from z1 to z2; columns shallower than z2 give NULL."""
    n = int(round((z2 - z1) / dz)) + 1

    def fn(arr: Column) -> Column:
        last = F.get(arr, F.size(arr) - 1)
        return F.when((F.size(arr) >= 2) & (last.z >= z2), _grid_mean(arr, z1, F.lit(n), dz))
    return fn


def mean_below(z1: float, dz: float = 1.0) -> Callable[[Column], Column]:
    """Mean from z1 to the column's own bottom."""
    def fn(arr: Column) -> Column:
        last = F.get(arr, F.size(arr) - 1)
        n = F.ceil((last.z + dz - z1) / dz).cast("int")
        return F.when((F.size(arr) >= 2) & (last.z >= z1), _grid_mean(arr, z1, F.greatest(n, F.lit(1)), dz))
    return fn


def weighted_mean(level_range: tuple[int, int] | None = None, depth_range: tuple[float, float] | None = None) -> Callable[[Column], Column]:
    """Thickness-weighted mean over the column, a level range (end exclusive) or a range of level depths."""
    def fn(arr: Column) -> Column:
        use = arr
        if level_range:
            use = F.filter(use, lambda x: (x.level >= level_range[0]) & (x.level < level_range[1]))
        if depth_range:
            use = F.filter(use, lambda x: (x.z >= depth_range[0]) & (x.z <= depth_range[1]))
        return _weighted(use)
    return fn


def plain_mean(level_range: tuple[int, int]) -> Callable[[Column], Column]:
    """Unweighted mean of a level range (end exclusive); one level when the range holds one."""
    def fn(arr: Column) -> Column:
        use = F.filter(arr, lambda x: (x.level >= level_range[0]) & (x.level < level_range[1]))
        total = F.aggregate(use, F.lit(0.0), lambda a, x: a + x.v)
        return F.try_divide(total, F.size(use))
    return fn


def bottom_value() -> Callable[[Column], Column]:
    return lambda arr: F.get(arr, F.size(arr) - 1).v


def _cumulative(arr: Column) -> Column:
    """Running thickness from the front of the array, before and through each level."""
    start = F.array().cast("array<struct<b:double,t:double>>")
    return F.aggregate(arr, start, lambda acc, x: F.concat(acc, F.array(F.struct(
        F.coalesce(F.get(acc, F.size(acc) - 1).t, F.lit(0.0)).alias("b"),
        (F.coalesce(F.get(acc, F.size(acc) - 1).t, F.lit(0.0)) + x.e).alias("t")))))


def last_metres(n: float) -> Callable[[Column], Column]:
    """Weighted mean over the lowest levels whose thickness first reaches n metres; columns thinner than that
    use their bottom level only."""
    def fn(arr: Column) -> Column:
        up = F.reverse(arr)
        cum = _cumulative(up)
        reach = F.get(cum, F.size(cum) - 1).t >= n
        keep = F.filter(up, lambda x, i: F.get(cum, i).b < n)
        return F.when(F.size(arr) > 0, F.when(reach, _weighted(keep)).otherwise(_weighted(F.slice(up, 1, 1))))
    return fn


def below_top(n: float) -> Callable[[Column], Column]:
    """Weighted mean from the level where thickness summed from the surface first reaches n down to the bottom."""
    def fn(arr: Column) -> Column:
        cum = _cumulative(arr)
        reach = F.size(F.filter(F.slice(cum, 1, F.greatest(F.size(cum) - 1, F.lit(0))), lambda x: x.t >= n)) > 0
        keep = F.filter(arr, lambda x, i: F.get(cum, i).t >= n)
        return F.when(F.size(arr) > 0, F.when(reach, _weighted(keep)).otherwise(_weighted(arr)))
    return fn


def reduce_columns(cols: DataFrame, reductions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Apply named reductions to every column in one projection."""
    return cols.withColumns({name: fn(F.col("col_levels")) for name, fn in reductions.items()}).drop("col_levels")
