"""A closed nitrogen budget: bound nitrogen from biomass, free nitrogen as the remainder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import row_sum
from .joins import attach_one, null_safe_join
from .quantiles import grouped_medians

C_TO_N_LIVING = 0.176
REDFIELD_C_TO_N = 106.0 / 16.0
MMOL_TO_G_N = 14.0 / 1000.0
# Flux multipliers of the default scenario, by month and by season.
MONTHLY_FLUX = {1: 1.37, 2: 1.36, 3: 1.28, 4: 1.0, 5: 0.65, 6: 0.55, 7: 0.53, 8: 0.47, 9: 0.75, 10: 0.95, 11: 1.4, 12: 1.55}
SEASONAL_FLUX = {"Winter": 1.0, "Spring": 0.8, "Summer": 0.6, "Fall": 0.9}
#: The default scenario as one table: factor by (kind, key). Kinds without rows have the factor 1.
FLUX = {("monthly", str(k)): f for k, f in MONTHLY_FLUX.items()} | {("seasonal", k): f for k, f in SEASONAL_FLUX.items()}


def areal_inventory(conc: Column, thickness: float) -> Column:
    """umol/L over a layer to g N per square metre."""
    return conc * thickness * MMOL_TO_G_N


def bound_nitrogen(groups: Sequence[str], c_to_n: Mapping[str, float] | None = None, default: float = C_TO_N_LIVING) -> Column:
    """Sum over groups of non-negative biomass times its N:C factor; NULL when every group is missing."""
    f = c_to_n or {}
    return row_sum([F.when(F.col(g).isNotNull(), F.greatest(F.col(g), F.lit(0.0)) * f.get(g, default)) for g in groups], min_count=1)


def convert_by_group(df: DataFrame, factors: DataFrame, group: str, value: str, default: float, out: str) -> DataFrame:
    """Unit conversion by a factor table with a default for unlisted groups."""
    j = df.join(factors, group, "left")
    return j.withColumn(out, F.col(value) * F.coalesce(F.col("factor"), F.lit(float(default)))).drop("factor")


def apply_multiplier(series: DataFrame, table: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Multiply by a looked-up factor; missing factors count as 1."""
    j = series.join(table, list(keys), "left").withColumn("mult", F.coalesce("mult", F.lit(1.0)))
    return j.withColumn(out, F.col(value) * F.col("mult"))


def flux_multiplier(kind: Column | str, key: Column, table: Mapping[tuple[str, str], float] = FLUX) -> Column:
    """Factor of a (kind, key) in ``table``, 1 where it has none. ``kind`` may differ from row to row.

    Factors that come as a table of steps are joined by ``apply_multiplier`` instead.
    """
    pairs = F.create_map(*[F.lit(x) for (k, v), f in table.items() for x in (f"{k} {v}", float(f))])
    return F.coalesce(F.try_element_at(pairs, F.concat_ws(" ", F.lit(kind) if isinstance(kind, str) else kind, key.cast("string"))), F.lit(1.0))


def first_step_bound(df: DataFrame, time: str, bound: str, cell: Sequence[str] | None = None) -> DataFrame:
    """Mean bound nitrogen at the start: the first record of every cell, or all rows at the earliest time."""
    if cell:
        return df.groupBy(*cell).agg(F.min_by(bound, time).alias("__b")).agg(F.avg("__b").alias("bound_init"))
    return df.groupBy(time).agg(F.avg(bound).alias("__b")).agg(F.min_by("__b", time).alias("bound_init"))


def close_budget(df: DataFrame, bound: str, anchors: DataFrame, *, free_init: float, total_ref: float, free_mode: str = "config",
                 multiplier: Column | None = None, apply: str = "scale_free") -> DataFrame:
    """Free nitrogen = max(0, total - bound), with an optional flux multiplier.

    ``anchors`` is the one-row table with ``bound_init``. With free_mode "preserve_total" the free anchor is what
    the reference total leaves.
    """
    a = anchors.withColumn("free_init", F.lit(float(free_init)) if free_mode == "config" else F.greatest(F.lit(0.0), F.lit(float(total_ref)) - F.col("bound_init")))
    a = a.select((F.col("free_init") + F.col("bound_init")).alias("total_init"))
    d = attach_one(df, a)
    free = F.greatest(F.lit(0.0), F.col("total_init") - F.col(bound))
    d = d.withColumn("free_n", free)
    if multiplier is None:
        return d.withColumn("free_n_used", F.col("free_n"))
    scaled = F.col("free_n") * multiplier if apply == "scale_free" else F.col("total_init") * multiplier - F.col(bound)
    return d.withColumn("free_n_used", F.greatest(F.lit(0.0), scaled))


def relative_detritus(df: DataFrame, rel: DataFrame, time: str, base: float, factor: float, out: str = "detritus_n") -> DataFrame:
    """Detritus nitrogen from a relative series keyed by the running number of the time step (from 0)."""
    steps = df.select(time).distinct().withColumn("step_no", F.row_number().over(W.orderBy(time)) - 1)
    j = df.join(steps, time).join(rel, "step_no", "left")
    return j.withColumn(out, F.lit(base) * (1 + F.coalesce("rel", F.lit(0.0))) * factor)


def redfield_free(biomass_c: Column, total_n: float) -> tuple[Column, Column]:
    """Bound and free nitrogen from total carbon at the Redfield ratio."""
    bound = biomass_c / REDFIELD_C_TO_N
    return bound, F.greatest(F.lit(0.0), F.lit(float(total_n)) - bound)


def pool_by(df: DataFrame, keys: Sequence[str], values: Sequence[str], *, how: str = "mean", counts: Sequence[str] = (),
            flags: Sequence[str] = ()) -> DataFrame:
    """Pool rows to keys with mean or exact median, row count, mean of counts and flag fractions."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if how == "mean":
        aggs += [F.avg(v).alias(v) for v in values]
    aggs += [F.avg(c).alias(f"mean_{c}") for c in counts] + [F.avg(F.col(f).cast("double")).alias(f"frac_{f}") for f in flags]
    out = df.groupBy(*keys).agg(*aggs)
    if how == "median":
        out = null_safe_join(out, grouped_medians(df, keys, values), list(keys), "left")
    return out


def climatology_band(year_bins: DataFrame, bin_col: str, values: Sequence[str], centre: str = "mean") -> DataFrame:
    """Centre, q10, q90 and year count per bin; each year counts once, so a bin holds at most one row per year."""
    fn = F.avg if centre == "mean" else F.median
    aggs = []
    for v in values:
        aggs += [fn(v).alias(f"{v}_center"), F.percentile(v, 0.1).alias(f"{v}_q10"), F.percentile(v, 0.9).alias(f"{v}_q90"), F.count(v).alias(f"{v}_years")]
    return year_bins.groupBy(bin_col).agg(*aggs)


def annual_from_climatology(clim: DataFrame, bin_col: str, value: str, winter_bins: Sequence[int]) -> DataFrame:
    """Equal-weight annual mean and winter mean of a binned climatology."""
    return clim.agg(F.avg(value).alias("annual_mean"), F.avg(F.when(F.col(bin_col).isin(list(winter_bins)), F.col(value))).alias("winter_mean"))
