"""Forcing series and fields: light, wind, mixing multipliers, climatologies and spin-up.

Field operators work on long (year, step, row, col, value) tables. A cell's series has at most years x 120 rows,
which bounds every ordered window used here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import clip, log_offset
from .joins import attach_one, null_safe_join, with_group_stats

PAR_SHARE = 0.44
ALBEDO = 0.067
K_MIN = 0.05
K_INTERCEPT = 1.94
K_SLOPE = -0.063
# First and last step of each month in the 120-step calendar (1-based).
MONTH_STEPS = {1: (1, 10), 2: (11, 20), 3: (21, 30), 4: (31, 40), 5: (41, 50), 6: (51, 60), 7: (61, 70), 8: (71, 80),
               9: (81, 90), 10: (91, 100), 11: (101, 111), 12: (112, 120)}


def attenuation(salinity: Column) -> Column:
    k = F.greatest(F.lit(K_INTERCEPT) + F.lit(K_SLOPE) * salinity, F.lit(K_MIN))
    return F.when(salinity == 0, F.lit(0.0)).otherwise(k)


def mean_par(light: Column, salinity: Column, mixing: Column) -> Column:
    """Light averaged over the mixing layer; zero where salinity is zero (land)."""
    k = F.greatest(F.lit(K_INTERCEPT) + F.lit(K_SLOPE) * salinity, F.lit(K_MIN))
    kz = k * mixing
    surface = light * PAR_SHARE * (1 - ALBEDO)
    return F.when(salinity == 0, F.lit(0.0)).otherwise(F.try_divide(surface * (1 - F.exp(-kz)), kz))


def par_fields(df: DataFrame, light: str, salinity: str, mixing: str) -> DataFrame:
    par = F.round(mean_par(F.col(light), F.col(salinity), F.col(mixing)), 2)
    return df.withColumns({"par": par, "k": F.round(attenuation(F.col(salinity)), 3)}).withColumn("par_mixing", F.col("par") * F.col(mixing))


def par_climatology(df: DataFrame, cell: Sequence[str], light: str, salinity: str, mixing: str, year: str = "year") -> DataFrame:
    """Mean of yearly means of the inputs, then the light formula."""
    y = df.groupBy(*cell, year).agg(*[F.avg(c).alias(c) for c in (light, salinity, mixing)])
    m = y.groupBy(*cell).agg(*[F.avg(c).alias(c) for c in (light, salinity, mixing)])
    return par_fields(m, light, salinity, mixing)


def wind_blocks(df: DataFrame, keys: Sequence[str], u: str, v: str, *, month: Column, active_months: Sequence[int], override: float = 0.0,
                how: str = "max") -> DataFrame:
    """Speed (block max or mean), stress = speed squared, and mean of daily squared speed; fixed outside the season."""
    sp = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    d = df.withColumn("__s", sp)
    b = d.groupBy(*keys).agg((F.max if how == "max" else F.avg)("__s").alias("speed"), F.avg(F.col("__s") * F.col("__s")).alias("nutrient_stress"))
    b = b.withColumn("stress", F.col("speed") * F.col("speed"))
    off = ~month.isin(list(active_months))
    return b.withColumns({c: F.when(off, F.lit(float(override))).otherwise(F.col(c)) for c in ("speed", "stress", "nutrient_stress")})


def wind_climatology(blocks: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Mean speed and median stress of all blocks per cell (blocks per cell are bounded by the calendar)."""
    return blocks.groupBy(*cell).agg(F.avg("speed").alias("speed"), F.median("stress").alias("stress"))


def static_cells(field: DataFrame, cell: Sequence[str], value: str, threshold: float, *, sample: Column | None = None) -> DataFrame:
    """Cells whose SD over the chosen steps is under a threshold."""
    f = field if sample is None else field.where(sample)
    return f.groupBy(*cell).agg(F.stddev_pop(value).alias("sd")).withColumn("is_static", F.col("sd") < threshold)


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, half: int = 2, out: str | None = None) -> DataFrame:
    """Moving average over 2 half + 1 rows, shorter at the ends."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(out or value, F.avg(value).over(w))


def centred_mean_padded(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, half: int = 2, out: str | None = None) -> DataFrame:
    """Moving average that skips NULL and repeats the first and last row beyond the ends."""
    whole = W.partitionBy(*keys)
    run = whole.orderBy(*order)
    frame = run.rowsBetween(-half, half)
    full = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    i, n = F.row_number().over(run), F.count(F.lit(1)).over(whole)
    left, right = F.greatest(F.lit(0), half - (i - 1)), F.greatest(F.lit(0), half - (n - i))
    first, last = F.first(value).over(full), F.last(value).over(full)
    zero = F.lit(0.0)
    total = F.coalesce(F.sum(value).over(frame), zero) + left * F.coalesce(first, zero) + right * F.coalesce(last, zero)
    count = F.count(value).over(frame) + F.when(first.isNotNull(), left).otherwise(0) + F.when(last.isNotNull(), right).otherwise(0)
    return df.withColumn(out or value, F.try_divide(total, count))


def multiplier_series(df: DataFrame, value: str, *, order: Sequence[str] = ("year", "step"), cap: float = 22.0, log_eps: float | None = None,
                      exponent: float | None = None, half: int | None = 2, digits: int = 3) -> DataFrame:
    """Domain-mean series -> capped, stretched, smoothed and divided by its mean.

    The series is one row per calendar step, so the single ordered pass is over a few thousand rows.
    """
    d = df.withColumn("mult", clip(F.col(value), high=cap))
    if log_eps is not None:
        d = d.withColumn("mult", log_offset(F.col("mult"), "ln", log_eps))
    if exponent is not None:
        d = d.withColumn("mult", F.pow("mult", F.lit(exponent)))
    if half:
        d = centred_mean(d, [], list(order), "mult", half).withColumn("mult", F.round("mult", digits))
    mean = d.agg(F.avg("mult").alias("__m"))
    return attach_one(d, mean).withColumn("mult", F.round(F.try_divide("mult", "__m"), digits)).drop("__m")


def multiplier_field(field: DataFrame, cell: Sequence[str], value: str, *, order: Sequence[str] = ("year", "step"), cap: float = 22.0,
                     log_eps: float | None = None, exponent: float | None = None, half: int = 0, per_cell: bool = False,
                     static: DataFrame | None = None, masked: Column | None = None, nodata: float = -9999.0) -> DataFrame:
    """Gridded multiplier: cap, stretch, smooth, normalise globally or per cell; static cells are 1, masked cells nodata."""
    d = field if static is None else null_safe_join(field, static.select(*cell, "is_static"), list(cell), "left")
    if static is None:
        d = d.withColumn("is_static", F.lit(False))
    d = d.withColumn("is_static", F.coalesce("is_static", F.lit(False)))
    d = d.withColumn("__masked", F.lit(False) if masked is None else F.coalesce(masked, F.lit(False)))
    live = ~F.col("is_static") & ~F.col("__masked")
    d = d.withColumn("mult", F.when(live, clip(F.col(value), high=cap)))
    if log_eps is not None:
        d = d.withColumn("mult", log_offset(F.col("mult"), "ln", log_eps))
    if exponent is not None:
        d = d.withColumn("mult", F.pow("mult", F.lit(exponent)))
    if half:
        d = centred_mean_padded(d, list(cell), list(order), "mult", half)
    d = with_group_stats(d, list(cell) if per_cell else [], __mu=F.avg("mult"))
    mu = F.when(F.col("__mu").isNotNull() & (F.col("__mu") != 0), F.col("__mu")).otherwise(F.lit(1.0)) if per_cell else F.col("__mu")
    d = d.withColumn("mult", F.when(F.col("__masked"), F.lit(nodata)).when(F.col("is_static"), F.lit(1.0)).otherwise(F.try_divide(F.col("mult"), mu)))
    return d.drop("__mu", "__masked")


def step_climatology(field: DataFrame, cell: Sequence[str], value: str, digits: int | None = None) -> DataFrame:
    """Mean over years of each step and cell."""
    v = F.avg(value)
    return field.groupBy("step", *cell).agg((v if digits is None else F.round(v, digits)).alias("clim"))


def month_of_step(step: Column) -> Column:
    out = None
    for m, (a, b) in MONTH_STEPS.items():
        hit = step.between(a, b)
        out = F.when(hit, m) if out is None else out.when(hit, m)
    return out


def month_climatology(clim: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Monthly means of the step climatology."""
    return clim.groupBy(month_of_step(F.col("step")).alias("month"), *cell).agg(F.avg("clim").alias("clim"))


def scaled_anomaly(field: DataFrame, clim: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """1 + (x - climatology) / largest absolute anomaly, within [0, 2]."""
    d = field.join(clim, ["step", *cell]).withColumn("anomaly", F.col(value) - F.col("clim"))
    top = d.agg(F.max(F.abs("anomaly")).alias("__scale"))
    s = 1 + F.coalesce(F.try_divide("anomaly", "__scale"), F.lit(0.0) * F.col("anomaly"))
    return attach_one(d, top).withColumn("scaled", F.greatest(F.lit(0.0), F.least(F.lit(2.0), s))).drop("__scale")


def domain_mean_nonzero(field: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Domain mean per step; zeros are land and do not count."""
    return field.groupBy(*keys).agg(F.avg(F.when(F.col(value) != 0, F.col(value))).alias(value))


def spinup_copy(series: DataFrame, value: str, *, first_year: int, spin_years: Sequence[int], mean_rows: int = 12, digits: int = 2) -> DataFrame:
    """Prepend copies of the first year, renumber, and set the first rows to the long-term mean."""
    head = series.where(F.col("year") == first_year).withColumn("year", F.explode(F.array(*[F.lit(y) for y in spin_years])))
    d = head.unionByName(series)
    mean = series.agg(F.round(F.avg(value), digits).alias("__m"))
    d = attach_one(d.withColumn("index", F.row_number().over(W.orderBy("year", "step"))), mean)
    return d.withColumn(value, F.when(F.col("index") <= mean_rows, F.col("__m")).otherwise(F.col(value))).drop("__m")


def spinup_climatology(series: DataFrame, value: str, *, spin_years: Sequence[int], digits: int = 2) -> DataFrame:
    """Prepend years made of the per-step climatology and renumber."""
    clim = series.groupBy("step").agg(F.round(F.avg(value), digits).alias(value))
    head = clim.withColumn("year", F.explode(F.array(*[F.lit(y) for y in spin_years])))
    d = head.unionByName(series.select("step", value, "year"))
    return d.withColumn("index", F.row_number().over(W.orderBy("year", "step")))


def series_export(series: DataFrame, value: str, repeats: int = 12) -> DataFrame:
    """Forcing rows for the 1-D model: running step, and each step repeated with its own running index."""
    d = series.withColumn("index", F.row_number().over(W.orderBy("year", "step")))
    d = d.withColumn("sub", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return d.select(((F.col("index") - 1) * repeats + F.col("sub")).alias("row"), "index", "year", "step", value)


def day_profile(series: DataFrame, day: str, value: str) -> DataFrame:
    """Mean, p10 and p90 over years for each day (or step) of the year; values per day are bounded by the years."""
    return series.groupBy(day).agg(F.avg(value).alias("mean"), F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90"))
