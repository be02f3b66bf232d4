"""Timing of seasonal events.

Inputs are series already reduced to one row per key and time step, so the rows of one (key, year) window are
bounded by the calendar (at most one per day), whatever the size of the raw data behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .joins import attach_one, null_safe_join, with_group_stats
from .quantiles import grouped_median


def _years(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    return df.select(*keys, year).distinct()


def _first_hit(df: DataFrame, hit: Column, keys: Sequence[str], year: str, date: str) -> DataFrame:
    """First date of each (key, year) where ``hit`` holds; years without one stay with NULL."""
    return df.groupBy(*keys, year).agg(F.min(F.when(hit, F.col(date))).alias("onset_date")).withColumn(
        "onset_doy", F.dayofyear("onset_date"))


def threshold_onset(df: DataFrame, keys: Sequence[str], *, value: str, date: str = "date", year: str = "year",
                    factor: float = 1.05, sub_factor: float = 0.7, rule: str = "pair_means", centre: str = "median",
                    across_years: bool = False, exclude_months: Sequence[int] = ()) -> DataFrame:
    """First step at or above ``factor`` x centre that persists.

    rule "pair_means": the mean of the next two steps, or of the two after them, exceeds sub_factor x threshold;
    the last two steps of a year are not candidates and missing followers count as no.
    rule "two_of_four": at least two of the next four steps reach sub_factor x threshold; four must follow.
    """
    keys = list(keys)
    d = df.where(F.col(value).isNotNull())
    if exclude_months:
        d = d.where(~F.month(date).isin(list(exclude_months)))
    span = keys if across_years else [*keys, year]
    fn = F.median if centre == "median" else F.avg
    w = W.partitionBy(*keys, year).orderBy(date)
    if span:
        d = d.withColumn("__c", fn(value).over(W.partitionBy(*span)))
    else:
        d = attach_one(d, d.agg(fn(value).alias("__c")))
    d = d.withColumns({"__thr": F.lit(factor) * F.col("__c"), **{f"__n{i}": F.lead(value, i).over(w) for i in range(1, 5)}})
    v, thr = F.col(value), F.col("__thr")
    sub = F.lit(sub_factor) * thr
    n = [F.col(f"__n{i}") for i in range(1, 5)]
    if rule == "pair_means":
        keep = F.coalesce((n[0] + n[1]) / 2 > sub, F.lit(False)) | F.coalesce((n[2] + n[3]) / 2 > sub, F.lit(False))
        hit = (v >= thr) & n[1].isNotNull() & keep
    elif rule == "two_of_four":
        count = F.lit(0)
        for x in n:
            count = count + F.when(x >= sub, 1).otherwise(0)
        hit = (v >= thr) & n[3].isNotNull() & (count >= 2)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return _first_hit(d, hit, keys, year, date)


def weekly_onset(df: DataFrame, keys: Sequence[str], *, value: str, week: str = "week", year: str = "year",
                 rule: str = "either_next", factor: float = 1.05, sub_factor: float = 0.7, min_valid: int = 5,
                 threshold: float | None = None) -> DataFrame:
    """Onset week of a series with gaps: persistence looks at the next available weeks.

    ``threshold`` fixes the level (for series already divided by their median).
    """
    keys = list(keys)
    years = _years(df, keys, year)
    d = df.where(F.col(value).isNotNull())
    span = W.partitionBy(*keys, year)
    w = span.orderBy(week)
    thr = F.lit(threshold) if threshold is not None else F.lit(factor) * F.median(value).over(span)
    d = d.withColumns({"__nv": F.count(value).over(span), "__thr": thr,
                       **{f"__n{i}": F.lead(value, i).over(w) for i in range(1, 5)}})
    n = [F.col(f"__n{i}") for i in range(1, 5)]
    sub = F.lit(sub_factor) * F.col("__thr")
    if rule == "either_next":
        keep = (n[0] > sub) | (n[1] > sub)
    else:
        keep = F.coalesce((n[0] + n[1]) / 2 > sub, F.lit(False)) | F.coalesce((n[2] + n[3]) / 2 > sub, F.lit(False))
    hit = (F.col(value) >= F.col("__thr")) & n[1].isNotNull() & keep & (F.col("__nv") >= min_valid)
    first = d.groupBy(*keys, year).agg(F.min(F.when(hit, F.col(week))).alias("onset_week"))
    return null_safe_join(years, first, [*keys, year], "left")


def trailing_mean(df: DataFrame, keys: Sequence[str], *, value: str, date: str = "date", days: int = 6, out: str = "smooth") -> DataFrame:
    """Mean over the last ``days`` days; the value exactly ``days`` back is outside."""
    w = W.partitionBy(*keys).orderBy(F.unix_date(date)).rangeBetween(-(days - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def trailing_mean_time(df: DataFrame, keys: Sequence[str], *, value: str, ts: str, days: int = 6, out: str = "smooth") -> DataFrame:
    """As ``trailing_mean`` for timestamps, at microsecond resolution."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(*keys).orderBy(us).rangeBetween(-(days * 86_400_000_000 - 1), 0)
    return df.withColumn(out, F.avg(value).over(w))


def percent_of_max_onset(df: DataFrame, keys: Sequence[str], *, value: str, date: str = "date", year: str = "year",
                         days: int = 6, share: float = 0.95, exclude_months: Sequence[int] = (), log_offset: float | None = None) -> DataFrame:
    """First date at which the trailing mean reaches ``share`` of its yearly maximum (positive maxima only)."""
    keys = list(keys)
    d = df.where(~F.month(date).isin(list(exclude_months))) if exclude_months else df
    if log_offset is not None:
        d = d.withColumn(value, F.log(F.col(value) + log_offset))
    d = trailing_mean(d, [*keys, year], value=value, date=date, days=days, out="__s")
    d = d.withColumn("__mx", F.max("__s").over(W.partitionBy(*keys, year)))
    return _first_hit(d, (F.col("__mx") > 0) & (F.col("__s") >= F.lit(share) * F.col("__mx")), keys, year, date)


def labels_by_bounds(doy: Column, early: float = 68, late: float = 108, margin: float = 1.5, scheme: str = "margin") -> Column:
    """early / late / avg / cusp. Schemes: "margin" (avg strictly inside the margins), "margin_wide" (avg test
    shifted by one day), "plain" (no margin, everything between is avg, missing is 'na')."""
    if scheme == "plain":
        return F.when(doy.isNull(), "na").when(doy <= early, "early").when(doy >= late, "late").otherwise("avg")
    out = F.when(doy.isNull(), F.lit(None).cast("string")).when(doy + margin <= early, "early").when(doy - margin >= late, "late")
    if scheme == "margin":
        inside = (doy - margin >= early) & (doy + margin <= late)
    else:
        inside = (doy + margin <= late - 1) & (doy - margin >= early - 1)
    return out.when(inside, "avg").otherwise("cusp")


def labels_by_sd(doy: Column, mean: Column, sd: Column) -> Column:
    return (F.when(doy.isNull(), F.lit(None).cast("string")).when(doy <= mean - sd, "early").when(doy >= mean + sd, "late")
            .when((doy <= mean + sd - 1) & (doy >= mean - sd + 1), "avg").otherwise("cusp"))


def agreement(a: DataFrame, b: DataFrame, on: Sequence[str], a_label: str, b_label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of years whose labels agree."""
    j = a.join(b, list(on))
    return j.groupBy(*keys).agg(
        F.count_if(F.col(a_label) == F.col(b_label)).alias("count"), F.count(F.lit(1)).alias("total"),
    ).withColumn("proportion", F.col("count") / F.col("total"))


def weak_cells(df: DataFrame, cell: Sequence[str], *, value: str, year: str = "year", share: float = 0.1) -> DataFrame:
    """Cells whose mean yearly peak is below a share of the median over cells (``weak`` flag per cell)."""
    peak = df.groupBy(*cell, year).agg(F.max(value).alias("__pk")).groupBy(*cell).agg(F.avg("__pk").alias("peak"))
    med = grouped_median(peak, [], "peak", "__med")
    return attach_one(peak, med).withColumn("weak", F.col("peak") < F.lit(share) * F.col("__med")).drop("__med")


def cell_coherence(onsets: DataFrame, region: DataFrame, cell: Sequence[str], *, doy: str = "onset_doy", region_doy: str = "region_doy",
                   year: str = "year") -> DataFrame:
    """Per cell: mean, SD (population) and interannual r with the regional series.

    Each sum of the correlation runs over the years where its own terms exist, as departures from the cell's
    and the region's means; years without an onset add nothing.
    """
    keys = list(cell)
    j = onsets.join(region.select(year, region_doy), year)
    rm = region.agg(F.avg(region_doy).alias("__rm"))
    stats = onsets.groupBy(*keys).agg(F.avg(doy).alias("mean"), F.stddev_pop(doy).alias("sd"), F.count(doy).alias("n_years"))
    j = null_safe_join(j, stats, keys)
    j = attach_one(j, rm)
    a, b = F.col(doy) - F.col("mean"), F.col(region_doy) - F.col("__rm")
    s = j.groupBy(*keys, "mean", "sd", "n_years").agg(
        F.try_divide(F.sum(a * b), F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("r"))
    return s.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def score_recipes(onsets: DataFrame, keys: Sequence[str], doy: str, ref: str) -> DataFrame:
    """Onset agreement in 8-day weeks per recipe: same week, within one week, bias, MAE and r."""
    d = onsets.where(F.col(doy).isNotNull() & F.col(ref).isNotNull())
    gap = F.abs(F.floor((F.col(doy) - 1) / 8) - F.floor((F.col(ref) - 1) / 8))
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(gap == 0).alias("same_week"), F.count_if(gap <= 1).alias("within_one"),
        F.avg(F.col(doy) - F.col(ref)).alias("bias"), F.avg(F.abs(F.col(doy) - F.col(ref))).alias("mae"),
        pearson(doy, ref).alias("__r"))
    return out.withColumn("r", F.when((F.col("n") > 3) & ~F.isnan("__r"), F.col("__r"))).drop("__r")


def best_recipe(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best recipe by same week, then within one week, then smaller MAE (first name on full ties); no row without scores."""
    order = F.struct(-F.col("same_week"), -F.col("within_one"), F.col("mae"), *[F.col(k) for k in keys])
    best = scores.agg(F.min_by(F.struct(*[F.col(c) for c in scores.columns]), order).alias("b"))
    return best.where("b IS NOT NULL").select("b.*")


def ratio_to_annual_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "ratio", available: Column | None = None) -> DataFrame:
    """Weekly value over the median of the available weeks of the key (source and year)."""
    w = W.partitionBy(*keys)
    base = F.col(value) if available is None else F.when(available, F.col(value))
    return df.withColumn(out, F.try_divide(F.col(value), F.median(base).over(w)))


def block_pattern(blocks: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Difference of standardised log patterns over cells (z_b - z_a) per block."""
    d = blocks.where((F.col(a) > 0) & (F.col(b) > 0)).withColumns({"__a": F.log(a), "__b": F.log(b)})
    d = with_group_stats(d, keys, ["__a", "__b"], __am=F.avg("__a"), __as=F.stddev_pop("__a"), __bm=F.avg("__b"), __bs=F.stddev_pop("__b"))
    z = F.try_divide(F.col("__b") - F.col("__bm"), F.col("__bs")) - F.try_divide(F.col("__a") - F.col("__am"), F.col("__as"))
    return d.withColumn("dz", z).drop("__am", "__as", "__bm", "__bs")


def pattern_agreement(pattern: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spatial r of the log values and the share of cells whose standardised difference exceeds one."""
    return pattern.groupBy(*keys).agg(pearson("__a", "__b").alias("r"), F.count(F.lit(1)).alias("n"),
                                      F.avg(F.when(F.abs("dz") > 1, 1.0).otherwise(0.0)).alias("share_over_one"))
