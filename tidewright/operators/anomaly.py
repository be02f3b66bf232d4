"""Climatologies and standardised anomalies.

Tow tables are reduced to one row per (group, season, year) first; everything after that works on summary
tables whose size is bounded by the number of years, so windows over a group stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..functions.clean import log_offset
from .joins import null_safe_join, salted_join, with_group_stats
from .skill import finite

EPS_SD = 1e-12


def usable_sd(c: Column, eps: float = EPS_SD) -> Column:
    """A standard deviation that is NULL when undefined or practically zero."""
    return F.when(~F.isnan(c) & (F.abs(c) >= eps), c)


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Value minus group mean over group SD, on rows."""
    d = with_group_stats(df, keys, [value], __mu=F.avg(value), __sd=F.stddev_samp(value))
    return d.withColumn(out, F.try_divide(F.col(value) - F.col("__mu"), usable_sd(F.col("__sd")))).drop("__mu", "__sd")


def zscore_bounded(keys: Sequence[str], value: Column | str, where: Column | None = None) -> Column:
    """z-score inside a window, for summary tables; ``where`` picks the rows that define the baseline."""
    w = W.partitionBy(*keys)
    v = F.col(value) if isinstance(value, str) else value
    base = v if where is None else F.when(where, v)
    return (v - F.avg(base).over(w)) / usable_sd(F.stddev_samp(base).over(w))


def summarise(v: Column, method: str, base: str = "log10", offset: float = 1e-6) -> Column:
    """Aggregate of a group: mean_raw, log_of_mean or mean_of_logs."""
    if method == "mean_raw":
        return F.avg(v)
    if method == "log_of_mean":
        return log_offset(F.avg(v), base, offset)
    if method == "mean_of_logs":
        return F.avg(log_offset(v, base, offset))
    raise ValueError(f"unknown summary method {method!r}")


def season_year_summary(paired: DataFrame, keys: Sequence[str], *, obs: str = "obs", model: str = "model",
                        tow: str = "tow", obs_method: str = "mean_of_logs", model_method: str = "mean_raw",
                        base: str = "log10", offset: float = 1e-6) -> DataFrame:
    """One row per key with summarised values and the number of distinct tows."""
    both = paired.where(F.col(obs).isNotNull() & F.col(model).isNotNull())
    return both.groupBy(*keys).agg(
        summarise(F.col(obs), obs_method, base, offset).alias("obs_value"),
        summarise(F.col(model), model_method, base, offset).alias("model_value"),
        F.countDistinct(tow).alias("n_tows"),
    )


def weighted_stats(x: Column, w: Column, keys: Sequence[str]) -> tuple[Column, Column]:
    """Weighted mean and SD with the effective-degrees-of-freedom correction, over a small partition."""
    win = W.partitionBy(*keys)
    ok = x.isNotNull() & (w > 0)
    w1, x1 = F.when(ok, w), F.when(ok, x)
    sw = F.sum(w1).over(win)
    mu = F.try_divide(F.sum(w1 * x1).over(win), sw)
    denom = sw - F.try_divide(F.sum(w1 * w1).over(win), sw)
    # E[w x^2] - mu^2 loses digits; centre on the unweighted mean first.
    c = F.avg(x1).over(win)
    var = F.try_divide(F.sum(w1 * (x1 - c) * (x1 - c)).over(win) - sw * (mu - c) * (mu - c), denom)
    return mu, F.when(denom > 0, F.sqrt(F.greatest(var, F.lit(0.0))))


def climatology_anomalies(summary: DataFrame, keys: Sequence[str], *, mode: str = "year_equal", min_tows: int = 3,
                          power: float = 0.5, cap: int | None = None, eps: float = EPS_SD) -> DataFrame:
    """Standardise yearly summary values; only years with ``min_tows`` define mean and SD.

    mode: year_equal (each year counts once), year_weighted (weight min(n, cap)^power) or tow (weight n).
    """
    good = F.col("n_tows") >= min_tows
    out = {}
    for side in ("obs", "model"):
        v = F.col(f"{side}_value")
        base = F.when(good, v)
        if mode == "year_equal":
            w = W.partitionBy(*keys)
            mu, sd = F.avg(base).over(w), F.stddev_samp(base).over(w)
        else:
            n = F.col("n_tows").cast("double")
            if mode == "year_weighted":
                n = F.least(n, F.lit(float(cap))) if cap is not None else n
                n = F.pow(n, F.lit(power))
            elif mode != "tow":
                raise ValueError(f"unknown climatology mode {mode!r}")
            mu, sd = weighted_stats(base, n, keys)
        out[f"{side}_anom"] = (v - mu) / usable_sd(sd, eps)
    return summary.withColumns(out)


def seasonal_anomalies(paired: DataFrame, *, group: str = "grp", min_seasons: int = 1, with_all: bool = True,
                       mode: str = "year_equal", min_tows: int = 3, power: float = 0.5, cap: int | None = None,
                       extra: Sequence[str] = (), **summary_args) -> DataFrame:
    """Anomalies per season, plus 'All' as the mean of the seasonal anomalies of the year."""
    extra = list(extra)
    s = season_year_summary(paired, [*extra, group, "season", "year"], **summary_args)
    a = climatology_anomalies(s, [*extra, group, "season"], mode=mode, min_tows=min_tows, power=power, cap=cap)
    a = a.select(*extra, group, "season", "year", "obs_anom", "model_anom", "n_tows")
    if not with_all:
        return a
    return _with_all_seasons(a, [*extra, group], ["obs_anom", "model_anom"], min_seasons, sums=["n_tows"])


def _with_all_seasons(a: DataFrame, keys: Sequence[str], values: Sequence[str], min_seasons: int = 1, sums: Sequence[str] = ()) -> DataFrame:
    """Add 'All' rows with the mean over seasons. Every row counts once for its season, where it is alone, and
    once for 'All', so the table is read a single time."""
    both = a.withColumn("season", F.explode(F.array(F.col("season"), F.lit("All"))))
    out = both.groupBy(*keys, "season", "year").agg(
        *[F.avg(v).alias(v) for v in values], *[F.sum(s).alias(s) for s in sums], F.count(F.lit(1)).alias("__ns"))
    return out.where((F.col("season") != "All") | (F.col("__ns") >= min_seasons)).drop("__ns")


def pooled_anomalies(paired: DataFrame, keys: Sequence[str], year: str = "year", sides: Sequence[str] = ("obs", "model")) -> DataFrame:
    """Yearly mean of tow z-scores, where mean and SD come from all tows of the group.

    The mean of z-scores of a year equals the year's mean standardised by the pooled moments, so one grouped
    pass with map-side combine is enough and tow rows are never joined back.
    """
    aggs = []
    for s in sides:
        aggs += [F.count(s).alias(f"__n_{s}"), F.avg(s).alias(f"__m_{s}"), F.var_pop(s).alias(f"__v_{s}")]
    a = paired.groupBy(*keys, year).agg(*aggs)
    w = W.partitionBy(*keys)
    for s in sides:
        n, m, v = F.col(f"__n_{s}"), F.col(f"__m_{s}"), F.col(f"__v_{s}")
        a = a.withColumn(f"__mu_{s}", F.try_divide(F.sum(n * m).over(w), F.sum(n).over(w)))
        mu = F.col(f"__mu_{s}")
        sd = F.sqrt(F.try_divide(F.sum(n * v + n * (m - mu) * (m - mu)).over(w), F.sum(n).over(w) - 1))
        a = a.withColumn(f"{s}_anom", (m - mu) / usable_sd(sd))
    return a.select(*keys, year, *[f"{s}_anom" for s in sides])


def compare_summaries(paired: DataFrame, group: str = "grp",
                      methods: Sequence[str] = ("mean_raw", "log_of_mean", "mean_of_logs"),
                      model_method: str = "mean_raw", offset: float = 1e-6, base: str = "log10", **clim) -> DataFrame:
    """Anomalies for several observation summaries in one job: the method is a column, not a loop."""
    both = paired.where("obs IS NOT NULL AND model IS NOT NULL")
    s = both.groupBy(group, "season", "year").agg(
        *[summarise(F.col("obs"), m, base, offset).alias(m) for m in methods],
        summarise(F.col("model"), model_method, base, offset).alias("model_value"),
        F.countDistinct("tow").alias("n_tows"),
    )
    long = s.withColumn("__m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(m).alias("obs_value")) for m in methods])))
    long = long.select(group, "season", "year", "n_tows", "model_value", "__m.method", "__m.obs_value")
    a = climatology_anomalies(long, ["method", group, "season"], **clim)
    a = a.select("method", group, "season", "year", "obs_anom", "model_anom")
    return _with_all_seasons(a, ["method", group], ["obs_anom", "model_anom"])


def model_only_anomalies(series: DataFrame, *, group: str = "grp", value: str = "value", method: str = "mean_raw",
                         min_seasons: int = 1, offset: float = 1e-6) -> DataFrame:
    """Seasonal and 'All' anomalies of one series (columns group, season, year, value), all years counted."""
    s = series.where(F.col(value).isNotNull()).groupBy(group, "season", "year").agg(
        summarise(F.col(value), method, "log10", offset).alias("v"))
    s = s.withColumn("anom", zscore_bounded([group, "season"], "v")).select(group, "season", "year", "anom")
    return _with_all_seasons(s, [group], ["anom"], min_seasons)


def monthly_normalised(df: DataFrame, *, group: str, year: str = "year", month: str = "month", value: str,
                       offset: float = 1e-4) -> DataFrame:
    """Rows with departures from the climatological months: mean, SD and median over months, five columns."""
    months = df.groupBy(group, month, year).agg(F.avg(value).alias("__mm"), F.min(value).alias("__lo"))
    clim = months.groupBy(group, month).agg(F.avg("__mm").alias("__cm"), F.median("__mm").alias("__cd"), F.min("__lo").alias("__lo"))
    ann = clim.groupBy(group).agg(
        F.avg("__cm").alias("annual_mean"), F.stddev_samp("__cm").alias("annual_sd"), F.median("__cd").alias("annual_median"), F.min("__lo").alias("__lo"))
    ann = ann.withColumn("__zlo", F.try_divide(F.col("__lo") - F.col("annual_mean"), F.col("annual_sd"))).drop("__lo")
    d = salted_join(df, ann, [group], [value, year, month])
    d = d.withColumns({
        "from_mean": F.col(value) - F.col("annual_mean"),
        "from_median": F.col(value) - F.col("annual_median"),
        "norm_mean": F.try_divide(F.col(value) - F.col("annual_mean"), F.col("annual_sd")),
        "norm_median": F.try_divide(F.col(value) - F.col("annual_median"), F.col("annual_sd")),
    })
    return d.withColumn("norm_log", F.log(F.col("norm_mean") - F.col("__zlo") + offset)).drop("__zlo")


def month_year_standardised(df: DataFrame, *, group: str, values: Sequence[str]) -> DataFrame:
    """Month-year means as departures from the mean of monthly means, scaled by their SD, with the month's
    own mean beside it (``<value>_clim``)."""
    my = df.groupBy(group, "year", "month").agg(*[F.avg(v).alias(v) for v in values])
    g, gm = W.partitionBy(group), W.partitionBy(group, "month")
    first = F.row_number().over(gm.orderBy("year")) == 1
    my = my.withColumns({f"__c_{v}": F.avg(v).over(gm) for v in values}).withColumn("__first", first)
    for v in values:
        once = F.when(F.col("__first"), F.col(f"__c_{v}"))
        my = my.withColumn(f"{v}_std", (F.col(v) - F.avg(once).over(g)) / usable_sd(F.stddev_samp(once).over(g)))
    my = my.withColumns({f"{v}_clim": F.avg(f"{v}_std").over(gm) for v in values})
    return my.select(group, "year", "month", *[f"{v}_std" for v in values], *[f"{v}_clim" for v in values])


def seasonal_check(std: DataFrame, *, group: str, obs: str, model: str) -> DataFrame:
    """How much of the agreement is the seasonal cycle: four correlations per group."""
    o, m, oc, mc = F.col(f"{obs}_std"), F.col(f"{model}_std"), F.col(f"{obs}_clim"), F.col(f"{model}_clim")
    return std.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_month_years"),
        finite(pearson(o, m)).alias("r_model"),
        finite(pearson(o, mc)).alias("r_model_clim"),
        finite(pearson(o, oc)).alias("r_obs_clim"),
        finite(pearson(o - oc, m - mc)).alias("r_deseasoned"),
    )


def domain_anomalies(df: DataFrame, *, domain: str, season: str, value: str) -> DataFrame:
    """Seasonal means of a domain against the domain's own mean and SD over all samples."""
    seas = df.groupBy(domain, season).agg(F.avg(value).alias("seasonal_mean"))
    ann = df.groupBy(domain).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    j = null_safe_join(seas, ann, [domain])
    return j.withColumn("anomaly", (F.col("seasonal_mean") - F.col("mean")) / usable_sd(F.col("sd")))


def ices_anomalies(df: DataFrame, *, keys: Sequence[str] = (), value: str, year: str = "year", season: str = "season",
                   offset: float = 1e-6, base_years: tuple[int, int] | None = None, logs_first: bool = False,
                   need: Sequence[str] = ("Spring", "Summer")) -> DataFrame:
    """log10 seasonal mean minus its seasonal climatology (over ``base_years``), averaged over the seasons of
    a year; a year counts only when it holds one of the seasons in ``need``."""
    s = ices_seasonal(df, keys=keys, value=value, year=year, season=season, offset=offset, base_years=base_years,
                      logs_first=logs_first)
    out = s.groupBy(*keys, year).agg(
        F.avg("anom").alias("anom"), F.count(F.lit(1)).alias("n_seasons"), F.sum("n").alias("n_tows"),
        F.bool_or(F.col(season).isin(list(need))).alias("__ok"))
    return out.where("__ok").drop("__ok")


def ices_seasonal(df: DataFrame, *, keys: Sequence[str] = (), value: str, year: str = "year", season: str = "season",
                  offset: float = 1e-6, base_years: tuple[int, int] | None = None, logs_first: bool = False) -> DataFrame:
    v = F.avg(F.log10(F.col(value) + offset)) if logs_first else F.log10(F.avg(value) + offset)
    s = df.groupBy(*keys, year, season).agg(v.alias("level"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*keys, season)
    base = F.col("level") if base_years is None else F.when(F.col(year).between(*base_years), F.col("level"))
    return s.withColumn("anom", F.col("level") - F.avg(base).over(w))


def recipe_search(df: DataFrame, reference: DataFrame, *, date_year: str, month: str, values: dict[str, str],
                  season: str = "season", base_years: tuple[int, int] | None = None, offset: float = 0.0) -> DataFrame:
    """Unit x December rule x summary recipes against a published yearly series (columns year, ref)."""
    dec = F.col(month) == 12
    rows = F.array(*[
        F.struct(F.lit(u).alias("unit"), F.lit(rule).alias("december"), yr.cast("int").alias("year"), F.col(c).alias("v"))
        for u, c in values.items()
        for rule, yr in (("same year", F.col(date_year)), ("next year", F.col(date_year) + F.when(dec, 1).otherwise(0)))])
    long = df.select(season, F.inline(rows))
    parts = []
    for label, logs_first in (("log of mean", False), ("mean of logs", True)):
        a = ices_anomalies(long, keys=["unit", "december"], value="v", season=season, offset=offset,
                           base_years=base_years, logs_first=logs_first)
        parts.append(a.withColumn("summary", F.lit(label)))
    j = parts[0].unionByName(parts[1]).join(reference, "year")
    return j.groupBy("unit", "december", "summary").agg(
        finite(pearson("anom", "ref")).alias("r"), F.max(F.abs(F.col("anom") - F.col("ref"))).alias("max_diff"),
        F.count(F.lit(1)).alias("n"))
