"""Survey tables: tows, taxa, stations and sampling effort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.clean import row_sum
from .joins import attach_one, complete_axis, null_safe_join, with_group_stats
from .quantiles import grouped_quantiles, modes_by_count


def tow_range(start: Column, end: Column) -> Column:
    return F.abs(start) - F.abs(end)


def is_eligible(*, start: str = "start_depth", end: str = "end_depth", bottom: str = "bottom_depth", min_share: float = 0.7,
                min_start: float = 150.0, max_bottom: float | None = None) -> Column:
    """Does a tow cover enough of the water column, or start deep enough? Missing ratios count as no."""
    share = F.try_divide(tow_range(F.col(start), F.col(end)), F.col(bottom))
    keep = F.coalesce(share >= min_share, F.lit(False)) | F.coalesce(F.col(start) >= min_start, F.lit(False))
    return keep if max_bottom is None else keep & F.coalesce(F.col(bottom) <= max_bottom, F.lit(False))


def eligible_tows(df: DataFrame, *, start: str = "start_depth", end: str = "end_depth", bottom: str = "bottom_depth", mode: str = "coverage",
                  min_share: float = 0.7, min_start: float = 150.0, max_bottom: float | None = None) -> DataFrame:
    """Tows that cover enough of the water column or start deep enough.

    ``mode``: "coverage" needs the three depth columns, "if_present" lets a table without one of them pass unchanged, "none" filters
    nothing. Any other mode is an error, and so is a missing column under "coverage".
    """
    if mode not in ("coverage", "if_present", "none"):
        raise ValueError(f"unknown mode {mode}")
    missing = [c for c in (start, end, bottom) if c not in df.columns]
    if mode == "none" or (missing and mode == "if_present"):
        return df
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; mode 'if_present' lets such tables pass")
    return df.where(is_eligible(start=start, end=end, bottom=bottom, min_share=min_share, min_start=min_start, max_bottom=max_bottom))


def without_stations(df: DataFrame, stations: Sequence[str], station: str = "station", if_present: bool = False) -> DataFrame:
    """Drop named stations, ignoring case and outer blanks; ``if_present`` lets a table without the column pass unchanged."""
    names = [s.strip().lower() for s in stations if s.strip()]
    if station not in df.columns:
        if not if_present:
            raise ValueError(f"no column {station}")
        return df
    if not names:
        return df
    return df.where(~F.coalesce(F.lower(F.trim(station)).isin(names), F.lit(False)))


def net_avoidance(value: Column, is_group: Column, is_adult: Column, factor: float = 3.0) -> Column:
    """Raise adults of the avoiding group by a factor."""
    return F.when(F.coalesce(is_group & is_adult, F.lit(False)), value * factor).otherwise(value)


def areal_biomass(abundance: Column, body_mass: Column, range_m: Column) -> Column:
    """g per square metre from abundance, body mass (mg) and tow range."""
    return abundance * body_mass * range_m * 1e-3


def replace_zeros(df: DataFrame, keys: Sequence[str], value: str, id_cols: Sequence[str], seed: int = 1) -> DataFrame:
    """Zeros become a repeatable draw from (0, half the smallest positive value of the group).

    The draw comes from a hash of the row's identity, so retried tasks and reruns give the same numbers.
    """
    d = with_group_stats(df, keys, id_cols, __lo=F.min(F.when(F.col(value) > 0, F.col(value))))
    u = (F.pmod(F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed)), F.lit(2**31)) + 0.5) / float(2**31)
    return d.withColumn(value, F.when((F.col(value) == 0) & F.col("__lo").isNotNull(), u * 0.5 * F.col("__lo")).otherwise(F.col(value))).drop("__lo")


def tow_table(records: DataFrame, tow_cols: Sequence[str], group: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Sum per tow and group, one column per group. One grouping by tow: a pivot would first group by tow and group."""
    return records.groupBy(*tow_cols).agg(*[F.sum(F.when(F.col(group) == g, F.col(value))).alias(g) for g in groups])


def paired_long(wide: DataFrame, keep: Sequence[str], groups: Sequence[str], model_prefix: str, total: str = "Total") -> DataFrame:
    """One row per tow and group with observed and modelled value, plus the row total. One scan, no self-join."""
    have = [g for g in groups if g in wide.columns and f"{model_prefix}{g}" in wide.columns]
    def col(n: str) -> Column:
        return F.col(f"`{n}`")

    items = [F.struct(F.lit(g).alias("group"), col(g).cast("double").alias("obs"), col(f"{model_prefix}{g}").cast("double").alias("model")) for g in have]
    items.append(F.struct(F.lit(total).alias("group"), row_sum([col(g) for g in have]).alias("obs"),
                          row_sum([col(f"{model_prefix}{g}") for g in have]).alias("model")))
    return wide.select(*keep, F.inline(F.array(*items)))


def station_means(df: DataFrame, keys: Sequence[str], groups: Sequence[str], families: Mapping[str, Sequence[str]]) -> DataFrame:
    """Station-level means and family totals."""
    m = df.groupBy(*keys).agg(*[F.avg(g).alias(g) for g in groups])
    return m.withColumns({name: row_sum([F.col(f"`{c}`") for c in cols]) for name, cols in families.items()})


def presence_only_mean(records: DataFrame, *, period: Sequence[str], taxon: Sequence[str], size_class: str, tow: str, value: str) -> DataFrame:
    """Mean density per survey from presence-only records: sums over records divided by all surveys of the period,
    with rounding at every level as survey tables publish it.

    The records are read once: the first record of a tow in a period stands for the survey, so surveys are summed along with the values.
    """
    first = F.row_number().over(W.partitionBy(tow, *period).orderBy(tow)) == 1
    rows = records.select(*period, *taxon, size_class, F.round(value, 3).alias("__v"), (first & F.col(tow).isNotNull()).cast("long").alias("__first"))
    by_size = rows.groupBy(*period, *taxon, size_class).agg(F.sum("__v").alias("__v"), F.sum("__first").alias("__first"))
    # One row per taxon and size class of a period is left here.
    by_size = by_size.withColumn("n_surveys", F.sum("__first").over(W.partitionBy(*period)))
    by_size = by_size.withColumn("__v", F.round(F.col("__v") / F.col("n_surveys"), 3))
    return by_size.groupBy(*period, *taxon, "n_surveys").agg(F.sum(F.round("__v", 2)).alias("mean_value"))


def all_years_mean(species: DataFrame, *, year: str, keys: Sequence[str], value: str = "mean_value") -> DataFrame:
    """Sum over years divided by the span of years (last minus first), rounded."""
    span = species.agg((F.max(year) - F.min(year)).alias("__y"))
    s = species.groupBy(*keys).agg(F.sum(F.round(value, 4)).alias("__s"), F.count(F.lit(1)).alias("n_occurrences"))
    return attach_one(s, span).withColumn("mean_value", F.round(F.try_divide(F.col("__s"), F.col("__y")), 4)).drop("__s", "__y")


def depth_scaled(groups: DataFrame, grid: DataFrame, *, value: str, depth: str = "depth", tow_share: float = 1.0, digits: int = 2) -> DataFrame:
    """Domain mean of depth x tow share x concentration. The product is linear in depth, so the grid contributes
    one number, its mean depth."""
    mean = grid.agg(F.avg(depth).alias("__d"))
    return attach_one(groups, mean).withColumn("areal", F.round(F.col("__d") * tow_share * F.col(value) * 1e-3, digits)).drop("__d")


def dedupe_mean_mode(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """One row per key: mean of numbers, most frequent text."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric])
    return null_safe_join(out, modes_by_count(df, keys, text), list(keys), "left") if text else out


def stage_counts(stages: Mapping[str, DataFrame], keys: Sequence[str], tow: str | None) -> DataFrame:
    """Distinct tows (or rows) per stage, one column each, with fractions of the raw and previous stages."""
    long = None
    for name, df in stages.items():
        n = F.countDistinct(tow) if tow else F.count(F.lit(1))
        part = df.groupBy(*keys).agg(n.alias("n")).withColumn("stage", F.lit(name))
        long = part if long is None else long.unionByName(part)
    names = list(stages)
    wide = long.groupBy(*keys).pivot("stage", names).agg(F.sum("n")).fillna(0, names)
    return _stage_fractions(wide.withColumnsRenamed({n: f"n_{n}" for n in names}), names)


def stage_flag_counts(df: DataFrame, keys: Sequence[str], tow: str, stages: Mapping[str, Column]) -> DataFrame:
    """As ``stage_counts`` for stages that are conditions on one table: one scan, tows reduced before counting."""
    per_tow = df.groupBy(*keys, tow).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f"__{n}") for n, c in stages.items()])
    wide = per_tow.groupBy(*keys).agg(*[F.count_if(F.col(f"__{n}") & F.col(tow).isNotNull()).alias(f"n_{n}") for n in stages])
    return _stage_fractions(wide, list(stages))


def _stage_fractions(wide: DataFrame, names: list[str]) -> DataFrame:
    fr = {f"frac_{b}_of_{a}": F.try_divide(F.col(f"n_{b}"), F.when(F.col(f"n_{a}") != 0, F.col(f"n_{a}")))
          for a, b in [*zip(names[:-1], names[1:]), (names[0], names[-1])]}
    return wide.withColumns(fr)


def tow_replication(df: DataFrame, *, station: str = "station", year: str = "year", season: str = "season", tow: str = "tow", max_list: int = 12) -> DataFrame:
    """Tows per station by (year, season), (year, All) and overall, with the stations sampled more than once.

    The station list holds the ``max_list`` most sampled names and the number of further ones; ranking keeps that
    many rows per group before anything is collected.
    """
    base = df.where(F.col(station).isNotNull() & F.col(tow).isNotNull()).groupBy(
        F.col(year).cast("string").alias("year"), F.col(season).alias("season"), F.col(station).cast("string").alias("station")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(tow).alias("tows"))
    levels = F.array(F.struct(F.col("year").alias("y"), F.col("season").alias("s")), F.struct(F.col("year").alias("y"), F.lit("All").alias("s")),
                     F.struct(F.lit("All").alias("y"), F.lit("All").alias("s")))
    d = base.withColumn("__l", F.explode(levels)).select(F.col("__l.y").alias("year"), F.col("__l.s").alias("season"), "station", "rows", "tows")
    keys = ["year", "season"]
    multi = F.when(F.col("tows") > 1, 1).otherwise(0)
    a = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_station_groups"), F.countDistinct("station").alias("n_stations"), F.sum("rows").alias("n_rows"),
        F.sum("tows").alias("n_unique_tows"), F.avg("tows").alias("mean_tows"), F.max("tows").alias("max_tows"), F.min("tows").alias("min_tows"),
        F.sum(multi).alias("n_multi"), F.sum(F.col("tows") - 1).alias("n_extra"))
    a = a.withColumn("pct_multi", 100.0 * F.col("n_multi") / F.col("n_station_groups"))
    a = null_safe_join(a, grouped_quantiles(d, keys, "tows", {"median_tows": 0.5}), keys)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("tows").desc(), "station", "rows"))
    top = d.where("tows > 1").withColumn("__r", rank).where(F.col("__r") <= max_list)
    names = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", F.format_string("%s (%d)", "station", "tows").alias("t")))).alias("__t"))
    a = null_safe_join(a, names, keys, "left")
    text = F.array_join(F.transform(F.coalesce("__t", F.array().cast("array<struct<__r:int,t:string>>")), lambda x: x.t), "; ")
    more = F.when(F.col("n_multi") > max_list, F.format_string("; ... +%d more", F.col("n_multi") - max_list)).otherwise("")
    return a.withColumn("stations_multi", F.concat(text, more)).drop("__t")


def sampling_crosstab(df: DataFrame, *, year: str = "year", month: str = "month", station: str = "station", night: Column) -> DataFrame:
    """Rows per year and month with totals, distinct stations and night share, and a total row."""
    d = df.withColumn("__n", night.cast("double")).withColumn("__y", F.explode(F.array(F.col(year).cast("string"), F.lit("Total"))))
    months = [F.count_if(F.col(month) == m).alias(f"m{m:02d}") for m in range(1, 13)]
    return d.groupBy(F.col("__y").alias("year")).agg(
        *months, F.count(F.lit(1)).alias("tows"), F.countDistinct(station).alias("stations"), (F.avg("__n") * 100).alias("night_pct"))


def attribute_counts(df: DataFrame, tow: str, attributes: Sequence[str]) -> DataFrame:
    """Distinct tows per value of each attribute."""
    rows = F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes]))
    return df.select(tow, rows).distinct().groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n_tows"))


def shares(df: DataFrame, keys: Sequence[str], within: Sequence[str], value: str, how: str = "sum") -> DataFrame:
    """Share of each key's sum (or mean) in the total of ``within``; the tables after grouping are small."""
    a = df.groupBy(*keys).agg((F.sum if how == "sum" else F.avg)(value).alias("level"))
    return a.withColumn("share", F.try_divide(F.col("level"), F.sum("level").over(W.partitionBy(*within))))


def top_n_other(df: DataFrame, *, name: str, keys: Sequence[str], value: str, n: int = 4, other: str = "Other") -> DataFrame:
    """Sums by key with all but the n largest names (over everything) lumped together."""
    total = df.groupBy(name).agg(F.sum(value).alias("__t"))
    top = total.orderBy(F.col("__t").desc(), name).limit(n).select(name, F.lit(True).alias("__top"))
    s = df.groupBy(*keys, name).agg(F.sum(value).alias("__v"))
    j = s.join(top, name, "left")
    return j.groupBy(*keys, F.when(F.col("__top"), F.col(name)).otherwise(other).alias(name)).agg(F.sum("__v").alias(value))


def stations_with_min(df: DataFrame, station: str, min_tows: int, tow: str | None = None) -> DataFrame:
    n = F.countDistinct(tow) if tow else F.count(F.lit(1))
    return df.groupBy(station).agg(n.alias("n_tows")).where(F.col("n_tows") >= min_tows)


def most_sampled(df: DataFrame, station: str, n: int = 12) -> DataFrame:
    return df.groupBy(station).agg(F.count(F.lit(1)).alias("n_tows")).orderBy(F.col("n_tows").desc(), station).limit(n)


def class_group_sums(df: DataFrame, mapping: Mapping[str, Sequence[str]], *, sample: Sequence[str], cls: str, value: str, model: Sequence[str]) -> DataFrame:
    """Species to class to group sums per sample, with the sample's model values carried along."""
    items = [(c, g) for g, cs in mapping.items() for c in cs]
    table = F.create_map(*[F.lit(x) for kv in items for x in kv])
    d = df.withColumn("group", F.try_element_at(table, F.col(cls))).where("group IS NOT NULL")
    return d.groupBy(*sample, "group").agg(F.sum(value).alias("obs"), *[F.any_value(m).alias(m) for m in model])


def zero_filled_counts(df: DataFrame, keys: Sequence[str], axis: Mapping[str, Sequence], count_by: Sequence[str] = ()) -> DataFrame:
    """Counts with every axis value present."""
    c = df.groupBy(*keys, *axis).agg(F.count(F.lit(1)).alias("n"))
    return complete_axis(c, keys, dict(axis), {"n": 0})


def strata_rows(df: DataFrame, strata: Mapping[str, Column]) -> DataFrame:
    """Each row once per stratum definition (columns ``stratum`` and ``value_of``)."""
    return df.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(n).alias("stratum"), c.cast("string").alias("level")) for n, c in strata.items()]))).select(
        "*", "__s.stratum", "__s.level").drop("__s")


def per_tow_factor(df: DataFrame, tow: str, value: str, adjusted: Column) -> DataFrame:
    """Adjusted over raw sum per tow."""
    return df.groupBy(tow).agg(F.try_divide(F.sum(adjusted), F.sum(value)).alias("factor"))


def peak_and_amplitude(df: DataFrame, keys: Sequence[str], month: str, value: str) -> DataFrame:
    """Month of the largest monthly median and max minus min of the monthly medians."""
    m = grouped_quantiles(df, [*keys, month], value, {"__m": 0.5})
    return m.groupBy(*keys).agg(F.min_by(month, F.struct(-F.col("__m"), month)).alias("peak_month"), (F.max("__m") - F.min("__m")).alias("amplitude"))
