"""Agreement between observed and modelled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import fisher_bound, line_intercept, line_slope, pearson, pearson_p
from .joins import with_group_stats

# Column sets of the different reports.
SKILL_SETS: dict[str, list[str]] = {
    "paired": ["n", "bias", "obs_std", "model_std", "mae", "rmse", "r", "wss"],
    "classic": ["n", "bias", "mae", "rmse", "nrmse", "r", "r2", "mape", "nse", "wss"],
    "timing": ["n", "mse", "rmse", "mae", "bias", "r", "wss_floor", "obs_std_pop", "model_std_pop"],
    "centred": ["n", "r", "obs_std_pop", "model_std_pop", "crmse", "rmse", "bias", "mae", "wss"],
    "compact": ["obs_std_pop", "model_std_pop", "r", "rmse", "bias", "wss"],
}


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def skill(df: DataFrame, keys: Sequence[str], obs: str, model: str, *, which: str | Sequence[str] = "classic",
          standardised: bool = False, min_pairs: int = 1, summary: bool = False) -> DataFrame:
    """Skill measures per group over rows where both values are present.

    ``standardised`` data (logs, anomalies) report NRMSE = RMSE. The Willmott denominator needs the observed
    mean first, so the mean is aggregated and joined back; everything else comes from one more aggregate.
    ``summary`` says that the rows are yearly or seasonal summaries, few per key: a window then gives the mean.
    """
    keys = list(keys)
    pairs = df.where(F.col(obs).isNotNull() & F.col(model).isNotNull())
    pairs = pairs.select(*keys, F.col(obs).cast("double").alias("__o"), F.col(model).cast("double").alias("__m"))
    if summary:
        pairs = pairs.withColumn("__mean", F.avg("__o").over(W.partitionBy(*keys)))
    else:
        pairs = with_group_stats(pairs, keys, ["__o", "__m"], __mean=F.avg("__o"))
    o, m, d = F.col("__o"), F.col("__m"), F.col("__m") - F.col("__o")
    spread = F.abs(m - F.col("__mean")) + F.abs(o - F.col("__mean"))
    agg = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d * d).alias("mse"),
        F.stddev_pop(d).alias("crmse"),
        F.avg(o).alias("__om"),
        F.sum(d * d).alias("__sse"),
        F.sum(spread * spread).alias("__wd"),
        F.var_pop(o).alias("__ov"),
        finite(F.stddev_samp(o)).alias("obs_std"),
        finite(F.stddev_samp(m)).alias("model_std"),
        F.stddev_pop(o).alias("obs_std_pop"),
        F.stddev_pop(m).alias("model_std_pop"),
        finite(pearson(m, o)).alias("r"),
        F.bool_and(o != 0).alias("__nonzero"),
        F.avg(F.abs(F.try_divide(d, o))).alias("__ape"),
    ).where(F.col("n") >= min_pairs)
    rmse = F.sqrt("mse")
    out = agg.withColumns({
        "rmse": rmse,
        "nrmse": rmse if standardised else F.try_divide(rmse, F.col("__om")),
        "r2": F.col("r") * F.col("r"),
        "mape": F.when(F.col("__nonzero"), F.col("__ape") * 100),
        "nse": 1 - F.try_divide(F.col("__sse"), F.col("__ov") * F.col("n")),
        "wss": 1 - F.try_divide("__sse", "__wd"),
    }).withColumn("wss_floor", F.when(F.col("wss").isNotNull(), F.greatest(F.col("wss"), F.lit(0.0))))
    return out.select(*keys, *(SKILL_SETS[which] if isinstance(which, str) else which))


def with_overall(df: DataFrame, col: str, label: str = "All") -> DataFrame:
    """Each row once under its own value and once under ``label`` (grouping sets with a shared second pass)."""
    return df.withColumn(col, F.explode(F.array(F.col(col), F.lit(label))))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, min_pairs: int = 5, z: float = 1.96) -> DataFrame:
    """r with Fisher interval, two-sided p and pair count; r is NULL below ``min_pairs``."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(*keys).agg(finite(pearson(x, y)).alias("r"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("r", F.when(F.col("n") >= min_pairs, F.col("r")))
    return out.withColumns({
        "lo": fisher_bound(F.col("r"), F.col("n"), -1, z),
        "hi": fisher_bound(F.col("r"), F.col("n"), 1, z),
        "p": pearson_p(F.col("r"), F.col("n")),
    })


def yearly_links(series: DataFrame, links: Sequence[tuple[str, str, str]], offsets: Sequence[int] = (0,), *, source: str = "source",
                 year: str = "year", value: str = "v", min_pairs: int = 5) -> DataFrame:
    """Correlations between pairs of yearly series of one long table (source, year, value), a row per link and offset.

    ``links`` is configuration: (comparison, first source, second source). With offset 1 a year of the first source meets the year
    after it in the second. Years that one side lacks, or where it is NULL, are left out. Each value is sent once to every link side
    that reads its source and the two sides meet by grouping, so the series are shuffled once and nothing is joined. A link without
    any common year has no row.
    """
    sides = F.array(*[
        F.struct(F.lit(label).alias("comparison"), F.lit(o).alias("offset"), F.lit(s).alias("s"), F.lit(side).alias("side"),
                 F.lit(o if side == "a" else 0).alias("shift"))
        for label, first, second in links for o in offsets for s, side in ((first, "a"), (second, "b"))])
    d = series.withColumn("__l", F.explode(F.filter(sides, lambda x: x["s"] == F.col(source))))
    d = d.groupBy("__l.comparison", "__l.offset", (F.col(year) + F.col("__l.shift")).alias("__year")).agg(
        *[F.avg(F.when(F.col("__l.side") == side, F.col(value))).alias(f"__{side}") for side in "ab"])
    return correlation(d, ["comparison", "offset"], "__a", "__b", min_pairs)


def weighted_corr(x: str, y: str, w: str) -> Column:
    """Weighted Pearson r from sums."""
    x_, y_, w_ = F.col(x), F.col(y), F.col(w)
    sw, sx, sy = F.sum(w_), F.sum(w_ * x_), F.sum(w_ * y_)
    cov = F.try_divide(F.sum(w_ * x_ * y_), sw) - F.try_divide(sx * sy, sw * sw)
    vx = F.try_divide(F.sum(w_ * x_ * x_), sw) - F.try_divide(sx * sx, sw * sw)
    vy = F.try_divide(F.sum(w_ * y_ * y_), sw) - F.try_divide(sy * sy, sw * sw)
    return F.try_divide(cov, F.sqrt(vx * vy))


def best_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line y = slope x + intercept with r2; needs two pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        finite(line_slope(y, x)).alias("slope"),
        finite(line_intercept(y, x)).alias("intercept"),
        (pearson(y, x) * pearson(y, x)).alias("r2"),
    ).where("n >= 2")


def trend_per_decade(df: DataFrame, keys: Sequence[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """Linear trend per ten years inside a window of years."""
    d = df.where(F.col(year).between(first, last) & F.col(value).isNotNull())
    return d.groupBy(*keys).agg((finite(line_slope(value, year)) * 10).alias("trend"), F.count(F.lit(1)).alias("n"))


def export_order(df: DataFrame, season_order: Sequence[str], total: str = "Total") -> DataFrame:
    """Report order: seasons as configured, totals first, then by group."""
    rank = F.coalesce(*[F.when(F.col("season") == s, i) for i, s in enumerate(season_order)], F.lit(99))
    return df.orderBy(rank, F.when(F.col("group") == total, 0).otherwise(1), "group")


def manuscript_table(tables: Sequence[DataFrame], season_order: Sequence[str], decimals: int = 2) -> DataFrame:
    """Total rows of several skill tables, rounded, in season order."""
    cols = ["season", "group", "n", "r", "rmse", "mae", "wss"]
    out = None
    for t in tables:
        part = t.where(F.col("group") == "Total").select(*cols)
        out = part if out is None else out.unionByName(part)
    return export_order(out.withColumns({c: F.round(c, decimals) for c in cols[3:]}), season_order)


def supplement_table(table: DataFrame, season_order: Sequence[str], decimals: int = 2) -> DataFrame:
    """All groups of a skill table, rounded, totals first within each season."""
    nums = [c for c, t in table.dtypes if t == "double"]
    return export_order(table.withColumns({c: F.round(c, decimals) for c in nums}), season_order)
