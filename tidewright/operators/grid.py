"""Reductions of gridded fields over cells and over time blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import row_sum
from .quantiles import grouped_medians


def box_series(cube: DataFrame, values: Sequence[str], row_range: tuple[int, int], col_range: tuple[int, int],
               time: Sequence[str] = ("year", "step"), reducer: str = "mean") -> DataFrame:
    """Per-time mean or median over the cells of an index box, many variables in one pass."""
    b = cube.where(F.col("row").between(*row_range) & F.col("col").between(*col_range))
    return spatial_reduce(b, values, time, reducer)


def spatial_reduce(field: DataFrame, values: Sequence[str], time: Sequence[str], reducer: str = "mean") -> DataFrame:
    """Mean or median over cells per time step."""
    if reducer == "mean":
        return field.groupBy(*time).agg(*[F.avg(v).alias(v) for v in values])
    return grouped_medians(field, time, values)


def region_series(cube: DataFrame, sums: dict[str, Sequence[Column]], *, where: Column, time: Sequence[str] = ("year", "step"),
                  reducer: str = "median") -> DataFrame:
    """Sum member variables per cell, then reduce over the region's cells."""
    f = cube.where(where).select(*time, *[row_sum(list(cols)).alias(n) for n, cols in sums.items()])
    return spatial_reduce(f, list(sums), time, reducer)


def block_reduce(df: DataFrame, keys: Sequence[str], value: str, *, how: str = "mean") -> DataFrame:
    """Reduce finer steps to blocks whose number is already a key column."""
    fn = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    return df.groupBy(*keys).agg(fn(value).alias(value))


def window_index(field: DataFrame, weights: DataFrame, *, keys: Sequence[str], cell: Sequence[str], value: str, weight: str,
                 out: str = "index", offset: float = 1e-6) -> DataFrame:
    """log10 of the weighted mean over sampled cells of each cell's mean in the window (season and year)."""
    cells = field.groupBy(*keys, *cell).agg(F.avg(value).alias("__v"))
    j = cells.join(weights, list(cell))
    mean = F.try_divide(F.sum(F.col(weight) * F.col("__v")), F.sum(weight))
    return j.groupBy(*keys).agg(F.log10(mean + offset).alias(out))


def period_multipliers(df: DataFrame, keys: Sequence[str], value: str, date: str, *, first: tuple[str, str], spinup: tuple[str, str],
                       full: tuple[str, str]) -> DataFrame:
    """Initial, spin-up and full-run means with their ratios to the initial value, in one pass."""
    def mean(span: tuple[str, str]) -> Column:
        return F.avg(F.when(F.col(date).between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date")), F.col(value)))

    a = df.groupBy(*keys).agg(mean(first).alias("initial"), mean(spinup).alias("spinup_mean"), mean(full).alias("full_mean"))
    return a.withColumns({"spinup_mult": F.try_divide("spinup_mean", "initial"), "full_mult": F.try_divide("full_mean", "initial")})


def daily_blocks(df: DataFrame, keys: Sequence[str], date: str, value: str, *, days_used: int = 3, last_step: int = 120, how: str = "mean") -> DataFrame:
    """Daily rows to 3-day steps. With ``days_used`` 2 only the first two days of a block count; the pooled last
    block always takes all its days."""
    from ..functions.calendar import model_step

    offset = (F.dayofyear(date) - 1) % 3
    tail = F.dayofyear(date) > 3 * (last_step - 1)
    d = df.where((offset < days_used) | tail)
    d = d.withColumns({"year": F.year(date), "step": model_step(F.col(date), last_step)})
    return block_reduce(d, [*keys, "year", "step"], value, how=how)


def chained_means(df: DataFrame, keys: Sequence[str], ts: str, value: str, units: Sequence[str]) -> DataFrame:
    """Means of means over finer to coarser calendar units; ``n`` counts the finer units in the last one."""
    d = df
    for unit in units:
        d = d.groupBy(*keys, F.date_trunc(unit, ts).alias(ts)).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))
    return d
