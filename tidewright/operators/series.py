"""Ordered operators on calendar-grain series (one row per key and step)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import attach_one, null_safe_join, with_next
from .quantiles import grouped_quantiles


def step_changes(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Difference and percent change from the previous step."""
    w = W.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    return df.withColumns({"change": F.col(value) - prev, "pct_change": F.try_divide(F.col(value) - prev, prev) * 100})


def change_summary(changes: DataFrame, keys: Sequence[str], column: str = "change") -> DataFrame:
    """Median, 90 % quantile and maximum of absolute changes."""
    d = changes.withColumn("__a", F.abs(column)).where("__a IS NOT NULL")
    q = grouped_quantiles(d, keys, "__a", {"median": 0.5, "p90": 0.9})
    m = d.groupBy(*keys).agg(F.max("__a").alias("max"), F.count(F.lit(1)).alias("n"))
    return null_safe_join(m, q, list(keys)) if keys else attach_one(m, q)


def detrended(df: DataFrame, keys: Sequence[str], x: str, values: Sequence[str]) -> DataFrame:
    """Residuals from a straight line in x per key, for yearly series."""
    w = W.partitionBy(*keys)
    out = {}
    for v in values:
        xs = F.when(F.col(v).isNotNull(), F.col(x))
        slope = F.try_divide(F.covar_pop(v, x).over(w), F.var_pop(xs).over(w))
        out[f"{v}_detrended"] = F.col(v) - F.avg(v).over(w) - slope * (F.col(x) - F.avg(xs).over(w))
    return df.withColumns(out)


def first_differences(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{v}_diff": F.col(v) - F.lag(v).over(w) for v in values})


def lagged_index(df: DataFrame, year: str, value: str, lag: int = 1) -> DataFrame:
    """Yearly mean of an index and the same value ``lag`` years earlier (by calendar year, not by row)."""
    y = df.groupBy(year).agg(F.avg(value).alias("index"))
    past = y.select((F.col(year) + lag).alias(year), F.col("index").alias("lagged"))
    return y.join(past, year, "left")


def first_records(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Record at the earliest time of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(order, *columns), order).alias("__f")).select(*keys, "__f.*")


__all__ = ["step_changes", "change_summary", "detrended", "first_differences", "lagged_index", "first_records", "with_next"]
