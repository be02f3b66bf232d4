"""Block means and calendar matching on unbounded observation tables.

Both are the batch operators in incremental form: the block mean keeps one running aggregate per open window and
key, and matching to the regular calendar needs no state at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import nearest_step


def windowed_means(stream: DataFrame, keys: Sequence[str], ts: str, value: str, *, window: str = "1 day", lateness: str = "3 days") -> DataFrame:
    """Mean and count per key and tumbling window; rows later than ``lateness`` are dropped with their window."""
    w = stream.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"), *keys)
    return w.agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, value, "n")


def match_calendar(stream: DataFrame, date: str, series: DataFrame, values: Sequence[str], tolerance_days: int | None = None) -> DataFrame:
    """Attach the values of a complete 3-day series (year, step, ...) at the step nearest to each row's day."""
    d = stream.withColumn("__s", nearest_step(F.col(date)))
    if tolerance_days is not None:
        d = d.withColumn("__s", F.when(F.col("__s.gap") <= tolerance_days, F.col("__s")))
    d = d.withColumns({"year": F.col("__s.year"), "step": F.col("__s.step")}).drop("__s")
    return d.join(series.select("year", "step", *values), ["year", "step"], "left")
