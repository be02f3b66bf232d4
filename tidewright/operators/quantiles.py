"""Exact grouped quantiles whose memory does not grow with the group: radix selection on counts.

A number gets two codes that keep its order: the first follows its logarithm (1,024 ranges for each factor of e), the second
cuts such a range into 2^22 equal parts. Counts by the first code find the ranges that hold a wanted rank; inside them counts
by the second code; inside those the values themselves, at most 2^21 different doubles. Every count is combined before its
shuffle, only ranges that hold a wanted rank go on, and no window orders more rows than there are codes, however many rows
and distinct values a group has. (Numbers below 1e-307 in size share one range, whose parts may hold more.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import null_safe_join, salted_join

STEPS = 1024  # ranges of the first code for each factor of e
PARTS = 1 << 22  # parts of a range
LEAST, SHIFT = -708 * STEPS, 709 * STEPS  # smallest logarithm, and what makes all of them positive


def order_codes(v: Column) -> tuple[Column, Column]:
    """Two longs that order like the double ``v``, the second among equals of the first; equal codes say nothing.

    Logarithm, quotient by a number fixed for the range, and floor never fall as the number grows, so the order holds whatever they
    round. Both zeros are one, infinities lie outside and NaN is the largest, as Spark orders it.
    """
    a = F.abs(v)
    plain = (a > 0) & (a < float("inf"))
    k = F.greatest(F.floor(F.ln(F.when(plain, a)) * STEPS), F.lit(LEAST))
    size = F.when(a == float("inf"), 3 * SHIFT).otherwise(F.coalesce(k + SHIFT, F.lit(0)))
    part = F.coalesce(F.floor((a * F.exp(-k / STEPS) - 1) * (STEPS * PARTS)).cast("long"), F.lit(0))
    first = F.when(F.isnan(v), 4 * SHIFT).when(v < 0, -size).otherwise(size)
    return first.cast("long"), F.when(v < 0, -part).otherwise(part)


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], few_groups: bool = False) -> DataFrame:
    """Exact quantiles (linear interpolation) per group, as one column per entry of ``probs``; nulls do not count.

    ``df`` is read once: its distinct values with their counts are shuffled once and used by all levels. ``few_groups`` says
    that the groups are bounded by configuration or a calendar: then the rows are read twice and only counts by the first code
    and the rows of the ranges that hold a rank are shuffled, which is less work where nearly every value is different.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    one, two = order_codes(F.col("__v"))
    if few_groups:
        vals = src.select(*keys, "__v", F.lit(1).cast("long").alias("__c"), one.alias("__b1"), two.alias("__b2"))
    else:
        vals = src.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")).select(*keys, "__v", "__c", one.alias("__b1"), two.alias("__b2"))

    def at(p: float, fn) -> Column:
        return fn(F.lit(p) * (F.col("__n") - 1)).cast("long")

    def holds(rank: Column) -> Column:
        return (rank >= F.col("__below")) & (rank < F.col("__below") + F.col("__own"))

    def wanted() -> Column:
        found = [holds(at(p, fn)) for p in probs.values() for fn in (F.floor, F.ceil)]
        out = found[0]
        for f in found[1:]:
            out = out | f
        return out

    whole = W.partitionBy(*keys)
    first = vals.groupBy(*keys, "__b1").agg(F.sum("__c").alias("__own"))
    first = first.withColumns({"__n": F.sum("__own").over(whole), "__below": F.sum("__own").over(whole.orderBy("__b1")) - F.col("__own")})
    first = first.where(wanted()).select(*keys, "__b1", "__n", F.col("__below").alias("__base"))
    if few_groups:
        # At most two rows for each group and probability.
        cand = null_safe_join(vals, F.broadcast(first), [*keys, "__b1"])
        cand = cand.groupBy(*keys, "__b1", "__b2", "__v", "__n", "__base").agg(F.sum("__c").alias("__c"))
    else:
        cand = salted_join(vals, first, [*keys, "__b1"], ["__v"])

    inside = W.partitionBy(*keys, "__b1").orderBy("__b2")
    # The values of a part travel along, at most 2^21 of them, so that the few parts that hold a rank need no join.
    second = cand.groupBy(*keys, "__b1", "__b2").agg(
        F.sum("__c").alias("__own"), F.first("__n").alias("__n"), F.first("__base").alias("__base"), F.collect_list(F.struct("__v", "__c")).alias("__held"))
    second = second.withColumn("__below", F.col("__base") + F.sum("__own").over(inside) - F.col("__own")).where(wanted())
    last = second.select(*keys, "__b1", "__b2", "__n", F.col("__below").alias("__start"), F.inline("__held"))

    ordered = W.partitionBy(*keys, "__b1", "__b2").orderBy("__v")
    last = last.withColumns({"__own": F.col("__c"), "__below": F.col("__start") + F.sum("__c").over(ordered) - F.col("__c")}).where(wanted())
    out = []
    for name, p in probs.items():
        low, high = (F.max(F.when(holds(at(p, fn)), F.col("__v"))) for fn in (F.floor, F.ceil))
        pos = F.lit(p) * (F.max("__n") - 1)
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return last.groupBy(*keys).agg(*out)


def grouped_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Exact medians of several columns in one pass, under their own names."""
    rows = F.inline(F.array(*[F.struct(F.lit(v).alias("__var"), F.col(v).cast("double").alias("__x")) for v in values]))
    q = grouped_quantiles(df.select(*keys, rows), [*keys, "__var"], "__x", {"__m": 0.5})
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("__var") == v, F.col("__m"))).alias(v) for v in values])


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return grouped_quantiles(df, keys, value, {name: 0.5})


def median_timestamp(df: DataFrame, keys: Sequence[str], ts: str, name: str = "median_ts") -> DataFrame:
    """Median time of a group, at microsecond resolution."""
    d = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp")) - F.lit(1_500_000_000_000_000))
    q = grouped_quantiles(d, keys, "__us", {name: 0.5})
    return q.withColumn(name, F.timestamp_micros(F.floor(name).cast("long") + F.lit(1_500_000_000_000_000)))


def modes_by_count(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent text of each column per key (smallest on ties), from counts: no value map in one task."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).cast("string").alias("__v")) for c in columns]))
    n = df.select(*keys, rows).where("__v IS NOT NULL").groupBy(*keys, "__col", "__v").agg(F.count(F.lit(1)).alias("__c"))
    best = [F.min(F.when(F.col("__col") == c, F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v")))).getField("v").alias(c) for c in columns]
    return n.groupBy(*keys).agg(*best)
