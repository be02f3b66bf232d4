"""Roles of the library bound to the given tables, as DataFrames and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .base import Tables

SEASON_SQL = ("CASE WHEN month({0}) IN (12,1,2) THEN 'Winter' WHEN month({0}) IN (3,4,5) THEN 'Spring' "
              "WHEN month({0}) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END")


def season_sql(col: str) -> str:
    return SEASON_SQL.format(col)


STEP_SQL = "least((dayofyear({0})-1)//3+1, 120)"


def paired(t: Tables) -> DataFrame:
    """Tow-level pairs: one row per line item, group = return flag."""
    d = F.col("l_shipdate").cast("date")
    return t.lineitem.select(
        F.col("l_orderkey").alias("tow"), d.alias("date"), F.year(d).alias("year"), F.month(d).alias("month"),
        cal.season(d).alias("season"), F.col("l_returnflag").alias("grp"),
        F.col("l_extendedprice").alias("obs"),
        (F.col("l_quantity") * 1500 + F.col("l_tax") * 200000).alias("model"),
    )


PAIRED = f"""paired AS (SELECT l_orderkey AS tow, CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS year,
  month(l_shipdate) AS month, {season_sql('l_shipdate')} AS season, l_returnflag AS grp, l_extendedprice AS obs,
  l_quantity * 1500 + l_tax * 200000 AS model FROM lineitem)"""


def cube(t: Tables) -> DataFrame:
    """Gridded field: 10 x 10 cells, 3-day steps, one value per (year, step, row, col)."""
    d = F.col("l_shipdate").cast("date")
    raw = t.lineitem.select(
        F.year(d).alias("year"), cal.model_step(d).alias("step"),
        (F.col("l_suppkey") % 10).cast("int").alias("row"), (F.col("l_partkey") % 10).cast("int").alias("col"),
        F.col("l_extendedprice").alias("v"), F.col("l_quantity").alias("q"),
    )
    return raw.groupBy("year", "step", "row", "col").agg(F.avg("v").alias("value"), F.avg("q").alias("value2"))


CUBE = f"""cube AS (SELECT year(l_shipdate) AS year, {STEP_SQL.format('l_shipdate')} AS step, l_suppkey % 10 AS row,
  l_partkey % 10 AS col, avg(l_extendedprice) AS value, avg(l_quantity) AS value2 FROM lineitem GROUP BY ALL)"""


def daily_obs(t: Tables) -> DataFrame:
    """Daily mean of the observation series."""
    return t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.avg("l_extendedprice").alias("obs"))


DAILY_OBS = "daily_obs AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS obs FROM lineitem GROUP BY 1)"


def model_series(t: Tables) -> DataFrame:
    """Model series thinned to the 3-day calendar: mean order total per step, dated at the step centre."""
    d = F.col("o_orderdate").cast("date")
    s = t.orders.groupBy(F.year(d).alias("year"), cal.model_step(d).alias("step")).agg(
        F.avg("o_totalprice").alias("model"), F.sum("o_totalprice").alias("model_sum"))
    return s.withColumn("mdate", cal.step_date(F.col("year"), F.col("step")))


MODEL_SERIES = f"""model_raw AS (SELECT year(o_orderdate) AS year, {STEP_SQL.format('o_orderdate')} AS step,
    avg(o_totalprice) AS model, sum(o_totalprice) AS model_sum FROM orders GROUP BY 1, 2),
  model_series AS (SELECT *, make_date(year, 1, 1) + CAST(CASE WHEN step < 120 THEN step*3-1
    WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS mdate FROM model_raw)"""


def series_table(t: Tables) -> DataFrame:
    """Per-group 3-day series: mean line price by return flag and step, dated at the step centre."""
    d = F.col("l_shipdate").cast("date")
    s = t.lineitem.groupBy(F.col("l_returnflag").alias("grp"), F.year(d).alias("year"), cal.model_step(d).alias("step")).agg(
        F.avg("l_extendedprice").alias("v"))
    return s.withColumn("date", cal.step_date(F.col("year"), F.col("step")))


SERIES = f"""series_raw AS (SELECT l_returnflag AS grp, year(l_shipdate) AS year, {STEP_SQL.format('l_shipdate')} AS step,
    avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
  series AS (SELECT *, make_date(year, 1, 1) + CAST(CASE WHEN step < 120 THEN step*3-1
    WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS date FROM series_raw)"""


def grid(t: Tables) -> DataFrame:
    """Grid cells with coordinates from part keys; a cell is wet when its depth is positive."""
    k = F.col("p_partkey")
    return t.part.select(
        (k % 200).cast("int").alias("row"), (k % 190).cast("int").alias("col"),
        (F.lit(48.0) + (k % 200) / 100).alias("lat"), (F.lit(-125.0) + (k % 190) / 100).alias("lon"),
        ((F.col("p_size") - 10) * 4.0).alias("depth"), k.alias("cell_id"),
    )


GRID = """grid AS (SELECT p_partkey % 200 AS row, p_partkey % 190 AS col, 48.0::DOUBLE + (p_partkey % 200) / 100 AS lat,
  -125.0::DOUBLE + (p_partkey % 190) / 100 AS lon, (p_size - 10) * 4.0::DOUBLE AS depth, p_partkey AS cell_id FROM part)"""


def stations(t: Tables) -> DataFrame:
    """Station positions from customer keys, off the cell centres."""
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("station"), (F.lit(48.003) + ((k * 7) % 197) / 100).alias("lat"),
        (F.lit(-124.996) + ((k * 3) % 187) / 100).alias("lon"), F.col("c_acctbal").alias("v"),
        F.col("c_mktsegment").alias("segment"),
    )


STATIONS = """stations AS (SELECT c_custkey AS station, 48.003::DOUBLE + ((c_custkey * 7) % 197) / 100 AS lat,
  -124.996::DOUBLE + ((c_custkey * 3) % 187) / 100 AS lon, c_acctbal AS v, c_mktsegment AS segment FROM customer)"""

# Configured polygons (lat, lon): a triangle left open and two overlapping boxes.
DOMAINS = {
    "north": [(49.2, -125.0), (50.1, -124.0), (49.1, -123.4)],
    "mid": [(48.4, -124.8), (49.4, -124.8), (49.4, -123.9), (48.4, -123.9), (48.4, -124.8)],
    "south": [(48.0, -124.5), (48.8, -124.5), (48.8, -123.2), (48.0, -123.2)],
}


def edges_sql() -> str:
    rows = []
    for i, (name, ring) in enumerate(DOMAINS.items()):
        pts = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        rows += [f"({i}, '{name}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(pts[:-1], pts[1:])]
    return ("edges AS (SELECT ord, dom, CAST(y1 AS DOUBLE) y1, CAST(x1 AS DOUBLE) x1, CAST(y2 AS DOUBLE) y2, "
            "CAST(x2 AS DOUBLE) x2 FROM (VALUES " + ", ".join(rows) + ") v(ord, dom, y1, x1, y2, x2))")


def profiles(t: Tables) -> DataFrame:
    """Depth samples per order: 3 m steps down to 21 m, with duplicate depths."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("cast_id"), (F.col("l_linenumber") * 3.0).alias("depth"),
        F.col("l_quantity").alias("conc"), F.col("l_shipdate").cast("date").alias("date"))


PROFILES = """profiles AS (SELECT l_orderkey AS cast_id, l_linenumber * 3.0::DOUBLE AS depth, l_quantity AS conc,
  CAST(l_shipdate AS DATE) AS date FROM lineitem)"""
