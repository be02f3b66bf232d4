"""Nitrogen budget and climatology bands on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import joins as J
from ..operators import nutrient as N
from ..sources.grids import calendar_of
from .base import Tables, query, stage
from .bindings import CUBE, DAILY_OBS, MODEL_SERIES, cube, daily_obs, model_series, season_sql
from .matching import DAY_MEDIAN, MATCH_SQL, matched_pairs

BUD = f"""g AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, CAST(l_shipdate AS DATE) AS date, {season_sql('l_shipdate')} AS season,
    avg(CASE WHEN l_returnflag = 'A' THEN l_quantity - 20 END) AS ga, avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS gn, avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS gr FROM lineitem GROUP BY ALL),
  b AS (SELECT *, CASE WHEN ga IS NULL AND gn IS NULL AND gr IS NULL THEN NULL ELSE coalesce(greatest(ga, 0)*0.176, 0) + coalesce(greatest(gn, 0)*0.07, 0) + coalesce(greatest(gr, 0)*0.176, 0) END AS bound FROM g),
  i AS (SELECT avg(bound) AS bi FROM b WHERE date = (SELECT min(date) FROM b))"""


def budget_rows(t: Tables):
    d = F.col("l_shipdate").cast("date")

    def member(flag: str, shift: int = 0):
        return F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity") - shift))

    g = t.lineitem.groupBy(F.year(d).alias("year"), F.month(d).alias("month"), d.alias("date"), cal.season(d).alias("season")).agg(
        member("A", 20).alias("ga"), member("N").alias("gn"), member("R").alias("gr"))
    return g.withColumn("bound", N.bound_nitrogen(["ga", "gn", "gr"], {"gn": 0.07}))


@query("nitrogen_budget", "date:d bound:f6 free_n:f6 free_n_used:f6", f"""{BUD},
  final AS (SELECT date, bound, greatest(0, 5.0 + bi - bound) AS free_n, greatest(0, 5.0 + bi - bound) * CASE month WHEN 1 THEN 1.37 WHEN 2 THEN 1.36 WHEN 3 THEN 1.28 WHEN 4 THEN 1.0 WHEN 5 THEN 0.65 WHEN 6 THEN 0.55
    WHEN 7 THEN 0.53 WHEN 8 THEN 0.47 WHEN 9 THEN 0.75 WHEN 10 THEN 0.95 WHEN 11 THEN 1.4 ELSE 1.55 END AS free_n_used FROM b, i)""", covers="NUT-01 NUT-02 NUT-03 NUT-04 PRJ-08")
def nitrogen_budget(t: Tables):
    b = budget_rows(t)
    a = N.first_step_bound(b, "date", "bound")
    return N.close_budget(b, "bound", a, free_init=5.0, total_ref=0.0, multiplier=N.flux_multiplier("monthly", F.col("month")))


@query("nitrogen_budget_total", "date:d free_n:f6 free_n_used:f6", f"""{BUD},
  final AS (SELECT date, greatest(0, greatest(0, 14.0 - bi) + bi - bound) AS free_n, greatest(0, (greatest(0, 14.0 - bi) + bi) * CASE season WHEN 'Winter' THEN 1.0 WHEN 'Spring' THEN 0.8 WHEN 'Summer' THEN 0.6 ELSE 0.9 END - bound) AS free_n_used FROM b, i)""",
       covers="NUT-02 NUT-03 NUT-04")
def nitrogen_budget_total(t: Tables):
    b = budget_rows(t)
    a = N.first_step_bound(b, "date", "bound")
    return N.close_budget(b, "bound", a, free_init=0.0, total_ref=14.0, free_mode="preserve_total", apply="scale_total",
                          multiplier=N.flux_multiplier("seasonal", F.col("season")))


@query("first_cell_records", "bound_init:f6 n:i", f"""{CUBE}, f AS (SELECT row, col, arg_min(value2, year*1000+step) AS b FROM cube GROUP BY 1, 2), final AS (SELECT avg(b)*0.176 AS bound_init, count(*) AS n FROM f)""", covers="WIN-06 NUT-02")
def first_cell_records(t: Tables):
    c = cube(t).withColumns({"tt": F.col("year") * 1000 + F.col("step"), "b": F.col("value2") * N.C_TO_N_LIVING})
    n = c.select("row", "col").distinct().agg(F.count(F.lit(1)).alias("n"))
    return N.first_step_bound(c, "tt", "b", cell=["row", "col"]).crossJoin(n)


@query("relative_detritus", "date:d step_no:i detritus_n:f6", f"""{BUD}, r AS (SELECT o_custkey % 2000 AS step_no, avg(o_totalprice)/1e6 - 0.2 AS rel FROM orders GROUP BY 1),
  s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS step_no FROM b), final AS (SELECT date, step_no, 1.5*(1 + coalesce(rel, 0))*0.07 AS detritus_n FROM s LEFT JOIN r USING (step_no))""", covers="NUT-05")
def relative_detritus(t: Tables):
    r = t.orders.groupBy((F.col("o_custkey") % 2000).alias("step_no")).agg((F.avg("o_totalprice") / 1e6 - 0.2).alias("rel"))
    return N.relative_detritus(budget_rows(t).select("date"), r, "date", 1.5, 0.07)


@query("redfield_free", "year:i step:i total_c:f4 bound:f6 free:f6", f"""{CUBE}, s AS (SELECT year, step, avg(value2 + value/1000) AS total_c FROM cube GROUP BY 1, 2),
  final AS (SELECT year, step, total_c, total_c/(106.0/16.0) AS bound, greatest(0, 12.0 - total_c/(106.0/16.0)) AS free FROM s)""", covers="NUT-06")
def redfield_free(t: Tables):
    from ..operators.grid import region_series

    s = region_series(cube(t), {"total_c": [F.col("value2"), F.col("value") / 1000]}, where=F.lit(True), reducer="mean")
    bound, free = N.redfield_free(F.col("total_c"), 12.0)
    return s.withColumns({"bound": bound, "free": free})


@query("biweekly_climatology_band", "biweek:i obs_center:f4 obs_q10:f4 obs_q90:f4 obs_years:i model_center:f4 model_q10:f4 model_q90:f4", f"""{DAY_MEDIAN}, {MODEL_SERIES}, {MATCH_SQL},
  final AS (SELECT biweek, avg(obs) AS obs_center, quantile_cont(obs, 0.1) AS obs_q10, quantile_cont(obs, 0.9) AS obs_q90, count(obs) AS obs_years, avg(model) AS model_center, quantile_cont(model, 0.1) AS model_q10, quantile_cont(model, 0.9) AS model_q90 FROM pairs GROUP BY 1)""",
       covers="NUT-07 NUT-08 AGG-24 AGG-16")
def biweekly_climatology_band(t: Tables):
    return N.climatology_band(matched_pairs(t), "biweek", ["obs", "model"])


OBSBW = f"{DAILY_OBS}, yb AS (SELECT year(date) AS year, least((dayofyear(date)-1)//14+1, 26) AS biweek, median(obs) AS obs FROM daily_obs GROUP BY 1, 2)"


def year_bins(t: Tables):
    d = daily_obs(t).groupBy(F.year("date").alias("year"), cal.biweek(F.col("date"), 26).alias("biweek"))
    return d.agg(F.median("obs").alias("obs"))


@query("climatology_full_axis", "biweek:i obs_center:f4 obs_q10:f4 obs_q90:f4", f"""{OBSBW}, y AS (SELECT * FROM yb WHERE year >= 1996 AND year < 2001),
  c AS (SELECT biweek, median(obs) AS obs_center, quantile_cont(obs, 0.1) AS obs_q10, quantile_cont(obs, 0.9) AS obs_q90 FROM y GROUP BY 1),
  final AS (SELECT b AS biweek, obs_center, obs_q10, obs_q90 FROM range(1, 28) r(b) LEFT JOIN c ON b = biweek)""", covers="NUT-08 CAL-12 PRJ-02 CAL-04")
def climatology_full_axis(t: Tables):
    y = year_bins(t).where("year >= 1996 AND year < 2001")
    c = N.climatology_band(y, "biweek", ["obs"], centre="median").withColumn("k", F.lit(1))
    return J.complete_axis(c, ["k"], {"biweek": list(range(1, 28))})


@query("annual_from_climatology", "annual_mean:f4 winter_mean:f4", f"""{OBSBW}, c AS (SELECT biweek, avg(obs) AS v FROM yb GROUP BY 1),
  final AS (SELECT avg(v) AS annual_mean, avg(v) FILTER (biweek IN (1, 2, 3, 4, 25, 26)) AS winter_mean FROM c)""", covers="NUT-11 NUT-08")
def annual_from_climatology(t: Tables):
    c = year_bins(t).groupBy("biweek").agg(F.avg("obs").alias("v"))
    return N.annual_from_climatology(c, "biweek", "v", [1, 2, 3, 4, 25, 26])


@query("box_at_biweeks", "year:i biweek:i row:i col:i step:i value:f4", f"""{CUBE},
  yr AS (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM cube),
  bm AS (SELECT y AS year, b AS biweek, make_date(y, 1, 1) + CAST((b-1)*14 + 6 AS INTEGER) AS date FROM yr, range(1, 27) c(b)),
  st AS (SELECT y AS year, s AS step, make_date(y, 1, 1) + CAST(CASE WHEN s < 120 THEN s*3-1 WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS mdate FROM yr, range(1, 121) b(s)),
  nr AS (SELECT bm.year, bm.biweek, st.year AS myear, st.step FROM bm, st QUALIFY row_number() OVER (PARTITION BY bm.year, bm.biweek ORDER BY abs(date_diff('day', bm.date, mdate)), mdate) = 1),
  cells AS (SELECT r AS row, c AS col FROM range(2, 7) a(r), range(1, 8) b(c) WHERE (r-2) % 2 = 0 AND (c-1) % 2 = 0),
  final AS (SELECT nr.year, biweek, cells.row, cells.col, nr.step, value FROM nr CROSS JOIN cells LEFT JOIN cube ON cube.year = nr.myear AND cube.step = nr.step AND cube.row = cells.row AND cube.col = cells.col)""", covers="NUT-09 JOI-02 JOI-09")
def box_at_biweeks(t: Tables):
    field = stage(cube(t))
    calendar = calendar_of(field)
    mid = calendar.where("step <= 26").select("year", F.col("step").alias("biweek"))
    mid = mid.withColumn("t", cal.days(F.date_add(F.make_date("year", F.lit(1), F.lit(1)), (F.col("biweek") - 1) * 14 + 6)))
    steps = calendar.select(F.col("year").alias("myear"), "step", cal.days(cal.step_date(F.col("year"), F.col("step"))).alias("mt"))
    near = J.asof_nearest(mid, steps, obs_t="t", model_t="mt", values=["myear", "step"], bucket_width=366)
    cells = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(6), F.lit(2)), lambda r: F.transform(
        F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda c: F.struct(r.alias("row"), c.alias("col")))))
    want = near.select("year", "biweek", "myear", "step", F.inline(cells))
    c = field.select(F.col("year").alias("myear"), "step", "row", "col", "value")
    return want.join(c, ["myear", "step", "row", "col"], "left")


@query("unit_conversion", "p_type:s raw:f4 converted:f4", """
  f AS (SELECT 'ECONOMY' AS p_type, 0.4 AS factor UNION ALL SELECT 'SMALL', 0.45 UNION ALL SELECT 'PROMO', 0.1),
  final AS (SELECT p_type, sum(p_retailprice) AS raw, sum(p_retailprice * coalesce(factor, 0.176)) AS converted FROM part LEFT JOIN f USING (p_type) GROUP BY 1)""", covers="PRJ-07")
def unit_conversion(t: Tables):
    f = t.spark.createDataFrame([("ECONOMY", 0.4), ("SMALL", 0.45), ("PROMO", 0.1)], "p_type string, factor double")
    c = N.convert_by_group(t.part, f, "p_type", "p_retailprice", 0.176, "converted")
    return c.groupBy("p_type").agg(F.sum("p_retailprice").alias("raw"), F.sum("converted").alias("converted"))
