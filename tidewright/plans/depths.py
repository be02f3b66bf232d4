"""Depth profiles and model columns on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import depth as D
from .base import Tables, query
from .bindings import PROFILES, profiles

SEG = """pd AS (SELECT {k}, depth AS z, avg(conc) AS c FROM {src} GROUP BY ALL),
  sg AS (SELECT *, lead(z) OVER w AS nz, lead(c) OVER w AS nc FROM pd WINDOW w AS (PARTITION BY {k} ORDER BY z)),
  sa AS (SELECT *, CASE WHEN least(nz, {z2}) > greatest(z, {z1}) AND nz IS NOT NULL THEN (least(nz, {z2}) - greatest(z, {z1})) *
    ((c + (nc-c)/(nz-z)*(greatest(z, {z1})-z)) + (c + (nc-c)/(nz-z)*(least(nz, {z2})-z)))/2 END AS a FROM sg),
  pr AS (SELECT {k}, count(*) AS n_depths, min(z) AS min_depth, max(z) AS max_depth, arg_min(c, z) AS c1, arg_max(c, z) AS cn, coalesce(sum(a), 0) AS area, sum(a) AS area0 FROM sa GROUP BY ALL),
  pf AS (SELECT *, n_depths = 1 OR (greatest(0, min_depth-{z1}) > 0 AND greatest(0, min_depth-{z1}) <= {ps}) AS pad_surface,
    n_depths = 1 OR (greatest(0, {z2}-max_depth) > 0 AND greatest(0, {z2}-max_depth) <= {pd}) AS pad_deep,
    n_depths = 1 OR greatest(0, min_depth-{z1}) > {ps} AS extrap_surface, n_depths = 1 OR greatest(0, {z2}-max_depth) > {pd} AS extrap_deep,
    greatest(0, min_depth-{z1}) <= {ps} AND greatest(0, {z2}-max_depth) <= {pd} AS cov,
    CASE WHEN n_depths = 1 THEN c1*({z2}-{z1}) ELSE area + c1*greatest(0, least(min_depth, {z2})-{z1}) + cn*greatest(0, {z2}-greatest(max_depth, {z1})) END AS integral FROM pr)"""


@query("depth_integral", "cast_id:i n_depths:i min_depth:f2 max_depth:f2 pad_surface:b pad_deep:b extrap_surface:b extrap_deep:b integral:f4 average:f6",
       f"""{PROFILES}, {SEG.format(k='cast_id', src='profiles', z1='2.0', z2='20.0', ps='5.0', pd='8.0')},
       final AS (SELECT *, integral/18.0 AS average FROM pf WHERE n_depths = 1 OR cov)""", covers="DEP-01")
def depth_integral(t: Tables):
    return D.profile_integral(profiles(t), ["cast_id"], "depth", "conc", zmin=2, zmax=20, pad_surface=5, pad_deep=8)


@query("depth_integral_extrapolated", "cast_id:i extrap_surface:b extrap_deep:b integral:f4",
       f"""{PROFILES}, {SEG.format(k='cast_id', src='profiles', z1='4.5', z2='25.0', ps='1.0', pd='5.0')},
       final AS (SELECT * FROM pf WHERE n_depths > 1)""", covers="DEP-01")
def depth_integral_extrapolated(t: Tables):
    return D.profile_integral(profiles(t), ["cast_id"], "depth", "conc", zmin=4.5, zmax=25, pad_surface=1, pad_deep=5,
                              extrapolate=True, allow_single=False)


@query("depth_integral_sampled", "cast_id:i integral:f6", f"""{PROFILES}, {SEG.format(k='cast_id', src='profiles', z1='4.0', z2='17.0', ps='0', pd='0')},
       final AS (SELECT cast_id, area0 * 0.014 AS integral FROM pr)""", covers="DEP-03 PRJ-07")
def depth_integral_sampled(t: Tables):
    return D.profile_integral_sampled(profiles(t), ["cast_id"], "depth", "conc", zmin=4, zmax=17)


CASTS = f"""s AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 10 AS row, l_partkey % 10 AS col, CASE WHEN l_linenumber = 1 THEN 0.1 ELSE (l_linenumber - 1) * 3.0 END::DOUBLE AS depth, l_quantity AS conc FROM lineitem),
  {SEG.format(k='date, row, col', src='s', z1='0.1', z2='18.0', ps='6.0', pd='9.0')},
  casts AS (SELECT *, integral/17.9 AS average FROM pf WHERE (n_depths = 1 OR cov) AND n_depths >= 2 AND max_depth >= 9)"""


def bound_casts(t: Tables):
    from ..functions.clean import surface_depth

    s = t.lineitem.select(
        F.col("l_shipdate").cast("date").alias("date"), (F.col("l_suppkey") % 10).alias("row"), (F.col("l_partkey") % 10).alias("col"),
        surface_depth((F.col("l_linenumber") - 1) * 3.0).alias("depth"), F.col("l_quantity").alias("conc"))
    return D.casts(s, ["date", "row", "col"], "depth", "conc", zmin=0.1, zmax=18.0, pad_surface=6, pad_deep=9, min_depths=2, min_max_depth=9)


@query("casts_for_matching", "date:d row:i col:i year:i biweek:i n_depths:i g_n_m2:f6 umol_l:f4 frac_pad:f2",
       f"""{CASTS}, final AS (SELECT date, row, col, year(date) AS year, (dayofyear(date)-1)//14+1 AS biweek, n_depths, integral * 14.0067/1000 AS g_n_m2, average AS umol_l,
         (pad_surface::INT + pad_deep::INT)/2.0 AS frac_pad FROM casts)""", covers="DEP-02 DEP-04 PRJ-16 CAL-04")
def casts_for_matching(t: Tables):
    c = bound_casts(t)
    return c.withColumns({
        "year": F.year("date"), "biweek": cal.biweek(F.col("date")), "g_n_m2": F.col("integral") * D.G_N_PER_MMOL, "umol_l": F.col("average"),
        "frac_pad": (F.col("pad_surface").cast("int") + F.col("pad_deep").cast("int")) / 2.0})


@query("cast_pool", "year:i biweek:i row:i col:i n:i average:f6 mean_n_depths:f4 frac_pad_surface:f4 frac_pad_deep:f4",
       f"""{CASTS}, final AS (SELECT year(date) AS year, (dayofyear(date)-1)//14+1 AS biweek, row, col, count(*) AS n, median(average) AS average, avg(n_depths) AS mean_n_depths,
        avg(pad_surface::INT) AS frac_pad_surface, avg(pad_deep::INT) AS frac_pad_deep FROM casts GROUP BY 1, 2, 3, 4)""", covers="AGG-15 DEP-02 CAL-14")
def cast_pool(t: Tables):
    from ..operators.nutrient import pool_by

    c = bound_casts(t).withColumns({"year": F.year("date"), "biweek": cal.biweek(F.col("date"))})
    return pool_by(c, ["year", "biweek", "row", "col"], ["average"], how="median", counts=["n_depths"], flags=["pad_surface", "pad_deep"])


@query("cast_at_levels", "cast_id:i level:f1 value:f4", f"""{PROFILES}, d AS (SELECT * FROM profiles WHERE depth <= 18),
  pd AS (SELECT cast_id, depth AS z, avg(conc) AS c FROM d GROUP BY 1, 2), sg AS (SELECT *, lead(z) OVER w AS nz, lead(c) OVER w AS nc FROM pd WINDOW w AS (PARTITION BY cast_id ORDER BY z)),
  lv AS (SELECT unnest([1.0, 3.0, 5.0, 8.0, 12.5, 18.0]) AS level),
  final AS (SELECT cast_id, level, CASE WHEN level = z THEN c ELSE c + (level-z)/(nz-z)*(nc-c) END AS value FROM sg JOIN lv ON (level >= z AND level < nz) OR level = z)""", covers="DEP-11")
def cast_at_levels(t: Tables):
    return D.at_levels(profiles(t), ["cast_id"], "depth", "conc", [1.0, 3.0, 5.0, 8.0, 12.5, 18.0], max_depth=18)


FIELD = """f0 AS (SELECT year(l_shipdate) AS year, l_suppkey % 10 AS row, l_partkey % 10 AS col, l_linenumber AS level, avg(l_quantity) AS v0, avg(l_discount) AS q FROM lineitem GROUP BY ALL),
  f AS (SELECT year, row, col, level, level*3.0 + row*0.25 AS z, 2.0 + level*0.5 AS e, v0 AS v FROM f0 WHERE q >= 0.045)"""


def column_table(t: Tables):
    """Water columns per year and cell; levels of low quality are not water, so bottoms differ between columns."""
    f = t.lineitem.groupBy(
        F.year("l_shipdate").alias("year"), (F.col("l_suppkey") % 10).alias("row"), (F.col("l_partkey") % 10).alias("col"),
        F.col("l_linenumber").alias("level")).agg(F.avg("l_quantity").alias("v0"), F.avg("l_discount").alias("q"))
    f = f.withColumns({"z": F.col("level") * 3.0 + F.col("row") * 0.25, "e": 2.0 + F.col("level") * 0.5, "v": F.when(F.col("q") >= 0.045, F.col("v0"))})
    return D.columns(f, ["year", "row", "col"], level="level", depth="z", thickness="e", value="v")


LERP = """sg AS (SELECT *, lead(z) OVER w AS nz, lead(v) OVER w AS nv, row_number() OVER w AS i FROM f WINDOW w AS (PARTITION BY year, row, col ORDER BY z)),
  cc AS (SELECT year, row, col, count(*) AS n, min(z) AS z1, max(z) AS zn, arg_max(v, z) AS vb, sum(v*e)/sum(e) AS wavg FROM f GROUP BY ALL)"""


@query("column_interp", "year:i row:i col:i at_10:f4 mean_5_12:f4 below_8:f4", f"""{FIELD}, {LERP},
  gz AS (SELECT year, row, col, n, z1, zn, unnest(range(0, 60)) AS kk FROM cc),
  pts AS (SELECT *, 'a' AS kind, 10.0 AS zt FROM gz WHERE kk = 0 AND n >= 2 AND zn >= 10 AND z1 <= 10
   UNION ALL SELECT *, 'b', 5.0 + kk FROM gz WHERE kk <= 7 AND n >= 2 AND zn >= 12
   UNION ALL SELECT *, 'c', 8.0 + kk FROM gz WHERE n >= 2 AND zn >= 8 AND kk < ceil(zn + 1 - 8)),
  pv AS (SELECT p.year, p.row, p.col, kind, zt, arg_max(s.v + (zt - s.z)/(s.nz - s.z)*(s.nv - s.v), CASE WHEN s.z <= zt THEN s.i ELSE -s.i END) AS val
   FROM pts p JOIN sg s ON p.year = s.year AND p.row = s.row AND p.col = s.col AND s.nz IS NOT NULL GROUP BY ALL),
  final AS (SELECT c.year, c.row, c.col, avg(val) FILTER (kind = 'a') AS at_10, avg(val) FILTER (kind = 'b') AS mean_5_12, avg(val) FILTER (kind = 'c') AS below_8
   FROM cc c LEFT JOIN pv p ON c.year = p.year AND c.row = p.row AND c.col = p.col GROUP BY 1, 2, 3)""", covers="DEP-05 DEP-06 DEP-07")
def column_interp(t: Tables):
    return D.reduce_columns(column_table(t), {"at_10": D.value_at(10), "mean_5_12": D.mean_between(5, 12), "below_8": D.mean_below(8)})


@query("column_weighted", "year:i row:i col:i bottom:f4 whole:f4 levels_2_4:f4 z_6_15:f4 last_9:f4 below_top_8:f4 plain_1_3:f4", f"""{FIELD}, {LERP},
  r AS (SELECT *, sum(e) OVER (PARTITION BY year, row, col ORDER BY z DESC) AS up, sum(e) OVER (PARTITION BY year, row, col ORDER BY z) AS down, max(z) OVER (PARTITION BY year, row, col) AS zn, sum(e) OVER (PARTITION BY year, row, col) AS tot FROM f),
  q AS (SELECT *, coalesce(max(CASE WHEN z < zn THEN down END) OVER (PARTITION BY year, row, col), 0) AS upto FROM r),
  final AS (SELECT year, row, col, arg_max(v, z) AS bottom, sum(v*e)/sum(e) AS whole, sum(v*e) FILTER (level >= 2 AND level < 5)/sum(e) FILTER (level >= 2 AND level < 5) AS levels_2_4,
    sum(v*e) FILTER (z BETWEEN 6 AND 15)/sum(e) FILTER (z BETWEEN 6 AND 15) AS z_6_15,
    CASE WHEN any_value(tot) >= 9 THEN sum(v*e) FILTER (up - e < 9)/sum(e) FILTER (up - e < 9) ELSE arg_max(v, z) END AS last_9,
    CASE WHEN any_value(upto) >= 8 THEN sum(v*e) FILTER (down >= 8)/sum(e) FILTER (down >= 8) ELSE sum(v*e)/sum(e) END AS below_top_8,
    avg(v) FILTER (level >= 1 AND level < 4) AS plain_1_3 FROM q GROUP BY 1, 2, 3)""", covers="DEP-08 DEP-09 DEP-10")
def column_weighted(t: Tables):
    return D.reduce_columns(column_table(t), {
        "bottom": D.bottom_value(), "whole": D.weighted_mean(), "levels_2_4": D.weighted_mean(level_range=(2, 5)),
        "z_6_15": D.weighted_mean(depth_range=(6, 15)), "last_9": D.last_metres(9), "below_top_8": D.below_top(8), "plain_1_3": D.plain_mean((1, 4))})
