"""Nearest cells, polygons, boxes, masks and gridded reductions on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import clean as C
from ..functions import geo as G
from ..operators import grid as GR
from ..operators import joins as J
from ..operators import spatial as S
from .base import Tables, query, stage
from .bindings import CUBE, DOMAINS, GRID, STATIONS, cube, edges_sql, grid, stations

HAV = ("2*6367.0*asin(sqrt(least(1.0, pow(sin(radians(g.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(g.lat))"
       "*pow(sin(radians(g.lon-p.lon)/2),2))))")


@query("haversine", "station:i km:f6", f"{STATIONS}, g AS (SELECT 49.0 AS lat, -123.5 AS lon), final AS (SELECT station, {HAV} AS km FROM stations p, g)", covers="JOI-05")
def haversine(t: Tables):
    return stations(t).select("station", G.haversine_km(F.col("lon"), F.col("lat"), F.lit(-123.5), F.lit(49.0)).alias("km"))


@query("nearest_cell", "station:i row:f0 col:f0 dist_km:f4", f"""{GRID}, {STATIONS},
  gg AS (SELECT lat, lon, min(row * 100000 + col) AS rc FROM grid WHERE depth > 0 GROUP BY 1, 2),
  u AS (SELECT DISTINCT lat, lon FROM stations),
  c AS (SELECT p.lat, p.lon, g.rc, {HAV} AS d FROM u p JOIN gg g ON abs(g.lat-p.lat) < 0.02 AND abs(g.lon-p.lon) < 0.02),
  b AS (SELECT lat, lon, min((round(d, 9), rc)) AS m, min(d) AS d FROM c GROUP BY 1, 2),
  final AS (SELECT station, m[2] // 100000 AS row, m[2] % 100000 AS col, d AS dist_km FROM stations LEFT JOIN b USING (lat, lon))""", covers="JOI-04 JOI-05 PRJ-05")
def nearest_cell(t: Tables):
    return S.nearest_cell_in_box(stations(t), grid(t), lat="lat", lon="lon", glat="lat", glon="lon", cell=["row", "col"],
                                 dx=0.02, mask=F.col("depth") > 0)


PLANAR = """gg AS (SELECT lat, lon, min(row * 100000 + col) AS rc FROM grid GROUP BY 1, 2), u AS (SELECT DISTINCT lat, lon FROM stations),
  c AS (SELECT p.lat, p.lon, g.rc, sqrt(pow(g.lat-p.lat,2)+pow((g.lon-p.lon)*{k},2)) AS d FROM u p, gg g),
  b AS (SELECT lat, lon, min((round(d, 9), rc)) AS m, min(d) AS d FROM c GROUP BY 1, 2),
  f AS (SELECT station, m[2] // 100000 AS row, m[2] % 100000 AS col, d AS dist_deg FROM stations JOIN b USING (lat, lon))"""


@query("nearest_pixel_max", "station:i row:f0 col:f0 dist_deg:f6", f"""{GRID}, {STATIONS}, {PLANAR.format(k="cos(radians(49.5))")},
  final AS (SELECT station, CASE WHEN dist_deg*111.0 <= 1.2 THEN row END AS row, CASE WHEN dist_deg*111.0 <= 1.2 THEN col END AS col, CASE WHEN dist_deg*111.0 <= 1.2 THEN dist_deg END AS dist_deg FROM f)""", covers="JOI-06")
def nearest_pixel_max(t: Tables):
    import math

    return S.nearest_cell_planar(stations(t), grid(t), lat="lat", lon="lon", glat="lat", glon="lon", cell=["row", "col"],
                                 lon_scale=math.cos(math.radians(49.5)), max_km=1.2)


@query("nearest_cell_any", "station:i row:f0 col:f0 dist_deg:f6", f"""{GRID}, {STATIONS}, {PLANAR.format(k="cos(radians(p.lat))")},
  final AS (SELECT * FROM f)""", covers="JOI-07")
def nearest_cell_any(t: Tables):
    return S.nearest_cell_planar(stations(t), grid(t), lat="lat", lon="lon", glat="lat", glon="lon", cell=["row", "col"], lon_scale=None)


PIP = f"""{edges_sql()}, pt AS (SELECT DISTINCT lat, lon FROM stations),
  hit AS (SELECT lat, lon, ord, dom FROM pt, edges WHERE y1 <> y2 AND (y1 > lat) <> (y2 > lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1
    GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1),
  fd AS (SELECT lat, lon, arg_min(dom, ord) AS domain FROM hit GROUP BY 1, 2)"""


@query("point_in_polygon", "station:i domain:s", f"{STATIONS}, {PIP}, final AS (SELECT station, domain FROM stations LEFT JOIN fd USING (lat, lon))", covers="JOI-08")
def point_in_polygon(t: Tables):
    s = stations(t)
    return s.select("station", G.first_domain(F.col("lat"), F.col("lon"), DOMAINS).alias("domain"))


@query("domain_mask", "domain:s n_cells:i depth:f4", f"""{GRID}, stations AS (SELECT lat, lon FROM grid), {PIP},
  final AS (SELECT domain, count(*) AS n_cells, avg(depth) AS depth FROM grid JOIN fd USING (lat, lon) WHERE depth > 0 GROUP BY 1)""", covers="JOI-08 PRJ-05")
def domain_mask(t: Tables):
    g = grid(t).where("depth > 0").withColumn("domain", G.first_domain(F.col("lat"), F.col("lon"), DOMAINS))
    return g.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("depth").alias("depth"))


@query("land_or_plume_mask", "wet:b plume:b masked:b n:i", f"""{GRID}, stations AS (SELECT lat, lon FROM grid), {PIP},
  final AS (SELECT depth > 0 AS wet, domain = 'south' AND domain IS NOT NULL AS plume, NOT (depth > 0) OR (domain = 'south' AND domain IS NOT NULL) AS masked, count(*) AS n
   FROM grid LEFT JOIN fd USING (lat, lon) GROUP BY 1, 2, 3)""", covers="PRJ-05")
def land_or_plume_mask(t: Tables):
    dom = G.first_domain(F.col("lat"), F.col("lon"), DOMAINS)
    g = grid(t).withColumns({"wet": F.col("depth") > 0, "plume": F.coalesce(dom == "south", F.lit(False))})
    return g.withColumn("masked", ~F.col("wet") | F.col("plume")).groupBy("wet", "plume", "masked").agg(F.count(F.lit(1)).alias("n"))


@query("box_cells", "kind:s n:i", f"""{GRID},
  final AS (SELECT 'coords' AS kind, count(DISTINCT (row, col)) AS n FROM grid WHERE depth > 0 AND lat BETWEEN 48.5 AND 49.0 AND lon BETWEEN -124.6 AND -124.0
   UNION ALL SELECT 'strided', count(DISTINCT (row, col)) FROM grid WHERE row BETWEEN 10 AND 90 AND (row-10) % 4 = 0 AND col BETWEEN 5 AND 120 AND (col-5) % 4 = 0)""", covers="PRJ-06 SET-04")
def box_cells(t: Tables):
    a = S.box_cells(grid(t), lat="lat", lon="lon", lat_range=(48.5, 49.0), lon_range=(-124.6, -124.0), wet=F.col("depth") > 0)
    b = S.box_cells(grid(t), row_range=(10, 90), col_range=(5, 120), stride=4)
    n = F.count(F.lit(1)).alias("n")
    return a.agg(n).withColumn("kind", F.lit("coords")).unionByName(b.agg(n).withColumn("kind", F.lit("strided")))


@query("domain_mean", "year:i step:i mean_v:f4 median_v:f4 mean_q:f4", f"""{CUBE},
  final AS (SELECT year, step, avg(value) AS mean_v, median(value) AS median_v, avg(value2) AS mean_q FROM cube GROUP BY 1, 2)""", covers="AGG-01")
def domain_mean(t: Tables):
    c = cube(t)
    a = GR.spatial_reduce(c, ["value", "value2"], ["year", "step"]).withColumnsRenamed({"value": "mean_v", "value2": "mean_q"})
    m = GR.spatial_reduce(c, ["value"], ["year", "step"], "median").withColumnRenamed("value", "median_v")
    return a.join(m, ["year", "step"])


@query("box_extract", "year:i step:i value:f4 value2:f4", f"""{CUBE},
  final AS (SELECT year, step, avg(value) AS value, avg(value2) AS value2 FROM cube WHERE row BETWEEN 1 AND 5 AND col BETWEEN 2 AND 8 GROUP BY 1, 2)""", covers="AGG-02 PRJ-06")
def box_extract(t: Tables):
    return GR.box_series(cube(t), ["value", "value2"], (1, 5), (2, 8))


@query("clean_cells", "land:b n:i total:f0", f"""{CUBE}, z AS (SELECT row, col, CASE WHEN value2 < 20 THEN 0.0 WHEN value2 > 40 THEN -9999.0 ELSE value END AS v FROM cube),
  c AS (SELECT CASE WHEN v IN (-9999.0, 0.0) OR (row >= 8 AND col < 3) THEN NULL ELSE v END AS v FROM z),
  final AS (SELECT v IS NULL AS land, count(*) AS n, coalesce(sum(v), 0) AS total FROM c GROUP BY 1)""", covers="SRC-04")
def clean_cells(t: Tables):
    raw = F.when(F.col("value2") < 20, 0.0).when(F.col("value2") > 40, -9999.0).otherwise(F.col("value"))
    c = cube(t).select(C.grid_clean(raw, F.col("row"), F.col("col"), corner=(8, 3)).alias("v"))
    return c.groupBy(F.isnull("v").alias("land")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


@query("late_variable", "year:i n_steps:i n_values:i", f"""{CUBE}, cal AS (SELECT y AS year, s AS step FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM cube), range(1, 121) b(s)),
  f AS (SELECT year, step, avg(value) AS v FROM cube GROUP BY 1, 2),
  final AS (SELECT year, count(*) AS n_steps, count(CASE WHEN year < 1997 THEN NULL ELSE v END) AS n_values FROM cal LEFT JOIN f USING (year, step) GROUP BY 1)""", covers="SRC-06 CAL-01")
def late_variable(t: Tables):
    from ..sources.grids import calendar_of, start_later

    f = stage(GR.spatial_reduce(cube(t), ["value"], ["year", "step"]))
    return start_later(calendar_of(f), f, ["value"], 1997).groupBy("year").agg(F.count(F.lit(1)).alias("n_steps"), F.count("value").alias("n_values"))


@query("step_gaps", "year:i step:i", f"""{CUBE}, cal AS (SELECT y AS year, s AS step FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM cube), range(1, 121) b(s)),
  final AS (SELECT year, step FROM cal ANTI JOIN (SELECT DISTINCT year, step FROM cube) USING (year, step))""", covers="SRC-03")
def step_gaps(t: Tables):
    from ..sources.grids import calendar_of, missing_steps

    c = stage(cube(t).select("year", "step").distinct())
    return missing_steps(c, calendar_of(c))


@query("regrid_weights", "day:d target:i value:f1", """
  h AS (SELECT CAST(ts AS DATE) AS day, user_id % 50 AS src, avg(value) - 20 AS v FROM events GROUP BY 1, 2),
  k AS (SELECT DISTINCT src FROM h), w AS (SELECT src, src % 7 AS target, 0.25 AS w FROM k UNION ALL SELECT src, (src + 3) % 7, 0.75 FROM k),
  final AS (SELECT day, target, round(greatest(sum(w*v), 0.0) + 3e-5, 1) AS value FROM h JOIN w USING (src) GROUP BY 1, 2)""", covers="JOI-15 AGG-04")
def regrid_weights(t: Tables):
    h = t.events.groupBy(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 50).alias("src")).agg((F.avg("value") - 20).alias("v"))
    two = F.array(F.struct((F.col("src") % 7).alias("target"), F.lit(0.25).alias("w")),
                  F.struct(((F.col("src") + 3) % 7).alias("target"), F.lit(0.75).alias("w")))
    w = h.select("src").distinct().select("src", F.inline(two))
    r = S.regrid(h, w, src=["src"], target=["target"], weight="w", value="v", keep=["day"], decimals=None)
    return r.withColumn("value", F.round(F.col("v") + 3e-5, 1))


@query("bilinear_regrid", "year:i step:i ty:i tx:i value:f3", f"""{CUBE}, tg AS (SELECT ty, tx, ty * 1.5 + 0.3 AS y, tx * 1.25 + 0.6 AS x FROM range(0, 6) a(ty), range(0, 7) b(tx)),
  w AS (SELECT ty, tx, CAST(floor(y) AS INT) + dy AS row, CAST(floor(x) AS INT) + dx AS col, (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w
    FROM tg, range(0, 2) c(dy), range(0, 2) d(dx)),
  final AS (SELECT year, step, ty, tx, greatest(sum(w*value), 0) AS value FROM cube JOIN w USING (row, col) GROUP BY 1, 2, 3, 4)""", covers="JOI-15")
def bilinear_regrid(t: Tables):
    tg = t.spark.range(42).select(
        F.floor(F.col("id") / 7).alias("ty"), (F.col("id") % 7).alias("tx")).withColumns(
        {"y": F.col("ty") * 1.5 + 0.3, "x": F.col("tx") * 1.25 + 0.6})
    w = S.bilinear_weights(tg, key=["ty", "tx"]).withColumnsRenamed({"sy": "row", "sx": "col"})
    return S.regrid(cube(t), w, src=["row", "col"], target=["ty", "tx"], weight="w", value="value", keep=["year", "step"], decimals=None)


WINDOW_SQL = f"""{CUBE}, wd AS (SELECT *, make_date(year, 1, 1) + CAST(CASE WHEN step < 120 THEN step*3-1
    WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS date FROM cube),
  ws AS (SELECT CASE WHEN month(date) IN (12,1,2) THEN 'Winter' WHEN month(date) IN (3,4,5) THEN 'Spring' WHEN month(date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season, year, row, col, avg(value) AS v FROM wd GROUP BY ALL),
  ww AS (SELECT o_custkey % 10 AS row, o_orderkey % 10 AS col, count(*) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
  wi AS (SELECT season, year, log10(sum(w*v)/sum(w) + 1e-6) AS idx FROM ws JOIN ww USING (row, col) GROUP BY 1, 2)"""


@query("window_index", "season:s year:i idx:f6", f"{WINDOW_SQL}, final AS (SELECT * FROM wi)", covers="AGG-26")
def window_index(t: Tables):
    c = cube(t).withColumn("season", cal.season(cal.step_date(F.col("year"), F.col("step"))))
    w = t.orders.where("o_orderstatus = 'F'").groupBy(
        (F.col("o_custkey") % 10).cast("int").alias("row"), (F.col("o_orderkey") % 10).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("w"))
    return GR.window_index(c, w, keys=["season", "year"], cell=["row", "col"], value="value", weight="w", out="idx")
