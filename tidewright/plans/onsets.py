"""Event timing on the bound tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import line_intercept, line_slope, pearson
from ..functions import calendar as cal
from ..operators import joins as J
from ..operators import onset as O
from ..operators import skill as K
from .base import Tables, query, stage
from .bindings import CUBE, MODEL_SERIES, SERIES, cube, model_series, series_table

LEADS = "lead(v, 1) OVER w AS n1, lead(v, 2) OVER w AS n2, lead(v, 3) OVER w AS n3, lead(v, 4) OVER w AS n4"
FULL = "yr AS (SELECT DISTINCT grp, year FROM series)"


def doy_sql(rule: str, centre: str = "median(v) OVER (PARTITION BY grp, year)", src: str = "series", name: str = "final") -> str:
    hit = {
        "pair": "v >= 1.05*c AND n2 IS NOT NULL AND (coalesce((n1+n2)/2 > 0.7*1.05*c, false) OR coalesce((n3+n4)/2 > 0.7*1.05*c, false))",
        "four": "v >= 1.05*c AND n4 IS NOT NULL AND ((n1 >= 0.7*1.05*c)::INT + (n2 >= 0.7*1.05*c)::INT + (n3 >= 0.7*1.05*c)::INT + (n4 >= 0.7*1.05*c)::INT) >= 2",
    }[rule]
    return f"""{name}_l AS (SELECT *, {centre} AS c, {LEADS} FROM {src} WINDOW w AS (PARTITION BY grp, year ORDER BY date)),
  {name} AS (SELECT grp, year, min(date) FILTER ({hit}) AS onset_date, dayofyear(min(date) FILTER ({hit})) AS onset_doy FROM {name}_l GROUP BY 1, 2)"""


@query("onset_threshold", "grp:s year:i onset_date:d onset_doy:f0", f"{SERIES}, {doy_sql('pair')}", covers="BLM-01 WIN-04 WIN-12")
def onset_threshold(t: Tables):
    return O.threshold_onset(series_table(t), ["grp"], value="v")


@query("onset_threshold_all_years", "grp:s year:i onset_date:d onset_doy:f0",
       f"{SERIES}, s2 AS (SELECT * FROM series WHERE month(date) IN (2, 3, 4)), {doy_sql('pair', 'avg(v) OVER (PARTITION BY grp)', 's2')}", covers="BLM-01")
def onset_threshold_all_years(t: Tables):
    return O.threshold_onset(series_table(t), ["grp"], value="v", centre="mean", across_years=True,
                             exclude_months=[1, 5, 6, 7, 8, 9, 10, 11, 12])


@query("onset_two_of_four", "grp:s year:i onset_date:d onset_doy:f0", f"{SERIES}, {doy_sql('four')}", covers="BLM-02")
def onset_two_of_four(t: Tables):
    return O.threshold_onset(series_table(t), ["grp"], value="v", rule="two_of_four")


PCT = """sm AS (SELECT grp, year, date, avg(v) OVER (PARTITION BY grp, year ORDER BY date RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW) AS s FROM series),
  mx AS (SELECT *, max(s) OVER (PARTITION BY grp, year) AS mx FROM sm)"""


@query("onset_pct_max", "grp:s year:i onset_date:d onset_doy:f0", f"""{SERIES}, {PCT},
  final AS (SELECT grp, year, min(date) FILTER (mx > 0 AND s >= 0.95*mx) AS onset_date, dayofyear(min(date) FILTER (mx > 0 AND s >= 0.95*mx)) AS onset_doy FROM mx GROUP BY 1, 2)""",
       covers="BLM-03 WIN-03 WIN-12")
def onset_pct_max(t: Tables):
    return O.percent_of_max_onset(series_table(t), ["grp"], value="v")


@query("trailing_6d_events", "event_type:s hour:t v:f4 smooth:f4", """
  h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS v FROM events GROUP BY 1, 2),
  final AS (SELECT *, avg(v) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN INTERVAL '143 hours 59 minutes' PRECEDING AND CURRENT ROW) AS smooth FROM h)""", covers="WIN-03 AGG-04")
def trailing_6d_events(t: Tables):
    h = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    return O.trailing_mean_time(h, ["event_type"], value="v", ts="hour", days=6)


@query("onset_per_user", "user_id:i onset_date:d peak:f4", """
  d AS (SELECT user_id AS grp, year(ts) AS year, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1, 2, 3), series AS (SELECT * FROM d),
  sm AS (SELECT grp, year, date, avg(v) OVER (PARTITION BY grp, year ORDER BY date RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW) AS s FROM series),
  mx AS (SELECT *, max(s) OVER (PARTITION BY grp, year) AS mx FROM sm),
  final AS (SELECT grp AS user_id, min(date) FILTER (s >= 0.95*mx) AS onset_date, max(mx) AS peak FROM mx GROUP BY 1)""", covers="BLM-03")
def onset_per_user(t: Tables):
    d = t.events.groupBy("user_id", F.year("ts").alias("year"), F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("v"))
    on = O.percent_of_max_onset(d, ["user_id"], value="v")
    s = O.trailing_mean(d, ["user_id", "year"], value="v")
    return on.join(s.groupBy("user_id").agg(F.max("smooth").alias("peak")), "user_id")


CELL = f"""{CUBE}, series AS (SELECT row * 10 + col AS grp, year, step AS date, value AS v FROM cube),
  on0_l AS (SELECT *, median(v) OVER (PARTITION BY grp, year) AS c, {LEADS} FROM series WINDOW w AS (PARTITION BY grp, year ORDER BY date)),
  on0 AS (SELECT grp, year, min(date) FILTER (v >= 1.05*c AND n2 IS NOT NULL AND (coalesce((n1+n2)/2 > 0.7*1.05*c, false) OR coalesce((n3+n4)/2 > 0.7*1.05*c, false))) AS step FROM on0_l GROUP BY 1, 2),
  on1 AS (SELECT grp // 10 AS row, grp % 10 AS col, year, CASE WHEN step < 120 THEN step*3-1
    WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 361 ELSE 360 END AS onset_doy FROM on0 WHERE step IS NOT NULL
    UNION ALL SELECT grp // 10, grp % 10, year, NULL FROM on0 WHERE step IS NULL),
  pk AS (SELECT row, col, avg(p) AS peak FROM (SELECT row, col, year, max(value) AS p FROM cube GROUP BY ALL) GROUP BY 1, 2),
  wk AS (SELECT row, col, peak, peak < 0.1 * median(peak) OVER () AS weak FROM pk)"""


def cell_onsets(t: Tables):
    c = cube(t).withColumn("date", cal.step_date(F.col("year"), F.col("step")))
    return stage(O.threshold_onset(c, ["row", "col"], value="value")), c


@query("onset_per_cell", "row:i col:i year:i onset_doy:f0 peak:f4 weak:b",
       f"{CELL}, final AS (SELECT row, col, year, onset_doy, peak, weak FROM on1 JOIN wk USING (row, col))", covers="BLM-04")
def onset_per_cell(t: Tables):
    on, c = cell_onsets(t)
    weak = O.weak_cells(c, ["row", "col"], value="value")
    return on.join(weak, ["row", "col"])


@query("cell_coherence", "row:i col:i n_years:i mean:f4 sd:f4 r:f6", f"""{CELL},
  rg AS (SELECT year, avg(onset_doy) AS rd FROM on1 GROUP BY 1), rm AS (SELECT avg(rd) AS rm FROM rg),
  st AS (SELECT row, col, avg(onset_doy) AS mean, stddev_pop(onset_doy) AS sd, count(onset_doy) AS n_years FROM on1 GROUP BY 1, 2),
  final AS (SELECT row, col, any_value(n_years) AS n_years, any_value(mean) AS mean, any_value(sd) AS sd,
    CASE WHEN sum((onset_doy-mean)^2) > 0 AND sum((rd-rm)^2) > 0 THEN sum((onset_doy-mean)*(rd-rm))/sqrt(sum((onset_doy-mean)^2)*sum((rd-rm)^2)) END AS r
   FROM on1 JOIN st USING (row, col) JOIN rg USING (year), rm GROUP BY 1, 2)""", covers="BLM-11")
def cell_coherence(t: Tables):
    on, _ = cell_onsets(t)
    region = on.groupBy("year").agg(F.avg("onset_doy").alias("region_doy"))
    return O.cell_coherence(on, region, ["row", "col"])


@query("coherence_shares", "n_cells:i share_over_half:f6 spatial_r:f6", f"""{CELL},
  rg AS (SELECT year, avg(onset_doy) AS rd FROM on1 GROUP BY 1), rm AS (SELECT avg(rd) AS rm FROM rg),
  st AS (SELECT row, col, avg(onset_doy) AS mean FROM on1 GROUP BY 1, 2),
  cr AS (SELECT row, col, any_value(mean) AS mean, sum((onset_doy-mean)*(rd-rm))/sqrt(sum((onset_doy-mean)^2)*sum((rd-rm)^2)) AS r
   FROM on1 JOIN st USING (row, col) JOIN rg USING (year), rm GROUP BY 1, 2 HAVING sum((onset_doy-mean)^2) > 0 AND sum((rd-rm)^2) > 0),
  q AS (SELECT row, col, avg(value2) AS q FROM cube GROUP BY 1, 2),
  final AS (SELECT count(*) AS n_cells, avg(CASE WHEN r > 0.5 THEN 1.0 ELSE 0.0 END) AS share_over_half, corr(mean, q) AS spatial_r FROM cr JOIN q USING (row, col))""", covers="BLM-11")
def coherence_shares(t: Tables):
    on, c = cell_onsets(t)
    region = on.groupBy("year").agg(F.avg("onset_doy").alias("region_doy"))
    r = O.cell_coherence(on, region, ["row", "col"]).where("r IS NOT NULL")
    q = c.groupBy("row", "col").agg(F.avg("value2").alias("q"))
    return r.join(q, ["row", "col"]).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg(F.when(F.col("r") > 0.5, 1.0).otherwise(0.0)).alias("share_over_half"),
        pearson("mean", "q").alias("spatial_r"))


REGION = f"""{CUBE}, rs AS (SELECT year, step, median(value + 1000*value2) AS v FROM cube WHERE row BETWEEN 2 AND 6 GROUP BY 1, 2),
  series AS (SELECT 'region' AS grp, year, make_date(year, 1, 1) + CAST(CASE WHEN step < 120 THEN step*3-1
    WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS date, v FROM rs),
  lseries AS (SELECT grp, year, date, ln(v + 0.01) AS v FROM series)"""


def region_series(t: Tables):
    from ..operators.grid import region_series as rs

    s = rs(cube(t), {"v": [F.col("value"), 1000 * F.col("value2")]}, where=F.col("row").between(2, 6), reducer="median")
    return s.withColumn("date", cal.step_date(F.col("year"), F.col("step")))


@query("region_onset", "year:i onset_date:d onset_doy:f0", f"{REGION}, {doy_sql('pair')}", covers="BLM-07 AGG-01 PRJ-08")
def region_onset(t: Tables):
    return O.threshold_onset(region_series(t), [], value="v", factor=1.05)


@query("region_onset_pct", "year:i onset_date:d onset_doy:f0", f"""{REGION}, {PCT.replace("FROM series", "FROM lseries")},
  final AS (SELECT year, min(date) FILTER (s >= 0.95*mx) AS onset_date, dayofyear(min(date) FILTER (s >= 0.95*mx)) AS onset_doy FROM mx GROUP BY 1)""", covers="BLM-07 BLM-03")
def region_onset_pct(t: Tables):
    return O.percent_of_max_onset(region_series(t), [], value="v", log_offset=0.01)


MODEL_ONSET = f"""{MODEL_SERIES}, ms AS (SELECT 'm' AS grp, year, mdate AS date, model AS v FROM model_series), {doy_sql('pair', src='ms', name='mo')}"""


def model_onset(t: Tables):
    m = model_series(t).select("year", F.col("mdate").alias("date"), F.col("model").alias("v"))
    return O.threshold_onset(m, [], value="v")


BOTH = f"{SERIES}, {doy_sql('pair', name='so')}, {MODEL_ONSET}"


@query("onset_labels", "grp:s year:i margin:s wide:s plain:s by_sd:s", f"""{SERIES}, {doy_sql('pair', name='so')},
  m AS (SELECT avg(onset_doy) AS mu, stddev_samp(onset_doy) AS sd FROM so),
  final AS (SELECT grp, year,
   CASE WHEN onset_doy IS NULL THEN NULL WHEN onset_doy+1.5 <= 6 THEN 'early' WHEN onset_doy-1.5 >= 14 THEN 'late' WHEN onset_doy-1.5 >= 6 AND onset_doy+1.5 <= 14 THEN 'avg' ELSE 'cusp' END AS margin,
   CASE WHEN onset_doy IS NULL THEN NULL WHEN onset_doy+1.5 <= 6 THEN 'early' WHEN onset_doy-1.5 >= 14 THEN 'late' WHEN onset_doy+1.5 <= 13 AND onset_doy-1.5 >= 5 THEN 'avg' ELSE 'cusp' END AS wide,
   CASE WHEN onset_doy IS NULL THEN 'na' WHEN onset_doy <= 6 THEN 'early' WHEN onset_doy >= 14 THEN 'late' ELSE 'avg' END AS plain,
   CASE WHEN onset_doy IS NULL THEN NULL WHEN onset_doy <= mu-sd THEN 'early' WHEN onset_doy >= mu+sd THEN 'late' WHEN onset_doy <= mu+sd-1 AND onset_doy >= mu-sd+1 THEN 'avg' ELSE 'cusp' END AS by_sd FROM so, m)""", covers="BLM-08")
def onset_labels(t: Tables):
    on = O.threshold_onset(series_table(t), ["grp"], value="v")
    m = on.agg(F.avg("onset_doy").alias("mu"), F.stddev_samp("onset_doy").alias("sd"))
    d = F.col("onset_doy")
    return on.crossJoin(m).select(
        "grp", "year", O.labels_by_bounds(d, 6, 14).alias("margin"), O.labels_by_bounds(d, 6, 14, scheme="margin_wide").alias("wide"),
        O.labels_by_bounds(d, 6, 14, scheme="plain").alias("plain"), O.labels_by_sd(d, F.col("mu"), F.col("sd")).alias("by_sd"))


@query("label_agreement", "grp:s count:i total:i proportion:f6", f"""{BOTH},
  f AS (SELECT so.grp, year, CASE WHEN so.onset_doy <= 6 THEN 'early' WHEN so.onset_doy >= 14 THEN 'late' WHEN so.onset_doy IS NULL THEN 'na' ELSE 'avg' END AS a,
    CASE WHEN mo.onset_doy <= 6 THEN 'early' WHEN mo.onset_doy >= 14 THEN 'late' WHEN mo.onset_doy IS NULL THEN 'na' ELSE 'avg' END AS b FROM so JOIN mo USING (year)),
  final AS (SELECT grp, count(*) FILTER (a = b) AS count, count(*) AS total, count(*) FILTER (a = b) / count(*) AS proportion FROM f GROUP BY 1)""", covers="BLM-09 JOI-11")
def label_agreement(t: Tables):
    a = O.threshold_onset(series_table(t), ["grp"], value="v")
    a = a.select("grp", "year", O.labels_by_bounds(F.col("onset_doy"), 6, 14, scheme="plain").alias("a"))
    b = model_onset(t).select("year", O.labels_by_bounds(F.col("onset_doy"), 6, 14, scheme="plain").alias("b"))
    return O.agreement(a, b, ["year"], "a", "b", ["grp"])


@query("window_overlap", "grp:s n_overlap:i n:i", f"""{BOTH},
  final AS (SELECT so.grp, count(*) FILTER (mo.onset_doy+1.5 >= so.onset_doy-4 AND mo.onset_doy-1.5 <= so.onset_doy+4) AS n_overlap, count(*) AS n FROM so JOIN mo USING (year) GROUP BY 1)""", covers="JOI-14")
def window_overlap(t: Tables):
    a = O.threshold_onset(series_table(t), ["grp"], value="v").select("grp", "year", F.col("onset_doy").alias("a"))
    b = model_onset(t).select("year", F.col("onset_doy").alias("b"))
    j = J.window_overlap(a, b, ["year"], "a", "b")
    return j.groupBy("grp").agg(F.count_if("overlap").alias("n_overlap"), F.count(F.lit(1)).alias("n"))


@query("onset_skill", "grp:s n:i mse:f4 rmse:f4 mae:f4 bias:f4 r:f6 wss_floor:f6 obs_std_pop:f4 model_std_pop:f4", f"""{BOTH},
  p AS (SELECT so.grp, so.onset_doy AS o, mo.onset_doy AS m FROM so JOIN mo USING (year) WHERE so.onset_doy IS NOT NULL AND mo.onset_doy IS NOT NULL),
  q AS (SELECT grp, avg(o) AS om FROM p GROUP BY 1),
  final AS (SELECT grp, count(*) AS n, avg((m-o)^2) AS mse, sqrt(avg((m-o)^2)) AS rmse, avg(abs(m-o)) AS mae, avg(m-o) AS bias, corr(m, o) AS r,
    greatest(0, 1 - sum((m-o)^2)/sum((abs(m-om)+abs(o-om))^2)) AS wss_floor, stddev_pop(o) AS obs_std_pop, stddev_pop(m) AS model_std_pop FROM p JOIN q USING (grp) GROUP BY 1)""", covers="SKL-03")
def onset_skill(t: Tables):
    a = O.threshold_onset(series_table(t), ["grp"], value="v").select("grp", "year", F.col("onset_doy").alias("o"))
    b = model_onset(t).select("year", F.col("onset_doy").alias("m"))
    return K.skill(a.join(b, "year"), ["grp"], "o", "m", which="timing", summary=True)


#: Least value of a week of a ratio series: SAT_MIN_CHL of the reference, ecospace_eval_4e_sat_chl_timeseries.py:46, applied at :62.
#: Its onsets have no such rule (ecospace_eval_4d_bloom_snapshot_maps.py:97-104, revision_audits/bloom_suchy_reproduction.py:47-65).
MIN_VALUE = 0.05

WEEKS = "wk AS (SELECT l_returnflag AS grp, year(l_shipdate) AS year, least((dayofyear(l_shipdate)-1)//8, 45) AS week, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)"
WEEKLY = f"""{WEEKS},
  gap AS (SELECT grp, year, week, CASE WHEN v >= {MIN_VALUE} THEN v END AS v FROM wk)"""


def weekly_means(t: Tables):
    d = F.col("l_shipdate")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("grp"), F.year(d).alias("year"), cal.week8(d).alias("week")).agg(F.avg("l_extendedprice").alias("v"))


def weekly(t: Tables):
    # A week of too low a value counts as missing; how many rows it has does not matter.
    return weekly_means(t).withColumn("v", F.when(F.col("v") >= MIN_VALUE, F.col("v")))


# Weeks without a value are windows of their own: they are no neighbours and no candidates, but their years are kept.
WON = """wl AS (SELECT grp, year, week, v, count(v) OVER g AS nv, 1.05*median(v) OVER g AS thr, lead(v,1) OVER w AS n1, lead(v,2) OVER w AS n2, lead(v,3) OVER w AS n3, lead(v,4) OVER w AS n4
   FROM wk WINDOW g AS (PARTITION BY grp, year, v IS NULL), w AS (PARTITION BY grp, year, v IS NULL ORDER BY week)),
  won AS (SELECT grp, year, min(week) FILTER (v >= thr AND n2 IS NOT NULL AND nv >= 5 AND (n1 > 0.7*thr OR n2 > 0.7*thr)) AS w1,
    min(week) FILTER (v >= thr AND n2 IS NOT NULL AND nv >= 5 AND (coalesce((n1+n2)/2 > 0.7*thr, false) OR coalesce((n3+n4)/2 > 0.7*thr, false))) AS w2 FROM wl GROUP BY 1, 2)"""


@query("onset_weekly_gaps", "grp:s year:i either:f0 pairs:f0", f"{WEEKS}, {WON}, final AS (SELECT grp, year, w1 AS either, w2 AS pairs FROM won)", covers="BLM-05 CAL-05")
def onset_weekly_gaps(t: Tables):
    w = weekly_means(t)
    a = O.weekly_onset(w, ["grp"], value="v").withColumnRenamed("onset_week", "either")
    b = O.weekly_onset(w, ["grp"], value="v", rule="pair_means").withColumnRenamed("onset_week", "pairs")
    return J.null_safe_join(a, b, ["grp", "year"])


RECIPES = f"""{WEEKS}, {WON}, {MODEL_ONSET},
  r AS (SELECT grp || '/either' AS recipe, year, w1*8+1 AS doy FROM won UNION ALL SELECT grp || '/pairs', year, w2*8+1 FROM won),
  j AS (SELECT recipe, doy, mo.onset_doy AS ref FROM r JOIN mo USING (year) WHERE doy IS NOT NULL AND mo.onset_doy IS NOT NULL),
  sc AS (SELECT recipe, count(*) AS n, count(*) FILTER ((doy-1)//8 = (ref-1)//8) AS same_week, count(*) FILTER (abs((doy-1)//8 - (ref-1)//8) <= 1) AS within_one,
    avg(doy-ref) AS bias, avg(abs(doy-ref)) AS mae, CASE WHEN count(*) > 3 THEN corr(doy, ref) END AS r FROM j GROUP BY 1)"""


def recipe_scores(t: Tables):
    w = weekly_means(t)
    parts = None
    for rule, label in (("either_next", "either"), ("pair_means", "pairs")):
        p = O.weekly_onset(w, ["grp"], value="v", rule=rule).select(
            F.concat("grp", F.lit("/" + label)).alias("recipe"), "year", (F.col("onset_week") * 8 + 1).alias("doy"))
        parts = p if parts is None else parts.unionByName(p)
    ref = model_onset(t).select("year", F.col("onset_doy").alias("ref"))
    return O.score_recipes(parts.join(ref, "year"), ["recipe"], "doy", "ref")


@query("onset_recipe_scores", "recipe:s n:i same_week:i within_one:i bias:f4 mae:f4 r:f6", f"{RECIPES}, final AS (SELECT * FROM sc)", covers="BLM-10")
def onset_recipe_scores(t: Tables):
    return recipe_scores(t)


@query("onset_best_recipe", "recipe:s n:i same_week:i within_one:i mae:f4",
       f"{RECIPES}, final AS (SELECT * FROM sc ORDER BY same_week DESC, within_one DESC, round(mae, 9), recipe LIMIT 1)", covers="BLM-10")
def onset_best_recipe(t: Tables):
    s = recipe_scores(t)
    return O.best_recipe(s.withColumn("mae", F.round("mae", 9)), ["recipe"])


# Every recipe: scale and aggregation of the cells of a week, and the rule that makes a week the onset.
CELLS = """cw AS (SELECT l_returnflag AS grp, year(l_shipdate) AS year, least((dayofyear(l_shipdate)-1)//8, 45) AS week, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3, l_suppkey % 10, l_partkey % 10),
  ag AS (SELECT grp, year, week, avg(v) AS a, median(v) AS b, avg(log10(v)) AS c, median(log10(v)) AS d FROM cw WHERE v > 0 GROUP BY 1, 2, 3),
  lg AS (SELECT grp, 'lin/mean' AS recipe, year, week, a AS v FROM ag UNION ALL SELECT grp, 'lin/median', year, week, b FROM ag UNION ALL SELECT grp, 'log/mean', year, week, c FROM ag UNION ALL SELECT grp, 'log/median', year, week, d FROM ag)"""
LATTICE = f"""{CELLS}, {MODEL_ONSET}, wl AS (SELECT grp, recipe, year, week, v, count(v) OVER g AS nv, 1.05*median(v) OVER g AS thr, lead(v,1) OVER w AS n1, lead(v,2) OVER w AS n2, lead(v,3) OVER w AS n3, lead(v,4) OVER w AS n4
    FROM lg WINDOW g AS (PARTITION BY grp, recipe, year), w AS (PARTITION BY grp, recipe, year ORDER BY week)),
  won AS (SELECT grp, recipe, year, min(week) FILTER (v >= thr AND n2 IS NOT NULL AND nv >= 5 AND (n1 > 0.7*thr OR n2 > 0.7*thr)) AS w1,
    min(week) FILTER (v >= thr AND n2 IS NOT NULL AND nv >= 5 AND (coalesce((n1+n2)/2 > 0.7*thr, false) OR coalesce((n3+n4)/2 > 0.7*thr, false))) AS w2 FROM wl GROUP BY 1, 2, 3),
  r AS (SELECT grp, recipe || '/either' AS recipe, year, w1*8+1 AS doy FROM won UNION ALL SELECT grp, recipe || '/pairs', year, w2*8+1 FROM won),
  j AS (SELECT r.grp, recipe, doy, mo.onset_doy AS ref FROM r JOIN mo USING (year) WHERE doy IS NOT NULL AND mo.onset_doy IS NOT NULL),
  sc AS (SELECT grp, recipe, count(*) AS n, count(*) FILTER ((doy-1)//8 = (ref-1)//8) AS same_week, count(*) FILTER (abs((doy-1)//8 - (ref-1)//8) <= 1) AS within_one,
    avg(doy-ref) AS bias, avg(abs(doy-ref)) AS mae, CASE WHEN count(*) > 3 THEN corr(doy, ref) END AS r FROM j GROUP BY 1, 2)"""


def lattice_scores(t: Tables):
    """Scores of all recipes from one expanded aggregate: a week holds at most one value for each cell of the grid."""
    d = F.col("l_shipdate")
    c = t.lineitem.groupBy(F.col("l_returnflag").alias("grp"), F.year(d).alias("year"), cal.week8(d).alias("week"), F.col("l_suppkey") % 10, F.col("l_partkey") % 10)
    c = c.agg(F.avg("l_extendedprice").alias("v")).where("v > 0").withColumn("g", F.log10("v"))
    w = c.groupBy("grp", "year", "week").agg(F.avg("v").alias("a"), F.median("v").alias("b"), F.avg("g").alias("c"), F.median("g").alias("d"))
    recipes = {"lin/mean": "a", "lin/median": "b", "log/mean": "c", "log/median": "d"}
    w = w.select("grp", "year", "week", F.inline(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(v).alias("v")) for k, v in recipes.items()])))
    w = stage(w)  # a row for each week and recipe
    parts = [O.weekly_onset(w, ["grp", "scale"], value="v", rule=rule).select("grp", F.concat("scale", F.lit(f"/{label}")).alias("recipe"), "year", (F.col("onset_week") * 8 + 1).alias("doy"))
             for rule, label in (("either_next", "either"), ("pair_means", "pairs"))]
    ref = model_onset(t).select("year", F.col("onset_doy").alias("ref"))
    return O.score_recipes(parts[0].unionByName(parts[1]).join(ref, "year"), ["grp", "recipe"], "doy", "ref")


@query("onset_recipe_lattice", "grp:s recipe:s n:i same_week:i within_one:i bias:f4 mae:f4 r:f6", f"{LATTICE}, final AS (SELECT * FROM sc)", covers="BLM-10")
def onset_recipe_lattice(t: Tables):
    return lattice_scores(t)


@query("onset_lattice_best", "grp:s recipe:s same_week:i within_one:i mae:f4",
       f"{LATTICE}, final AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY grp ORDER BY same_week DESC, within_one DESC, round(mae, 9), recipe) = 1)", covers="BLM-10")
def onset_lattice_best(t: Tables):
    s = lattice_scores(t).withColumn("mae", F.round("mae", 9))
    first = F.struct((-F.col("same_week")).alias("a"), (-F.col("within_one")).alias("b"), "mae", "recipe", "same_week", "within_one")
    return s.groupBy("grp").agg(F.min(first).alias("f")).select("grp", "f.recipe", "f.same_week", "f.within_one", "f.mae")


@query("weekly_ratio", "grp:s year:i week:i v:f4 ratio:f6", f"""{WEEKLY},
  final AS (SELECT grp, year, week, v, v / median(v) OVER (PARTITION BY grp, year) AS ratio FROM gap WHERE v IS NOT NULL)""", covers="BLM-12")
def weekly_ratio(t: Tables):
    return O.ratio_to_annual_median(weekly(t).where("v IS NOT NULL"), ["grp", "year"], "v")


WIDE = f"""{WEEKLY}, rt AS (SELECT grp, year, week, v / median(v) OVER (PARTITION BY grp, year) AS ratio FROM gap WHERE v IS NOT NULL),
  wd AS (SELECT a.year, a.week, a.ratio AS a, b.ratio AS b FROM rt a JOIN rt b USING (year, week) WHERE a.grp = 'A' AND b.grp = 'N')"""


def wide_ratio(t: Tables):
    r = O.ratio_to_annual_median(weekly(t).where("v IS NOT NULL"), ["grp", "year"], "v")
    return r.groupBy("year", "week").pivot("grp", ["A", "N"]).agg(F.first("ratio")).where("A IS NOT NULL AND N IS NOT NULL")


@query("weekly_ratio_agreement", "n:i r_log:f6 r_anom:f6 slope:f6 intercept:f6", f"""{WIDE},
  l AS (SELECT week, ln(a) AS la, ln(b) AS lb, log10(a) AS ga, log10(b) AS gb, ln(a) - avg(ln(a)) OVER (PARTITION BY week) AS da, ln(b) - avg(ln(b)) OVER (PARTITION BY week) AS db FROM wd),
  final AS (SELECT count(*) AS n, corr(la, lb) AS r_log, corr(da, db) AS r_anom, regr_slope(gb, ga) AS slope, regr_intercept(gb, ga) AS intercept FROM l)""", covers="BLM-14 WIN-07 SET-03")
def weekly_ratio_agreement(t: Tables):
    w = W.partitionBy("week")
    d = wide_ratio(t).withColumns({"la": F.log("A"), "lb": F.log("N"), "ga": F.log10("A"), "gb": F.log10("N")})
    d = d.withColumns({"da": F.col("la") - F.avg("la").over(w), "db": F.col("lb") - F.avg("lb").over(w)})
    return d.agg(F.count(F.lit(1)).alias("n"), pearson("la", "lb").alias("r_log"), pearson("da", "db").alias("r_anom"),
                 line_slope("gb", "ga").alias("slope"), line_intercept("gb", "ga").alias("intercept"))


BLOCK = """cw AS (SELECT l_suppkey % 10 AS row, l_partkey % 10 AS col, year(l_shipdate) AS year, least((dayofyear(l_shipdate)-1)//8, 45) AS week, avg(l_extendedprice) AS a, avg(l_quantity) AS b FROM lineitem GROUP BY ALL),
  cr AS (SELECT *, month(least(DATE '2001-01-01' + CAST(week*8+4 AS INTEGER), DATE '2001-12-31')) AS block, a / median(a) OVER (PARTITION BY year) AS ra, b / median(b) OVER (PARTITION BY year) AS rb FROM cw),
  cy AS (SELECT row, col, block, year, avg(ra) AS ra, avg(rb) AS rb FROM cr GROUP BY ALL),
  cb AS (SELECT row, col, block, median(ra) AS ra, median(rb) AS rb FROM cy GROUP BY ALL)"""


def block_table(t: Tables):
    from ..operators.quantiles import grouped_medians

    d = F.col("l_shipdate")
    c = t.lineitem.groupBy(
        (F.col("l_suppkey") % 10).alias("row"), (F.col("l_partkey") % 10).alias("col"), F.year(d).alias("year"), cal.week8(d).alias("week"),
    ).agg(F.avg("l_extendedprice").alias("a"), F.avg("l_quantity").alias("b"))
    med = grouped_medians(c, ["year"], ["a", "b"]).withColumnsRenamed({"a": "ma", "b": "mb"})
    c = J.salted_join(c, med, ["year"], ["row", "col", "week"])
    c = c.withColumns({"block": cal.week_block(F.col("week")), "ra": F.try_divide("a", "ma"), "rb": F.try_divide("b", "mb")})
    y = c.groupBy("row", "col", "block", "year").agg(F.avg("ra").alias("ra"), F.avg("rb").alias("rb"))
    return stage(y.groupBy("row", "col", "block").agg(F.median("ra").alias("ra"), F.median("rb").alias("rb")))


@query("block_climatology", "row:i col:i block:i ra:f6 rb:f6", f"{BLOCK}, final AS (SELECT * FROM cb)", covers="BLM-13 CAL-13 BLM-12")
def block_climatology(t: Tables):
    return block_table(t)


@query("block_pattern", "block:i n:i r:f6 share_over_one:f6", f"""{BLOCK},
  z AS (SELECT block, ln(ra) AS a, ln(rb) AS b, (ln(rb)-avg(ln(rb)) OVER w)/stddev_pop(ln(rb)) OVER w - (ln(ra)-avg(ln(ra)) OVER w)/stddev_pop(ln(ra)) OVER w AS dz FROM cb WINDOW w AS (PARTITION BY block)),
  final AS (SELECT block, count(*) AS n, corr(a, b) AS r, avg(CASE WHEN abs(dz) > 1 THEN 1.0 ELSE 0.0 END) AS share_over_one FROM z GROUP BY 1)""", covers="BLM-13")
def block_pattern(t: Tables):
    return O.pattern_agreement(O.block_pattern(block_table(t), ["block"], "ra", "rb"), ["block"])
