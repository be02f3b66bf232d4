"""Climatologies and anomalies on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import anomaly as A
from ..operators import skill as K
from .base import Tables, query
from .bindings import CUBE, PAIRED, cube, paired, season_sql
from .skill_reports import core

SUMMARY = f"""{PAIRED}, s AS (SELECT grp, season, year, avg(log10(obs + 1e-6)) AS obs_value, avg(model) AS model_value,
  count(DISTINCT tow) AS n_tows FROM paired GROUP BY 1, 2, 3)"""


@query("summary_methods", "grp:s season:s year:i raw:f4 lom:f6 mol:f6 n_tows:i", f"""{PAIRED},
  final AS (SELECT grp, season, year, avg(obs) AS raw, log10(avg(obs)+1e-6) AS lom, avg(log10(obs+1e-6)) AS mol, count(DISTINCT tow) AS n_tows
   FROM paired GROUP BY 1, 2, 3)""", covers="AGG-18")
def summary_methods(t: Tables):
    v = F.col("obs")
    return paired(t).groupBy("grp", "season", "year").agg(
        A.summarise(v, "mean_raw").alias("raw"), A.summarise(v, "log_of_mean").alias("lom"),
        A.summarise(v, "mean_of_logs").alias("mol"), F.countDistinct("tow").alias("n_tows"))


@query("anomaly_pooled", "grp:s year:i obs_anom:f6 model_anom:f6", f"""{PAIRED},
  c AS (SELECT grp, avg(obs) AS mo, stddev_samp(obs) AS so, avg(model) AS mm, stddev_samp(model) AS sm FROM paired GROUP BY 1),
  final AS (SELECT grp, year, avg((obs-mo)/so) AS obs_anom, avg((model-mm)/sm) AS model_anom FROM paired JOIN c USING (grp) GROUP BY 1, 2)""", covers="ANM-01")
def anomaly_pooled(t: Tables):
    return A.pooled_anomalies(paired(t), ["grp"])


EQUAL = """a AS (SELECT grp, season, year, n_tows,
   (obs_value - avg(obs_value) FILTER (n_tows >= 3) OVER w) / stddev_samp(obs_value) FILTER (n_tows >= 3) OVER w AS obs_anom,
   (model_value - avg(model_value) FILTER (n_tows >= 3) OVER w) / stddev_samp(model_value) FILTER (n_tows >= 3) OVER w AS model_anom
  FROM s WINDOW w AS (PARTITION BY grp, season))"""


@query("anomaly_year_equal", "grp:s season:s year:i obs_anom:f6 model_anom:f6 n_tows:i",
       f"{SUMMARY}, {EQUAL}, final AS (SELECT * FROM a)", covers="ANM-02")
def anomaly_year_equal(t: Tables):
    return A.seasonal_anomalies(paired(t), with_all=False)


@query("anomaly_all_seasons", "grp:s season:s year:i obs_anom:f6 model_anom:f6", f"""{SUMMARY}, {EQUAL},
  final AS (SELECT grp, season, year, obs_anom, model_anom FROM a UNION ALL
   SELECT grp, 'All', year, avg(obs_anom), avg(model_anom) FROM a GROUP BY 1, 3 HAVING count(*) >= 4)""", covers="ANM-04")
def anomaly_all_seasons(t: Tables):
    return A.seasonal_anomalies(paired(t), min_seasons=4)


@query("anomaly_weighted", "grp:s season:s year:i obs_anom:f6 model_anom:f6", f"""{SUMMARY},
  w AS (SELECT *, sqrt(least(n_tows, 40.0)) AS w FROM s),
  m AS (SELECT grp, season, sum(w*obs_value)/sum(w) AS mo, sum(w*model_value)/sum(w) AS mm, sum(w) - sum(w*w)/sum(w) AS den FROM w WHERE n_tows >= 3 GROUP BY 1, 2),
  d AS (SELECT grp, season, sqrt(sum(w*(obs_value-mo)^2)/any_value(den)) AS so, sqrt(sum(w*(model_value-mm)^2)/any_value(den)) AS sm FROM w JOIN m USING (grp, season) WHERE n_tows >= 3 GROUP BY 1, 2),
  final AS (SELECT grp, season, year, (obs_value-mo)/so AS obs_anom, (model_value-mm)/sm AS model_anom FROM w JOIN m USING (grp, season) JOIN d USING (grp, season))""",
       covers="ANM-03 AGG-23")
def anomaly_weighted(t: Tables):
    return A.seasonal_anomalies(paired(t), with_all=False, mode="year_weighted", cap=40)


@query("anomaly_compare", "method:s grp:s season:s n:i rmse:f6 r:f6 wss:f6", f"""{PAIRED},
  b AS (SELECT grp, season, year, avg(obs) AS mean_raw, log10(avg(obs)+1e-6) AS log_of_mean, avg(log10(obs+1e-6)) AS mean_of_logs,
    avg(model) AS model_value, count(DISTINCT tow) AS n_tows FROM paired GROUP BY 1, 2, 3),
  u AS (SELECT 'mean_raw' AS method, grp, season, year, mean_raw AS obs_value, model_value, n_tows FROM b
   UNION ALL SELECT 'log_of_mean', grp, season, year, log_of_mean, model_value, n_tows FROM b
   UNION ALL SELECT 'mean_of_logs', grp, season, year, mean_of_logs, model_value, n_tows FROM b),
  a AS (SELECT method, grp, season, year,
   (obs_value - avg(obs_value) FILTER (n_tows >= 3) OVER w) / stddev_samp(obs_value) FILTER (n_tows >= 3) OVER w AS obs,
   (model_value - avg(model_value) FILTER (n_tows >= 3) OVER w) / stddev_samp(model_value) FILTER (n_tows >= 3) OVER w AS model
  FROM u WINDOW w AS (PARTITION BY method, grp, season)),
  d AS (SELECT * FROM a UNION ALL SELECT method, grp, 'All', year, avg(obs), avg(model) FROM a GROUP BY 1, 2, 4),
  {core(['method', 'grp', 'season'], 'd')}, final AS (SELECT * FROM agg)""", covers="ANM-05 SET-07")
def anomaly_compare(t: Tables):
    a = A.compare_summaries(paired(t))
    return K.skill(a, ["method", "grp", "season"], "obs_anom", "model_anom", which=["n", "rmse", "r", "wss"], standardised=True, summary=True)


@query("model_box_anomaly", "grp:s season:s year:i anom:f6", f"""{CUBE},
  b AS (SELECT year, step, avg(value) AS v, avg(value2) AS q FROM cube WHERE row BETWEEN 2 AND 6 AND col BETWEEN 1 AND 7 GROUP BY 1, 2),
  c AS (SELECT *, make_date(year, 1, 1) + CAST(CASE WHEN step < 120 THEN step*3-1
    WHEN (year % 4 = 0 AND year % 100 <> 0) OR year % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS date FROM b),
  l AS (SELECT 'value' AS grp, {season_sql('date')} AS season, year, avg(v) AS v FROM c GROUP BY 1, 2, 3
   UNION ALL SELECT 'quantity', {season_sql('date')}, year, avg(q) FROM c GROUP BY 1, 2, 3),
  z AS (SELECT grp, season, year, (v - avg(v) OVER w)/stddev_samp(v) OVER w AS anom FROM l WINDOW w AS (PARTITION BY grp, season)),
  final AS (SELECT * FROM z UNION ALL SELECT grp, 'All', year, avg(anom) FROM z GROUP BY 1, 3)""", covers="ANM-06 AGG-02 AGG-01 PRJ-06")
def model_box_anomaly(t: Tables):
    from ..operators.grid import box_series

    b = box_series(cube(t), ["value", "value2"], row_range=(2, 6), col_range=(1, 7))
    d = cal.step_date(F.col("year"), F.col("step"))
    long = b.select(cal.season(d).alias("season"), "year", F.inline(F.array(
        F.struct(F.lit("value").alias("grp"), F.col("value").alias("value")),
        F.struct(F.lit("quantity").alias("grp"), F.col("value2").alias("value")))))
    return A.model_only_anomalies(long)


@query("monthly_normalised", "grp:s date:d tow:i from_mean:f4 from_median:f4 norm_mean:f6 norm_median:f6 norm_log:f4", f"""{PAIRED},
  d AS (SELECT * FROM paired),
  mm AS (SELECT grp, month, year, avg(obs) AS v FROM d GROUP BY 1, 2, 3),
  cl AS (SELECT grp, month, avg(v) AS cm, median(v) AS cd FROM mm GROUP BY 1, 2),
  an AS (SELECT grp, avg(cm) AS am, stddev_samp(cm) AS sd, median(cd) AS md FROM cl GROUP BY 1),
  z AS (SELECT d.grp, date, tow, obs - am AS from_mean, obs - md AS from_median, (obs-am)/sd AS norm_mean, (obs-md)/sd AS norm_median FROM d JOIN an USING (grp)),
  final AS (SELECT *, ln(norm_mean - min(norm_mean) OVER (PARTITION BY grp) + 1e-4) AS norm_log FROM z)""", covers="ANM-07")
def monthly_normalised(t: Tables):
    return A.monthly_normalised(paired(t), group="grp", value="obs")


MYSTD = f"""{PAIRED}, my AS (SELECT grp, year, month, avg(ln(greatest(obs, 1e-3))) AS o, avg(ln(greatest(model, 1e-3))) AS m FROM paired GROUP BY 1, 2, 3),
  mo AS (SELECT grp, month, avg(o) AS o, avg(m) AS m FROM my GROUP BY 1, 2),
  st AS (SELECT grp, avg(o) AS oa, stddev_samp(o) AS os, avg(m) AS ma, stddev_samp(m) AS ms FROM mo GROUP BY 1),
  z AS (SELECT grp, year, month, (o-oa)/os AS o, (m-ma)/ms AS m FROM my JOIN st USING (grp)),
  c AS (SELECT *, avg(o) OVER (PARTITION BY grp, month) AS oc, avg(m) OVER (PARTITION BY grp, month) AS mc FROM z)"""


@query("seasonal_check", "grp:s n_month_years:i r_model:f6 r_model_clim:f6 r_obs_clim:f6 r_deseasoned:f6",
       f"{MYSTD}, final AS (SELECT grp, count(*) AS n_month_years, corr(o,m) AS r_model, corr(o,mc) AS r_model_clim, corr(o,oc) AS r_obs_clim, corr(o-oc, m-mc) AS r_deseasoned FROM c GROUP BY 1)",
       covers="ANM-08 WIN-07")
def seasonal_check(t: Tables):
    p = paired(t).withColumns({"o": F.log(F.greatest("obs", F.lit(1e-3))), "m": F.log(F.greatest("model", F.lit(1e-3)))})
    return A.seasonal_check(A.month_year_standardised(p, group="grp", values=["o", "m"]), group="grp", obs="o", model="m")


@query("period_stats", "level:s season:s n:i r:f6 obs_std_pop:f4 model_std_pop:f4 crmse:f4 rmse:f4 bias:f4 mae:f4 wss:f6", f"""{PAIRED},
  m AS (SELECT 'monthly' AS level, {season_sql('make_date(year, month, 1)')} AS season, avg(obs) AS obs, avg(model) AS model FROM paired GROUP BY year, month),
  w0 AS (SELECT isoyear(date) AS iy, weekofyear(date) AS w, avg(obs) AS obs, avg(model) AS model FROM paired GROUP BY 1, 2),
  w1 AS (SELECT *, DATE '2001-01-01' + CAST(least((w-1)*7+3, 364) AS INTEGER) AS mid FROM w0),
  u AS (SELECT * FROM m UNION ALL SELECT 'weekly', {season_sql('mid')}, obs, model FROM w1),
  d AS (SELECT * FROM u UNION ALL SELECT level, 'All', obs, model FROM u), {core(['level', 'season'], 'd')}, final AS (SELECT * FROM agg)""", covers="ANM-09 SKL-04")
def period_stats(t: Tables):
    p = paired(t)
    m = p.groupBy("year", "month").agg(F.avg("obs").alias("obs"), F.avg("model").alias("model"))
    m = m.select(F.lit("monthly").alias("level"), cal.season_of_month(F.col("month")).alias("season"), "obs", "model")
    iso = F.extract(F.lit("YEAROFWEEK"), F.col("date"))
    w = p.groupBy(iso.alias("iy"), F.weekofyear("date").alias("w")).agg(F.avg("obs").alias("obs"), F.avg("model").alias("model"))
    mid = F.date_add(F.lit("2001-01-01").cast("date"), F.least((F.col("w") - 1) * 7 + 3, F.lit(364)))
    w = w.select(F.lit("weekly").alias("level"), cal.season(mid).alias("season"), "obs", "model")
    return K.skill(K.with_overall(m.unionByName(w), "season"), ["level", "season"], "obs", "model", which="centred", min_pairs=2, summary=True)


@query("domain_anomaly", "grp:s season:s seasonal_mean:f4 anomaly:f6", f"""{PAIRED}, x AS (SELECT grp, season, avg(obs) AS seasonal_mean FROM paired GROUP BY 1, 2),
  a AS (SELECT grp, avg(obs) AS m, stddev_samp(obs) AS s FROM paired GROUP BY 1),
  final AS (SELECT grp, season, seasonal_mean, (seasonal_mean - m)/s AS anomaly FROM x JOIN a USING (grp))""", covers="ANM-10")
def domain_anomaly(t: Tables):
    return A.domain_anomalies(paired(t), domain="grp", season="season", value="obs")


@query("domain_zscore", "grp:s season:s z:f6 zz:f6", f"""{PAIRED}, a AS (SELECT grp, avg(obs) AS m, stddev_samp(obs) AS s FROM paired GROUP BY 1),
  z AS (SELECT grp, season, (obs - m)/s AS z FROM paired JOIN a USING (grp)),
  final AS (SELECT grp, season, avg(z) AS z, avg(z*z) AS zz FROM z GROUP BY 1, 2)""", covers="ANM-10 WIN-07")
def domain_zscore(t: Tables):
    z = A.zscore(paired(t), ["grp"], "obs", "z")
    return z.groupBy("grp", "season").agg(F.avg("z").alias("z"), F.avg(F.col("z") * F.col("z")).alias("zz"))


ICES = """s AS (SELECT grp, wy AS year, season, log10(avg(obs)+1e-6) AS l, count(*) AS n FROM (SELECT *, year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS wy FROM paired) GROUP BY 1, 2, 3),
  a AS (SELECT *, l - avg(l) FILTER (year BETWEEN 1996 AND 2000) OVER (PARTITION BY grp, season) AS anom FROM s)"""


@query("ices_anomaly", "grp:s year:i anom:f6 n_seasons:i n_tows:i", f"""{PAIRED}, {ICES},
  final AS (SELECT grp, year, avg(anom) AS anom, count(*) AS n_seasons, sum(n) AS n_tows FROM a GROUP BY 1, 2
   HAVING bool_or(season IN ('Spring', 'Summer')))""", covers="ANM-11 CAL-10")
def ices_anomaly(t: Tables):
    p = paired(t).withColumn("year", cal.winter_year(F.col("date")))
    return A.ices_anomalies(p, keys=["grp"], value="obs", base_years=(1996, 2000))


@query("recipe_search", "unit:s december:s summary:s n:i r:f6 max_diff:f6", f"""{PAIRED},
  ref AS (SELECT year(o_orderdate) AS year, log10(avg(o_totalprice)) - 5.4 AS ref FROM orders GROUP BY 1),
  x AS (SELECT 'obs' AS unit, season, year, month, obs AS v FROM paired UNION ALL SELECT 'model', season, year, month, model FROM paired),
  y AS (SELECT unit, season, 'same year' AS december, year, v FROM x UNION ALL SELECT unit, season, 'next year', year + CASE WHEN month = 12 THEN 1 ELSE 0 END, v FROM x),
  s AS (SELECT unit, december, 'log of mean' AS summary, year, season, log10(avg(v)+1) AS l FROM y GROUP BY 1, 2, 4, 5
   UNION ALL SELECT unit, december, 'mean of logs', year, season, avg(log10(v+1)) FROM y GROUP BY 1, 2, 4, 5),
  a AS (SELECT *, l - avg(l) OVER (PARTITION BY unit, december, summary, season) AS anom FROM s),
  z AS (SELECT unit, december, summary, year, avg(anom) AS anom FROM a GROUP BY 1, 2, 3, 4 HAVING bool_or(season IN ('Spring', 'Summer'))),
  final AS (SELECT unit, december, summary, count(*) AS n, corr(anom, ref) AS r, max(abs(anom-ref)) AS max_diff FROM z JOIN ref USING (year) GROUP BY 1, 2, 3)""",
       covers="ANM-12")
def recipe_search(t: Tables):
    ref = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg((F.log10(F.avg("o_totalprice")) - 5.4).alias("ref"))
    return A.recipe_search(paired(t), ref, date_year="year", month="month", values={"obs": "obs", "model": "model"}, offset=1.0)
