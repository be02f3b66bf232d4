"""Block means, forcing fields and series on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import forcing as FR
from ..operators import grid as GR
from .base import Tables, query
from .bindings import CUBE, DAILY_OBS, STEP_SQL, cube, daily_obs

DAILY = f"{DAILY_OBS}"


@query("block_3day", "year:i step:i mean_v:f4 max_v:f2 n_days:i", f"""{DAILY},
  final AS (SELECT year(date) AS year, {STEP_SQL.format('date')} AS step, avg(obs) AS mean_v, max(obs) AS max_v, count(*) AS n_days FROM daily_obs GROUP BY 1, 2)""", covers="AGG-03 CAL-01")
def block_3day(t: Tables):
    d = daily_obs(t)
    return d.groupBy(F.year("date").alias("year"), cal.model_step(F.col("date")).alias("step")).agg(
        F.avg("obs").alias("mean_v"), F.max("obs").alias("max_v"), F.count(F.lit(1)).alias("n_days"))


@query("block_2_of_3", "year:i step:i value:f4", f"""{DAILY},
  final AS (SELECT year(date) AS year, least((dayofyear(date)-1)//3+1, 121) AS step, avg(obs) AS value FROM daily_obs WHERE (dayofyear(date)-1) % 3 < 2 OR dayofyear(date) > 360 GROUP BY 1, 2)""", covers="AGG-03")
def block_2_of_3(t: Tables):
    return GR.daily_blocks(daily_obs(t), [], "date", "obs", days_used=2, last_step=121).withColumnRenamed("obs", "value")


@query("hourly_daily_monthly", "event_type:s month:i monthly:f6 n_days:i", """
  d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2),
  final AS (SELECT event_type, month(day) AS month, avg(v) AS monthly, count(*) AS n_days FROM d GROUP BY 1, 2)""", covers="AGG-04")
def hourly_daily_monthly(t: Tables):
    m = GR.chained_means(t.events, ["event_type"], "ts", "value", ["hour", "day", "month"])
    return m.select("event_type", F.month("ts").alias("month"), F.col("value").alias("monthly"), F.col("n").alias("n_days"))


@query("year_month_cube", "year:i month:i row:i col:i value:f4", """
  final AS (SELECT year(l_shipdate) AS year, month(l_shipdate) AS month, l_suppkey % 10 AS row, l_partkey % 10 AS col, avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)""", covers="AGG-05")
def year_month_cube(t: Tables):
    d = F.col("l_shipdate")
    return t.lineitem.groupBy(F.year(d).alias("year"), F.month(d).alias("month"), (F.col("l_suppkey") % 10).alias("row"), (F.col("l_partkey") % 10).alias("col")).agg(
        F.avg("l_extendedprice").alias("value"))


@query("period_multipliers", "o_orderpriority:s initial:f4 spinup_mean:f4 spinup_mult:f6 full_mean:f4 full_mult:f6", """
  m AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderdate::DATE BETWEEN '1995-01-01' AND '1995-01-31') AS initial,
    avg(o_totalprice) FILTER (o_orderdate::DATE BETWEEN '1995-01-01' AND '1996-12-31') AS spinup_mean, avg(o_totalprice) FILTER (o_orderdate::DATE BETWEEN '1995-01-01' AND '2001-12-31') AS full_mean FROM orders GROUP BY 1),
  final AS (SELECT *, spinup_mean/initial AS spinup_mult, full_mean/initial AS full_mult FROM m)""", covers="AGG-06")
def period_multipliers(t: Tables):
    d = t.orders.withColumn("date", F.col("o_orderdate").cast("date"))
    return GR.period_multipliers(d, ["o_orderpriority"], "o_totalprice", "date", first=("1995-01-01", "1995-01-31"),
                                 spinup=("1995-01-01", "1996-12-31"), full=("1995-01-01", "2001-12-31"))


PARIN = f"""pin AS (SELECT year(l_shipdate) AS year, {STEP_SQL.format('l_shipdate')} AS step, l_suppkey % 10 AS row, l_partkey % 10 AS col, avg(l_quantity)*8 AS light,
  CASE WHEN min(l_tax) = 0 AND count(*) < 3 THEN 0.0 ELSE 20 + 100*avg(l_tax) END AS sal, 2 + 60*avg(l_discount) AS mix FROM lineitem GROUP BY ALL)"""


def par_inputs(t: Tables):
    d = F.col("l_shipdate")
    sal = F.when((F.min("l_tax") == 0) & (F.count(F.lit(1)) < 3), 0.0).otherwise(20 + 100 * F.avg("l_tax"))
    return t.lineitem.groupBy(
        F.year(d).alias("year"), cal.model_step(d).alias("step"), (F.col("l_suppkey") % 10).alias("row"), (F.col("l_partkey") % 10).alias("col"),
    ).agg((F.avg("l_quantity") * 8).alias("light"), sal.alias("sal"), (2 + 60 * F.avg("l_discount")).alias("mix"))


PAR_SQL = "CASE WHEN sal = 0 THEN 0.0 ELSE light*0.44*(1-0.067)*(1-exp(-greatest(1.94-0.063*sal, 0.05)*mix))/(greatest(1.94-0.063*sal, 0.05)*mix) END"


@query("par_mixing_layer", "year:i step:i row:i col:i par:f3 k:f4", f"""{PARIN},
  final AS (SELECT year, step, row, col, {PAR_SQL} AS par, CASE WHEN sal = 0 THEN 0.0 ELSE greatest(1.94-0.063*sal, 0.05) END AS k FROM pin)""", covers="FRC-01")
def par_mixing_layer(t: Tables):
    p = par_inputs(t)
    return p.withColumns({"par": FR.mean_par(F.col("light"), F.col("sal"), F.col("mix")), "k": FR.attenuation(F.col("sal"))})


@query("par_climatology", "row:i col:i par:f1 k:f2 par_mixing:f0", f"""{PARIN},
  y AS (SELECT row, col, year, avg(light) AS light, avg(sal) AS sal, avg(mix) AS mix FROM pin GROUP BY 1, 2, 3),
  m AS (SELECT row, col, avg(light) AS light, avg(sal) AS sal, avg(mix) AS mix FROM y GROUP BY 1, 2),
  final AS (SELECT row, col, round({PAR_SQL}, 2) AS par, round(greatest(1.94-0.063*sal, 0.05), 3) AS k, round({PAR_SQL}, 2)*mix AS par_mixing FROM m)""", covers="FRC-02 FRC-01")
def par_climatology(t: Tables):
    return FR.par_climatology(par_inputs(t), ["row", "col"], "light", "sal", "mix")


WIND = f"""w AS (SELECT year(d) AS year, {STEP_SQL.format('d')} AS step, cell, sqrt(u*u+v*v) AS s FROM (SELECT CAST(l_shipdate AS DATE) AS d, l_suppkey % 10 AS cell,
    avg(l_quantity) - 25 AS u, 100*avg(l_tax) AS v FROM lineitem GROUP BY ALL)),
  b AS (SELECT year, step, cell, max(s) AS speed, avg(s*s) AS nutrient_stress FROM w GROUP BY 1, 2, 3),
  c AS (SELECT year, step, cell, month(make_date(year, 1, 1) + CAST(step*3-2 AS INTEGER)) BETWEEN 3 AND 10 AS on_, speed, nutrient_stress FROM b),
  wb AS (SELECT year, step, cell, CASE WHEN on_ THEN speed ELSE 0 END AS speed, CASE WHEN on_ THEN speed*speed ELSE 0 END AS stress, CASE WHEN on_ THEN nutrient_stress ELSE 0 END AS nutrient_stress FROM c)"""


def wind(t: Tables):
    d = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("d"), (F.col("l_suppkey") % 10).alias("cell")).agg(
        (F.avg("l_quantity") - 25).alias("u"), (100 * F.avg("l_tax")).alias("v"))
    d = d.withColumns({"year": F.year("d"), "step": cal.model_step(F.col("d"))})
    mid = F.month(F.date_add(F.make_date("year", F.lit(1), F.lit(1)), (F.col("step") * 3 - 2).cast("int")))
    return FR.wind_blocks(d, ["year", "step", "cell"], "u", "v", month=mid, active_months=range(3, 11))


@query("wind_stress", "year:i step:i cell:i speed:f4 stress:f4 nutrient_stress:f4", f"{WIND}, final AS (SELECT * FROM wb)", covers="FRC-03")
def wind_stress(t: Tables):
    return wind(t)


@query("wind_climatology", "cell:i speed:f4 stress:f4", f"{WIND}, final AS (SELECT cell, avg(speed) AS speed, median(stress) AS stress FROM wb GROUP BY 1)", covers="FRC-04")
def wind_climatology(t: Tables):
    return FR.wind_climatology(wind(t), ["cell"])


STATIC = f"{CUBE}, st AS (SELECT row, col, stddev_pop(value2) AS sd FROM cube WHERE year IN (1995, 2000) AND step IN (1, 32, 63, 94) GROUP BY 1, 2)"


@query("static_mask", "row:i col:i sd:f6 is_static:b", f"{STATIC}, final AS (SELECT *, sd < 5 AS is_static FROM st)", covers="FRC-05")
def static_mask(t: Tables):
    return FR.static_cells(cube(t), ["row", "col"], "value2", 5.0, sample=F.col("year").isin(1995, 2000) & F.col("step").isin(1, 32, 63, 94))


FLUX = f"""{CUBE}, s AS (SELECT year, step, avg(value2) AS v FROM cube GROUP BY 1, 2), c AS (SELECT year, step, v, least(v, 26.0) AS m0 FROM s),
  m AS (SELECT *, avg(m0) OVER (ORDER BY year, step ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m1 FROM c), a AS (SELECT avg(m1) AS am FROM m)"""


@query("flux_multiplier", "year:i step:i mult:f5", f"{FLUX}, final AS (SELECT year, step, m1/am AS mult FROM m, a)", covers="FRC-06 WIN-01 AGG-01 PRJ-09")
def flux_multiplier(t: Tables):
    s = GR.spatial_reduce(cube(t), ["value2"], ["year", "step"])
    return FR.multiplier_series(s, "value2", cap=26.0, digits=12)


@query("flux_field", "year:i step:i row:i col:i mult:f5 is_static:b", f"""{CUBE}, st AS (SELECT row, col, stddev_pop(value2) < 9 AS is_static FROM cube GROUP BY 1, 2),
  d AS (SELECT year, step, row, col, is_static, row = 0 AS masked, CASE WHEN NOT is_static AND row <> 0 THEN ln(least(value2, 40.0) + 1) END AS m FROM cube JOIN st USING (row, col)),
  e AS (SELECT *, row_number() OVER w AS i, count(*) OVER c AS n, first_value(m) OVER f AS m_first, last_value(m) OVER f AS m_last,
    coalesce(sum(m) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS sm, count(m) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cm FROM d
    WINDOW w AS (PARTITION BY row, col ORDER BY year, step), c AS (PARTITION BY row, col), f AS (PARTITION BY row, col ORDER BY year, step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  g AS (SELECT year, step, row, col, is_static, masked, CASE WHEN m_first IS NOT NULL THEN (sm + greatest(0, 2-(i-1))*m_first + greatest(0, 2-(n-i))*m_last)/(cm + greatest(0, 2-(i-1)) + greatest(0, 2-(n-i))) END AS m FROM e),
  a AS (SELECT avg(m) AS am FROM g),
  final AS (SELECT year, step, row, col, is_static, CASE WHEN masked THEN -9999.0 WHEN is_static THEN 1.0 ELSE m/am END AS mult FROM g, a)""", covers="FRC-07 WIN-02 FRC-05")
def flux_field(t: Tables):
    c = cube(t)
    st = FR.static_cells(c, ["row", "col"], "value2", 9.0)
    return FR.multiplier_field(c, ["row", "col"], "value2", cap=40.0, log_eps=1.0, half=2, static=st, masked=F.col("row") == 0)


@query("flux_field_per_cell", "year:i step:i row:i col:i mult:f5", f"""{CUBE}, a AS (SELECT row, col, avg(pow(least(value2, 40.0), 1.5)) AS am FROM cube GROUP BY 1, 2),
  final AS (SELECT year, step, row, col, pow(least(value2, 40.0), 1.5)/am AS mult FROM cube JOIN a USING (row, col))""", covers="FRC-07")
def flux_field_per_cell(t: Tables):
    return FR.multiplier_field(cube(t), ["row", "col"], "value2", cap=40.0, exponent=1.5, per_cell=True)


CLIM = f"{CUBE}, cl AS (SELECT step, row, col, avg(value) AS clim FROM cube GROUP BY 1, 2, 3)"


@query("step_climatology", "step:i row:i col:i clim:f4", f"{CLIM}, final AS (SELECT * FROM cl)", covers="FRC-08")
def step_climatology(t: Tables):
    return FR.step_climatology(cube(t), ["row", "col"], "value")


@query("month_climatology", "month:i row:i col:i clim:f4", f"{CLIM}, final AS (SELECT CASE WHEN step <= 100 THEN (step-1)//10+1 WHEN step <= 111 THEN 11 ELSE 12 END AS month, row, col, avg(clim) AS clim FROM cl GROUP BY ALL)", covers="FRC-08")
def month_climatology(t: Tables):
    return FR.month_climatology(FR.step_climatology(cube(t), ["row", "col"], "value"), ["row", "col"])


SCALED = f"""{CLIM}, an AS (SELECT year, step, row, col, value - clim AS a FROM cube JOIN cl USING (step, row, col)), mx AS (SELECT max(abs(a)) AS s FROM an),
  sc AS (SELECT year, step, row, col, greatest(0.0, least(2.0, 1 + a/s)) AS scaled FROM an, mx)"""


def scaled(t: Tables):
    c = cube(t)
    return FR.scaled_anomaly(c, FR.step_climatology(c, ["row", "col"], "value"), ["row", "col"], "value")


@query("scaled_anomaly", "year:i step:i row:i col:i scaled:f6", f"{SCALED}, final AS (SELECT * FROM sc)", covers="FRC-09")
def scaled_anomaly(t: Tables):
    return scaled(t)


@query("scaled_anomaly_mean", "row:i col:i scaled:f6", f"{SCALED}, final AS (SELECT row, col, avg(scaled) AS scaled FROM sc GROUP BY 1, 2)", covers="FRC-10")
def scaled_anomaly_mean(t: Tables):
    return scaled(t).groupBy("row", "col").agg(F.avg("scaled").alias("scaled"))


@query("domain_mean_nonzero", "year:i step:i value:f4", f"{CUBE}, final AS (SELECT year, step, avg(CASE WHEN value2 >= 15 THEN value END) AS value FROM cube GROUP BY 1, 2)", covers="FRC-11 SRC-04")
def domain_mean_nonzero(t: Tables):
    land = cube(t).withColumn("value", F.when(F.col("value2") >= 15, F.col("value")).otherwise(0.0))
    return FR.domain_mean_nonzero(land, ["year", "step"], "value")


@query("step_profile", "step:i mean:f4 p10:f4 p90:f4", f"{CUBE}, s AS (SELECT year, step, avg(value) AS v FROM cube GROUP BY 1, 2), final AS (SELECT step, avg(v) AS mean, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90 FROM s GROUP BY 1)", covers="FRC-12 AGG-24")
def step_profile(t: Tables):
    return FR.day_profile(GR.spatial_reduce(cube(t), ["value"], ["year", "step"]), "step", "value")


SER = f"s AS (SELECT year(date) AS year, {STEP_SQL.format('date')} AS step, avg(obs) AS v FROM daily_obs GROUP BY 1, 2)"


def step_series(t: Tables):
    return daily_obs(t).groupBy(F.year("date").alias("year"), cal.model_step(F.col("date")).alias("step")).agg(F.avg("obs").alias("v"))


@query("spinup_prepend", "index:i year:i step:i v:f4", f"""{DAILY}, {SER},
  h AS (SELECT y AS year, step, v FROM s, (VALUES (1993), (1994)) t(y) WHERE year = 1995 UNION ALL SELECT * FROM s), m AS (SELECT round(avg(v) + 3e-5, 2) AS m FROM s),
  n AS (SELECT *, row_number() OVER (ORDER BY year, step) AS index FROM h), final AS (SELECT index, year, step, CASE WHEN index <= 12 THEN m ELSE v END AS v FROM n, m)""", covers="CAL-15")
def spinup_prepend(t: Tables):
    return FR.spinup_copy(step_series(t), "v", first_year=1995, spin_years=[1993, 1994])


@query("spinup_climatology", "index:i year:i step:i v:f4", f"""{DAILY}, {SER}, c AS (SELECT step, avg(v) AS v FROM s GROUP BY 1),
  h AS (SELECT y AS year, step, v FROM c, (VALUES (1993), (1994)) t(y) UNION ALL SELECT year, step, v FROM s), final AS (SELECT *, row_number() OVER (ORDER BY year, step) AS index FROM h)""", covers="CAL-15")
def spinup_climatology(t: Tables):
    return FR.spinup_climatology(step_series(t), "v", spin_years=[1993, 1994], digits=9)


@query("series_export", "row:i index:i year:i step:i v:f4", f"""{DAILY}, {SER}, n AS (SELECT *, row_number() OVER (ORDER BY year, step) AS index FROM s),
  final AS (SELECT (index-1)*12 + k AS row, index, year, step, v FROM n, range(1, 13) r(k))""", covers="SNK-05")
def series_export(t: Tables):
    return FR.series_export(step_series(t), "v")
