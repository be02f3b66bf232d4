"""Calendar columns, series windows, text grids and regression on the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..functions import calendar as cal
from ..functions import clean as C
from ..operators import quantiles as Q
from ..operators import regression as R
from ..operators import series as SR
from ..operators import skill as K
from ..sources import grids as G
from ..sources import tables as TB
from .base import Tables, query, stage
from .bindings import CUBE, DAILY_OBS, MODEL_SERIES, PAIRED, cube, daily_obs, model_series, paired, season_sql
from .least_squares import ols_sql
from .skill_reports import P_SQL
from .spatial import WINDOW_SQL, window_index

BIN_MID = "DATE '2001-01-01' + CAST(least((b-1)*14+8, 365) - 1 AS INTEGER)"


@query("calendar_columns", """d:d step:i centre:i centre_date:d block:s biweek:i biweek_capped:i week8:i djf:s nov_feb:s quarters:s mid_month:s nov_winter:s single:s
  day_of_season:i winter_year:i biweek_season:s half_month:i""", f"""
  x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
  y AS (SELECT d, least((dayofyear(d)-1)//3+1, 120) AS step, (dayofyear(d)-1)//14+1 AS b, least((dayofyear(d)-1)//8, 45) AS week8, month(d)*100+day(d) AS md, month(d) AS m, year(d) AS yr FROM x),
  z AS (SELECT *, CASE WHEN step < 120 THEN step*3-1 WHEN (yr % 4 = 0 AND yr % 100 <> 0) OR yr % 400 = 0 THEN 361 ELSE 360 END AS centre, least(DATE '2001-01-01' + CAST(week8*8+4 AS INTEGER), DATE '2001-12-31') AS wm FROM y),
  final AS (SELECT d, step, centre, make_date(yr, 1, 1) + CAST(centre-1 AS INTEGER) AS centre_date, strftime(d, '%Y') || '-' || lpad(CAST((dayofyear(d)-1)//3+1 AS VARCHAR), 3, '0') AS block, b AS biweek, least(b, 26) AS biweek_capped, week8,
   {season_sql('d')} AS djf, CASE WHEN m IN (11,12,1,2) THEN 'Winter' WHEN m IN (3,4,5) THEN 'Spring' WHEN m IN (6,7,8) THEN 'Summer' END AS nov_feb,
   CASE WHEN m <= 3 THEN 'Winter' WHEN m <= 6 THEN 'Spring' WHEN m <= 9 THEN 'Summer' ELSE 'Fall' END AS quarters,
   CASE WHEN md >= 1116 OR md <= 301 THEN 'Winter' WHEN md < 601 THEN 'Spring' WHEN md <= 915 THEN 'Summer' ELSE 'Fall' END AS mid_month,
   CASE WHEN m IN (11,12,1,2) THEN 'Winter' WHEN m IN (3,4,5) THEN 'Spring' WHEN m IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS nov_winter,
   CASE m WHEN 1 THEN 'Winter' WHEN 4 THEN 'Spring' WHEN 7 THEN 'Summer' WHEN 10 THEN 'Fall' END AS single,
   dayofyear(d) - CASE WHEN m = 12 THEN 365 ELSE 0 END AS day_of_season, yr + CASE WHEN m = 12 THEN 1 ELSE 0 END AS winter_year, {season_sql(BIN_MID)} AS biweek_season,
   (month(wm)-1)*2 + CASE WHEN day(wm) <= 15 THEN 1 ELSE 2 END AS half_month FROM z)""",
       covers="CAL-01 CAL-03 CAL-04 CAL-05 CAL-06 CAL-07 CAL-08 CAL-09 CAL-10 CAL-13")
def calendar_columns(t: Tables):
    x = t.orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    d, y = F.col("d"), F.year("d")
    x = x.withColumn("step", cal.model_step(d))
    return x.withColumns({
        "centre": cal.step_centre_doy(y, F.col("step")), "centre_date": cal.step_date(y, F.col("step")), "block": cal.block_label(d),
        "biweek": cal.biweek(d), "biweek_capped": cal.biweek(d, 26), "week8": cal.week8(d), "djf": cal.season(d), "nov_feb": cal.season(d, "nov_feb"),
        "quarters": cal.season(d, "quarters"), "mid_month": cal.season(d, "mid_month"), "nov_winter": cal.season(d, "nov_winter"), "single": cal.season(d, "single_month"),
        "day_of_season": cal.day_of_season(d), "winter_year": cal.winter_year(d), "biweek_season": cal.season_of_biweek(cal.biweek(d)),
        "half_month": cal.week_block(cal.week8(d), "half")})


@query("series_dates", "timestep:i date:d season:s", f"""x AS (SELECT DISTINCT o_orderkey % 4920 + 1 AS timestep FROM orders),
  y AS (SELECT timestep, make_date(1978 + (timestep-1)//120, 1, 1) + CAST(((timestep-1) % 120)*3 + 1 AS INTEGER) AS date FROM x), final AS (SELECT *, {season_sql('date')} AS season FROM y)""", covers="CAL-02")
def series_dates(t: Tables):
    x = t.orders.select((F.col("o_orderkey") % 4920 + 1).alias("timestep")).distinct()
    return x.withColumn("date", cal.series_step_date(F.col("timestep"), 1978)).withColumn("season", cal.season(F.col("date")))


@query("infer_season", "season:s n:i", f"""x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN ' winter ' END AS s, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END AS d, CASE WHEN o_totalprice > 250000 THEN o_orderdate + INTERVAL 40 DAY END AS mt, (dayofyear(o_orderdate)-1)//14+1 AS b FROM orders),
  y AS (SELECT CASE WHEN s IS NOT NULL THEN 'Winter' WHEN d IS NOT NULL THEN {season_sql('d')} WHEN mt IS NOT NULL THEN {season_sql('mt')} ELSE {season_sql(BIN_MID)} END AS season FROM x), final AS (SELECT season, count(*) AS n FROM y GROUP BY 1)""", covers="CAL-08 PRJ-17")
def infer_season(t: Tables):
    d = F.col("o_orderdate").cast("date")
    s = cal.infer_season(F.when(F.col("o_orderstatus") == "F", " winter "), F.when(F.col("o_orderstatus") == "O", d),
                         F.when(F.col("o_totalprice") > 250000, F.date_add(d, 40)), cal.biweek(d))
    return t.orders.groupBy(s.alias("season")).agg(F.count(F.lit(1)).alias("n"))


@query("median_timestamp", "user_id:i ts:t", "x AS (SELECT user_id, floor(median(epoch_us(ts) - 1500000000000000))::BIGINT + 1500000000000000 AS us FROM events GROUP BY 1), final AS (SELECT user_id, make_timestamp(us) AS ts FROM x)", covers="CAL-14")
def median_timestamp(t: Tables):
    return Q.median_timestamp(t.events, ["user_id"], "ts", "ts")


@query("quantiles", "l_returnflag:s q10:f4 q25:f4 q50:f4 q75:f4 q90:f4", """final AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
  quantile_cont(l_extendedprice, 0.75) AS q75, quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY 1)""", covers="AGG-24")
def quantiles(t: Tables):
    return Q.grouped_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9})


@query("clip_log_power", "o_orderkey:i capped:f2 ln:f6 lg:f6 l1p:f6 pw:f4", """final AS (SELECT o_orderkey, least(greatest(o_totalprice - 100000, 0), 250000) AS capped, ln(o_totalprice + 1e-4) AS ln, log10(o_totalprice + 1e-6) AS lg, ln(1 + o_totalprice) AS l1p, pow(o_totalprice, 0.5) AS pw FROM orders)""", covers="PRJ-09")
def clip_log_power(t: Tables):
    v = F.col("o_totalprice")
    return t.orders.select("o_orderkey", C.clip(v - 100000, 0, 250000).alias("capped"), C.log_offset(v, "ln", 1e-4).alias("ln"),
                           C.log_offset(v, "log10", 1e-6, strict=True).alias("lg"), F.log1p(v).alias("l1p"), C.power(v, 0.5).alias("pw"))


@query("text_to_number", "event_type:s n:i n_bad:i total:f2", """x AS (SELECT event_type, CASE WHEN value > 100 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS s FROM events), final AS (SELECT event_type, count(*) AS n, count(*) FILTER (TRY_CAST(s AS DOUBLE) IS NULL) AS n_bad, sum(TRY_CAST(s AS DOUBLE)) AS total FROM x GROUP BY 1)""", covers="PRJ-16")
def text_to_number(t: Tables):
    s = F.when(F.col("value") > 100, "n/a").otherwise(F.col("value").cast("string"))
    d = t.events.select("event_type", C.to_number(s).alias("v"))
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnull("v")).alias("n_bad"), F.sum("v").alias("total"))


@query("step_changes", "n:i median:f4 p90:f4 max:f4", f"{MODEL_SERIES}, c AS (SELECT abs(model - lag(model) OVER (ORDER BY mdate)) AS a FROM model_series), final AS (SELECT count(a) AS n, median(a) AS median, quantile_cont(a, 0.9) AS p90, max(a) AS max FROM c)", covers="WIN-05 AGG-24")
def step_changes(t: Tables):
    return SR.change_summary(SR.step_changes(model_series(t), [], "mdate", "model"), [])


@query("step_percent_changes", "grp:s year:i change:f0 pct_change:f4", f"{PAIRED}, y AS (SELECT grp, year, sum(obs) AS v FROM paired GROUP BY 1, 2), final AS (SELECT grp, year, v - lag(v) OVER w AS change, (v - lag(v) OVER w)/lag(v) OVER w*100 AS pct_change FROM y WINDOW w AS (PARTITION BY grp ORDER BY year))", covers="WIN-05")
def step_percent_changes(t: Tables):
    y = paired(t).groupBy("grp", "year").agg(F.sum("obs").alias("v"))
    return SR.step_changes(y, ["grp"], "year", "v")


@query("detrended_agreement", "grp:s r_raw:f6 r_detrended:f6 r_diff:f6", f"""{PAIRED}, y AS (SELECT grp, year, avg(obs) AS o, avg(model) AS m FROM paired GROUP BY 1, 2),
  l AS (SELECT grp, regr_slope(o, year) AS so, regr_intercept(o, year) AS io, regr_slope(m, year) AS sm, regr_intercept(m, year) AS im FROM y GROUP BY 1),
  d AS (SELECT y.grp, o, m, o - so*year - io AS od, m - sm*year - im AS md, o - lag(o) OVER w AS of, m - lag(m) OVER w AS mf FROM y JOIN l USING (grp) WINDOW w AS (PARTITION BY y.grp ORDER BY year)),
  final AS (SELECT grp, corr(o, m) AS r_raw, corr(od, md) AS r_detrended, corr(of, mf) AS r_diff FROM d GROUP BY 1)""", covers="WIN-08")
def detrended_agreement(t: Tables):
    y = paired(t).groupBy("grp", "year").agg(F.avg("obs").alias("o"), F.avg("model").alias("m"))
    d = SR.first_differences(SR.detrended(y, ["grp"], "year", ["o", "m"]), ["grp"], "year", ["o", "m"])
    return d.groupBy("grp").agg(pearson("o", "m").alias("r_raw"), pearson("o_detrended", "m_detrended").alias("r_detrended"), pearson("o_diff", "m_diff").alias("r_diff"))


@query("lagged_index", "year:i index:f4 lagged:f4", "y AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) AS index FROM orders WHERE month(o_orderdate) IN (3, 4, 5) GROUP BY 1), final AS (SELECT y.year, y.index, p.index AS lagged FROM y LEFT JOIN y p ON p.year = y.year - 1)", covers="SRC-13")
def lagged_index(t: Tables):
    s = t.orders.where(F.month("o_orderdate").isin(3, 4, 5)).withColumn("year", F.year("o_orderdate"))
    return SR.lagged_index(s, "year", "o_totalprice", 1)


@query("first_records", "grp:i o_orderdate:d o_orderkey:i", "final AS (SELECT o_custkey AS grp, min(o_orderdate) AS o_orderdate, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1)", covers="WIN-06")
def first_records(t: Tables):
    d = t.orders.select(F.col("o_custkey").alias("grp"), "o_orderdate", "o_orderkey").withColumn("k", F.struct("o_orderdate", "o_orderkey"))
    return SR.first_records(d, ["grp"], "k", ["o_orderdate", "o_orderkey"])


# ---- text grids -----------------------------------------------------------------------------------------

ASC_HEAD = "ncols %d\nnrows %d\nxllcorner -125.5\nyllcorner 48.0\ncellsize 0.1\nNODATA_value -9999\n"
ASCF = f"""{CUBE}, yr AS (SELECT year, row, col, avg(value) AS value FROM cube GROUP BY 1, 2, 3),
  rows_ AS (SELECT year, row, string_agg(CAST(CAST(round(value + 3e-5, 2) AS DECIMAL(18, 2)) AS VARCHAR), ' ' ORDER BY col) AS line FROM yr WHERE row BETWEEN 1 AND 7 AND col BETWEEN 0 AND 7 GROUP BY 1, 2)"""


# The whole grid: a cell without a value in a year holds the header's NODATA_value.
ASC_FULL = f"""{CUBE}, yr AS (SELECT year, row, col, round(avg(value) + 3e-5, 2) AS value FROM cube GROUP BY 1, 2, 3),
  axis AS (SELECT year, row, col FROM (SELECT DISTINCT year FROM yr), (SELECT unnest(range(max(row) + 1)) AS row FROM yr), (SELECT unnest(range(max(col) + 1)) AS col FROM yr)),
  full_ AS (SELECT year, row + 1 AS row, col + 1 AS col, coalesce(value, -9999) AS value FROM axis LEFT JOIN yr USING (year, row, col))"""


def year_grid(t: Tables):
    g = cube(t).groupBy("year", "row", "col").agg(F.avg("value").alias("value"))
    return g.withColumn("value", F.round(F.col("value") + 3e-5, 2))


@query("asc_lines", "year:i line_no:i line:s", f"{ASCF}, final AS (SELECT year, -row AS line_no, line FROM rows_)", covers="SNK-01")
def asc_lines(t: Tables):
    return G.asc_lines(year_grid(t), ["year"], row_range=(1, 7), col_range=(0, 7), reverse_rows=True)


def asc_texts(t: Tables):
    """One text per year with all rows and columns of the grid; cells without a value hold the header's NODATA_value."""
    g = stage(year_grid(t))
    size = g.agg(F.max("row").alias("r"), F.max("col").alias("c"))
    cells = size.select(F.explode(F.sequence(F.lit(0), "r")).alias("row"), "c").select("row", F.explode(F.sequence(F.lit(0), "c")).alias("col"))
    full = g.select("year").distinct().crossJoin(cells).join(g, ["year", "row", "col"], "left")
    lines = G.asc_lines(full, ["year"], fill=-9999)
    body = lines.groupBy("year").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    name = F.concat(F.lit("/in/price_"), F.col("year"), F.lit("_02.asc"))
    head = F.format_string(ASC_HEAD, F.size(F.split(F.col("l")[0].line, " ")), F.size("l"))
    return body.select(name.alias("file"), F.concat(head, F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("text"))


@query("asc_parse", "var:s year:i step:i row:i col:i value:f2", f"{ASC_FULL}, final AS (SELECT 'price' AS var, year, 1 AS step, row, col, value FROM full_)", covers="SRC-01 SRC-02")
def asc_parse(t: Tables):
    return G.with_step(G.parse_asc(asc_texts(t)))


@query("asc_headers", "file:s ncols:i nrows:i xllcorner:f2 yllcorner:f2 cellsize:f2 nodata_value:f0", f"{ASC_FULL}, final AS (SELECT '/in/price_' || year || '_02.asc' AS file, max(col) AS ncols, max(row) AS nrows, -125.5 AS xllcorner, 48.0 AS yllcorner, 0.1 AS cellsize, -9999 AS nodata_value FROM full_ GROUP BY year)", covers="SRC-01")
def asc_headers(t: Tables):
    return G.asc_header(asc_texts(t))


@query("grid_cube", "year:i row:i col:i lat:f2 value:f2", f"""{ASC_FULL}, g AS (SELECT p_partkey % 10 + 1 AS row, (p_partkey // 10) % 10 + 1 AS col, min(48.0 + (p_partkey % 10)/100) AS lat FROM part GROUP BY 1, 2),
  final AS (SELECT year, row, col, lat, CASE WHEN value NOT IN (-9999, 0) THEN value END AS value FROM full_ JOIN g USING (row, col))""", covers="SRC-05 SRC-04")
def grid_cube(t: Tables):
    # 1-based codes, as a text grid is read.
    g = t.part.groupBy((F.col("p_partkey") % 10 + 1).cast("int").alias("row"), (F.floor(F.col("p_partkey") / 10) % 10 + 1).cast("int").alias("col")).agg(
        F.min(F.lit(48.0) + (F.col("p_partkey") % 10) / 100).alias("lat"))
    return G.build_cube(G.with_step(G.parse_asc(asc_texts(t))), g)


@query("survey_union", "dataset:s n:i lat:f4 depth:f4 value:f4 n_dates:i", """
  a AS (SELECT 'one' AS dataset, 48.0 + (c_custkey % 200)/100 AS lat, CASE WHEN o_orderkey % 5 = 0 THEN 0.1 ELSE o_orderkey % 5 END::DOUBLE AS depth, o_totalprice AS value, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey),
  b AS (SELECT 'two', 48.0 + (s_suppkey % 200)/100, CASE WHEN l_linenumber = 1 THEN 0.1 ELSE l_linenumber - 1 END::DOUBLE, l_extendedprice, CAST(l_shipdate AS DATE) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  final AS (SELECT dataset, count(*) AS n, avg(lat) AS lat, avg(depth) AS depth, avg(value) AS value, count(DISTINCT date) AS n_dates FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1)""", covers="SRC-09 SET-01 PRJ-16")
def survey_union(t: Tables):
    a = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit('"'), (F.lit(48.0) + (F.col("c_custkey") % 200) / 100).cast("string"), F.lit('"')).alias("Lat"),
        F.lit("-125").alias("Lon"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("Day"), (F.col("o_orderkey") % 5).cast("string").alias("z"), F.col("o_totalprice").cast("string").alias("NO3"))
    b = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.lit(48.0) + (F.col("s_suppkey") % 200) / 100).cast("string").alias("latitude"), F.lit("-125").alias("longitude"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), (F.col("l_linenumber") - 1).cast("string").alias("depth"), F.col("l_extendedprice").cast("string").alias("nitrogen"))
    u = TB.union_surveys([
        TB.normalise_survey(a, "one", {"lat": "Lat", "lon": "Lon", "date": "Day", "depth": "z", "value": "NO3"}, date_format="yyyy/MM/dd"),
        TB.normalise_survey(b, "two", {"lat": "latitude", "lon": "longitude", "date": "date", "depth": "depth", "value": "nitrogen"})])
    return u.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("depth").alias("depth"), F.avg("value").alias("value"), F.countDistinct("date").alias("n_dates"))


# ---- regression -----------------------------------------------------------------------------------------

# Orthogonal polynomials by successive projection give the cubic residual in SQL.
DOS = f"""{PAIRED}, d0 AS (SELECT *, (dayofyear(date) - CASE WHEN month = 12 THEN 365 ELSE 0 END)/100.0::DOUBLE AS x, log10(obs + 1e-6) AS y, log10(model + 1) AS y2 FROM paired),
  d1 AS (SELECT *, x - avg(x) OVER w AS u1 FROM d0 WINDOW w AS (PARTITION BY season, grp)),
  d2 AS (SELECT *, u1*u1 - avg(u1*u1) OVER w - u1*sum(u1*u1*u1) OVER w/sum(u1*u1) OVER w AS u2 FROM d1 WINDOW w AS (PARTITION BY season, grp)),
  d3 AS (SELECT *, u1*u1*u1 - avg(u1*u1*u1) OVER w - u1*sum(u1*u1*u1*u1) OVER w/sum(u1*u1) OVER w - u2*sum(u1*u1*u1*u2) OVER w/sum(u2*u2) OVER w AS u3 FROM d2 WINDOW w AS (PARTITION BY season, grp)),
  d4 AS (SELECT *, y - avg(y) OVER w - u1*sum(y*u1) OVER w/sum(u1*u1) OVER w - u2*sum(y*u2) OVER w/sum(u2*u2) OVER w - u3*sum(y*u3) OVER w/sum(u3*u3) OVER w AS res,
    y2 - avg(y2) OVER w - u1*sum(y2*u1) OVER w/sum(u1*u1) OVER w - u2*sum(y2*u2) OVER w/sum(u2*u2) OVER w - u3*sum(y2*u3) OVER w/sum(u3*u3) OVER w AS res2 FROM d3 WINDOW w AS (PARTITION BY season, grp))"""


def with_day(t: Tables):
    return paired(t).withColumns({"dos": cal.day_of_season(F.col("date")), "y": F.log10(F.col("obs") + 1e-6), "y2": F.log10(F.col("model") + 1)})


@query("poly_residual", "season:s grp:s year:i n:i res:f6 sq:f6", f"{DOS}, final AS (SELECT season, grp, year, count(*) AS n, avg(res) AS res, avg(res*res) AS sq FROM d4 GROUP BY 1, 2, 3)", covers="REG-01")
def poly_residual(t: Tables):
    d = R.poly_residuals(with_day(t), ["season", "grp"], "dos", ["y"])
    return d.groupBy("season", "grp", "year").agg(F.count(F.lit(1)).alias("n"), F.avg("y_res").alias("res"), F.avg(F.col("y_res") * F.col("y_res")).alias("sq"))


# Middle day of each season on the day-of-season scale.
SEASON_MID = {"Winter": 15, "Spring": 105, "Summer": 197, "Fall": 289}


def residual_years(t: Tables):
    mid = F.coalesce(*[F.when(F.col("season") == s, F.lit(m)) for s, m in SEASON_MID.items()])
    return R.yearly_residuals(with_day(t), ["season", "grp"], "dos", ["y", "y2"], centre=mid, scale=45.0)


@query("residual_years", "season:s grp:s year:i n_tows:i mean_dos:f4 y_res:f6 y2_res:f6 y_mean:f6", f"{DOS}, final AS (SELECT season, grp, year, count(DISTINCT tow) AS n_tows, avg(x)*100 AS mean_dos, avg(res) AS y_res, avg(res2) AS y2_res, avg(y) AS y_mean FROM d4 GROUP BY 1, 2, 3)", covers="ANM-14 ANM-13 REG-01")
def residual_years_q(t: Tables):
    return residual_years(t)


@query("day_adjusted_anomaly", "season:s grp:s year:i obs_anom:f5 model_anom:f5 obs_unadj:f6", f"""{DOS}, a AS (SELECT season, grp, year, avg(res) AS o, avg(res2) AS m, avg(y) AS u, count(DISTINCT tow) AS n FROM d4 GROUP BY 1, 2, 3),
  final AS (SELECT season, grp, year, (o - avg(o) FILTER (n >= 3) OVER w)/stddev_samp(o) FILTER (n >= 3) OVER w AS obs_anom, (m - avg(m) FILTER (n >= 3) OVER w)/stddev_samp(m) FILTER (n >= 3) OVER w AS model_anom,
   (u - avg(u) FILTER (n >= 3) OVER w)/stddev_samp(u) FILTER (n >= 3) OVER w AS obs_unadj FROM a WINDOW w AS (PARTITION BY season, grp))""", covers="ANM-13 REG-01 ANM-02")
def day_adjusted_anomaly(t: Tables):
    from ..operators.anomaly import zscore_bounded

    good, k = F.col("n_tows") >= 3, ["season", "grp"]
    return residual_years(t).withColumns({"obs_anom": zscore_bounded(k, "y_res", good), "model_anom": zscore_bounded(k, "y2_res", good), "obs_unadj": zscore_bounded(k, "y_mean", good)})


@query("residual_correlation", "season:s grp:s r_raw:f6 r_removed:f6", f"{DOS}, final AS (SELECT season, grp, corr(y, y2) AS r_raw, corr(res, res2) AS r_removed FROM d4 GROUP BY 1, 2)", covers="SKL-11")
def residual_correlation(t: Tables):
    d = R.poly_residuals(with_day(t), ["season", "grp"], "dos", ["y", "y2"])
    return d.groupBy("season", "grp").agg(pearson("y", "y2").alias("r_raw"), pearson("y_res", "y2_res").alias("r_removed"))


@query("year_index", "grp:s year:i index:f6", f"""{PAIRED}, d AS (SELECT grp, year, log10(obs) AS y, (dayofyear(date)-1)::DOUBLE AS x FROM paired), m AS (SELECT grp, year, avg(y) AS my, avg(x) AS mx FROM d GROUP BY 1, 2),
  b AS (SELECT grp, sum((y-my)*(x-mx))/sum((x-mx)^2) AS b FROM d JOIN m USING (grp, year) GROUP BY 1), e AS (SELECT grp, year, my - b*mx AS e FROM m JOIN b USING (grp)),
  final AS (SELECT grp, year, e - avg(e) OVER (PARTITION BY grp) AS index FROM e)""", covers="REG-02")
def year_index(t: Tables):
    d = paired(t).withColumns({"y": F.log10("obs"), "x": (F.dayofyear("date") - 1) / 100})
    return R.year_index(d, ["grp"], "y", models=[R.Terms(factors=("year",), numeric=("x",))])


STATION_TERMS = R.Terms(factors=("station", "year", "month"), name="station")


# A baseline level has the effect 0; the mean over all levels is taken off.
STATIONS_SQL = f"""RECURSIVE sr AS (SELECT l_suppkey AS station, year(l_shipdate) AS year, month(l_shipdate) AS month, log10(l_extendedprice) AS lo, log10(l_quantity*1500 + l_tax*200000) AS lm FROM lineitem),
  {ols_sql('o_', 'sr', [], 'lo', [STATION_TERMS])}, {ols_sql('m_', 'sr', [], 'lm', [STATION_TERMS])},
  st AS (SELECT DISTINCT 'station=' || station AS t FROM sr), ef AS (SELECT t, coalesce(o.beta, 0) AS o, coalesce(m.beta, 0) AS m FROM st LEFT JOIN o_effect o USING (t) LEFT JOIN m_effect m USING (t))"""


def station_rows(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
                             F.log10("l_extendedprice").alias("lo"), F.log10(F.col("l_quantity") * 1500 + F.col("l_tax") * 200000).alias("lm"))


def both_station_effects(t: Tables):
    d = station_rows(t)
    o, m = (R.absorbed_effects(d, [], y, STATION_TERMS, "station").select("level", F.col("effect").alias(a)) for y, a in (("lo", "o"), ("lm", "m")))
    return o.join(m, "level")


@query("station_effects", "r:f4 n:i sd_obs:f4 sd_model:f4", f"{STATIONS_SQL}, final AS (SELECT corr(o, m) AS r, count(*) AS n, stddev_samp(o) AS sd_obs, stddev_samp(m) AS sd_model FROM ef)", covers="REG-03 REG-02")
def station_effects(t: Tables):
    return both_station_effects(t).agg(pearson("o", "m").alias("r"), F.count(F.lit(1)).alias("n"), F.stddev_samp("o").alias("sd_obs"), F.stddev_samp("m").alias("sd_model"))


@query("station_effect_table", "station:s obs:f5 model:f5", f"{STATIONS_SQL}, final AS (SELECT substr(t, 9) AS station, o - avg(o) OVER () AS obs, m - avg(m) OVER () AS model FROM ef)", covers="REG-03")
def station_effect_table(t: Tables):
    return both_station_effects(t).select(F.col("level").alias("station"), F.col("o").alias("obs"), F.col("m").alias("model"))


RR = """rr AS (SELECT p.*, split_part(o_orderpriority, '-', 1) AS net, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS night, log10(obs) - log10(model + 1) AS lr,
    dayofyear(date) - CASE WHEN p.month = 12 THEN 365 ELSE 0 END AS dos, log10(p.month + 1.0) AS lrng, log10(obs) AS lo, log10(model + 1) AS lm, log10(obs + 1e-6) AS ly FROM paired p JOIN orders ON o_orderkey = tow)"""
RATIO_SQL = f"{PAIRED}, {RR}"


def ratio_rows(t: Tables):
    """Tow-level pairs with the covariates of their tow. What follows from the date is derived after the join, so it is not shuffled."""
    o = t.orders.select(F.col("o_orderkey").alias("tow"), F.split("o_orderpriority", "-")[0].alias("net"), (F.col("o_orderstatus") == "F").cast("double").alias("night"))
    d = F.col("date")
    return paired(t).select("tow", "date", "grp", "obs", "model").join(o, "tow").withColumns(
        {"year": F.year(d), "month": F.month(d), "season": cal.season(d), "lr": F.log10("obs") - F.log10(F.col("model") + 1),
         "lo": F.log10("obs"), "lm": F.log10(F.col("model") + 1), "dos": cal.day_of_season(d).cast("double")}).withColumn("lrng", F.log10(F.col("month") + 1.0))


def ratio_sums(t: Tables, keys: list[str], ys: list[str], models):
    """The rows reduced to their combinations of levels, days and flags, which several fits read."""
    return stage(R.design_sums(ratio_rows(t), keys, ys, models))


FULL = R.Terms(factors=("year", "month", "net"), numeric=("night",), name="full")


@query("drop_one_r2", "grp:s dropped:s full_r2:f6 unique_r2:f6 n:i", f"""RECURSIVE {RATIO_SQL}, {ols_sql('r_', 'rr', ['grp'], 'lr', [FULL, *[FULL.without(x) for x in FULL.labels]])},
  final AS (SELECT a.grp, substr(b.model, 9) AS dropped, a.r2 AS full_r2, a.r2 - b.r2 AS unique_r2, b.n FROM r_fit a JOIN r_fit b USING (grp) WHERE a.model = 'full' AND b.model <> 'full')""", covers="REG-04 REG-02")
def drop_one_r2(t: Tables):
    return R.drop_one_r2(ratio_sums(t, ["grp"], ["lr"], [FULL]), ["grp"], "lr", FULL)


CONTROL_SETS = [
    R.Terms(factors=("year",), poly=(("dos", 3),), name="day"),
    R.Terms(factors=("year", "net"), poly=(("dos", 3),), name="day and net"),
    R.Terms(factors=("year", "net"), numeric=("night", "lrng"), poly=(("dos", 3),), name="day, net, night and range"),
    R.Terms(factors=("year",), numeric=("lrng",), poly=(("dos", 3),), name="day and range"),
]


SWEEP_SQL = f"""RECURSIVE {RATIO_SQL}, {ols_sql('o_', 'rr', ['grp', 'season'], 'lo', CONTROL_SETS)}, {ols_sql('m_', 'rr', ['grp', 'season'], 'lm', CONTROL_SETS)},
  yr AS (SELECT DISTINCT rr.grp, rr.season, f.model, 'year=' || rr.year AS t FROM rr, (SELECT DISTINCT model FROM o_fit) f),
  ef AS (SELECT grp, season, model, coalesce(o.beta, 0) AS o, coalesce(m.beta, 0) AS m FROM yr LEFT JOIN o_effect o USING (grp, season, model, t) LEFT JOIN m_effect m USING (grp, season, model, t)),
  cr AS (SELECT grp, season, model, corr(o, m) AS r, count(*) AS n FROM ef GROUP BY ALL)"""


@query("control_sweep", "grp:s season:s model:s r:f4 lo:f4 hi:f4 p:f4 n:i", f"{SWEEP_SQL}, final AS (SELECT *, tanh(atanh(r) - 1.96/sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.96/sqrt(n - 3)) AS hi, {P_SQL} AS p FROM cr)", covers="REG-05 REG-02 SKL-07")
def control_sweep(t: Tables):
    d = ratio_sums(t, ["grp", "season"], ["lo", "lm"], CONTROL_SETS)
    o = R.year_index(d, ["grp", "season"], "lo", models=CONTROL_SETS).withColumnRenamed("index", "o")
    m = R.year_index(d, ["grp", "season"], "lm", models=CONTROL_SETS).withColumnRenamed("index", "m")
    return K.correlation(o.join(m, ["grp", "season", "model", "year"]), ["grp", "season", "model"], "o", "m")


# Corrections of growing freedom, each fitted before averaging and along with the years.
CORRECTIONS = [
    R.Terms(name="none"),
    R.Terms(factors=("month",), name="month"),
    R.Terms(poly=(("dos", 1),), name="linear"),
    R.Terms(poly=(("dos", 2),), name="quadratic"),
    R.Terms(poly=(("dos", 3),), name="cubic"),
]
JOINT = [R.Terms(("year", *c.factors), c.numeric, c.poly, f"joint {c.name}") for c in CORRECTIONS]


def corrected_sql(p: str, y: str) -> str:
    """Table ``{p}ix`` (grp, season, correction, method, year, v): mean residuals by year, and jointly fitted year effects."""
    return f"""{ols_sql(p, 'rr', ['grp', 'season'], y, [*CORRECTIONS, *JOINT])},
  {p}hat AS (SELECT grp, season, model, rid, sum(v*beta) AS fit FROM {p}long JOIN {p}effect USING (grp, season, t) WHERE model NOT LIKE 'joint%' GROUP BY ALL),
  {p}ix AS (SELECT grp, season, {p}hat.model AS correction, 'residual-then-average' AS method, year, avg({y} - fit) AS v FROM {p}row JOIN {p}hat USING (grp, season, rid) GROUP BY ALL
    UNION ALL SELECT grp, season, substr(model, 7), 'joint', year, coalesce(beta, 0) FROM (SELECT DISTINCT grp, season, year, f.model FROM rr JOIN {p}fit f USING (grp, season) WHERE f.model LIKE 'joint%')
      LEFT JOIN (SELECT grp, season, model, CAST(substr(t, 6) AS BIGINT) AS year, beta FROM {p}effect WHERE t LIKE 'year=%') USING (grp, season, model, year))"""


@query("correction_sweep", "grp:s season:s correction:s method:s r:f4 lo:f4 hi:f4 p:f4 n:i", f"""RECURSIVE {RATIO_SQL}, {corrected_sql('o_', 'lo')}, {corrected_sql('m_', 'lm')},
  cr AS (SELECT grp, season, correction, method, corr(o.v, m.v) AS r, count(*) AS n FROM o_ix o JOIN m_ix m USING (grp, season, correction, method, year) GROUP BY ALL),
  final AS (SELECT *, tanh(atanh(r) - 1.96/sqrt(n - 3)) AS lo, tanh(atanh(r) + 1.96/sqrt(n - 3)) AS hi, {P_SQL} AS p FROM cr)""", covers="REG-05 REG-01 REG-02 SKL-07")
def correction_sweep(t: Tables):
    by = ["grp", "season"]
    d = ratio_sums(t, by, ["lo", "lm"], JOINT)
    o, m = (R.corrected_year_index(d, by, y, corrections=CORRECTIONS).withColumnRenamed("index", a).drop("n") for y, a in (("lo", "o"), ("lm", "m")))
    by += ["correction", "method"]
    return K.correlation(o.join(m, [*by, "year"]), by, "o", "m")


# What the standardised index takes out beside the year: net, night, tow range and the day of the season.
STANDARD = R.Terms(factors=("year", "net"), numeric=("night", "lrng"), poly=(("dos", 3),), name="standard")


@query("diagnostics", "grp:s season:s n_years:i r_naive:f6 r_sampling_day:f6 r_date_adjusted:f5 lo:f4 hi:f4 r_standardised:f4 lo_standardised:f4 hi_standardised:f4", f"""RECURSIVE {DOS}, {RR}, {WINDOW_SQL},
  {ols_sql('i_', 'rr', ['grp', 'season'], 'ly', [STANDARD])},
  ix AS (SELECT y.grp, y.season, y.year, coalesce(beta, 0) AS v FROM (SELECT DISTINCT grp, season, year FROM rr) y LEFT JOIN i_effect e ON e.grp = y.grp AND e.season = y.season AND e.t = 'year=' || y.year),
  sx AS (SELECT grp, season, corr(v, idx) AS r, count(*) AS n FROM ix JOIN wi USING (season, year) GROUP BY 1, 2), a AS (SELECT season, grp, year, avg(y) AS o, avg(model) AS m, avg(res) AS ro, avg(res2) AS rm, avg(x) AS dd FROM d4 GROUP BY 1, 2, 3),
  c AS (SELECT grp, season, count(*) AS n_years, corr(o, m) AS r_naive, corr(dd, o) AS r_sampling_day, corr(ro, rm) AS r_date_adjusted FROM a GROUP BY 1, 2),
  final AS (SELECT c.*, tanh(atanh(r_date_adjusted) - 1.96/sqrt(n_years-3)) AS lo, tanh(atanh(r_date_adjusted) + 1.96/sqrt(n_years-3)) AS hi,
    sx.r AS r_standardised, tanh(atanh(sx.r) - 1.96/sqrt(sx.n-3)) AS lo_standardised, tanh(atanh(sx.r) + 1.96/sqrt(sx.n-3)) AS hi_standardised FROM c LEFT JOIN sx USING (grp, season))""", covers="REG-06 ANM-13 REG-02 AGG-26")
def diagnostics(t: Tables):
    mid = F.coalesce(*[F.when(F.col("season") == s, F.lit(m)) for s, m in SEASON_MID.items()])
    a = R.yearly_residuals(with_day(t), ["season", "grp"], "dos", ["y", "y2", "model"], centre=mid, scale=45.0)
    k = ["grp", "season"]
    naive = K.correlation(a, k, "y_mean", "model_mean").select(*k, F.col("r").alias("r_naive"), F.col("n").alias("n_years"))
    day = K.correlation(a, k, "mean_dos", "y_mean").select(*k, F.col("r").alias("r_sampling_day"))
    adj = K.correlation(a, k, "y_res", "y2_res").select(*k, F.col("r").alias("r_date_adjusted"), "lo", "hi")
    rows = ratio_rows(t).withColumn("ly", F.log10(F.col("obs") + 1e-6))
    index = R.year_index(R.design_sums(rows, k, ["ly"], [STANDARD]), k, "ly", models=[STANDARD]).select(*k, "year", "index")
    # The window index has a row for each season and year.
    std = K.correlation(index.join(window_index(t), ["season", "year"]), k, "index", "idx")
    std = std.select(*k, F.col("r").alias("r_standardised"), F.col("lo").alias("lo_standardised"), F.col("hi").alias("hi_standardised"))
    return naive.join(day, k).join(adj, k).join(std, k, "left")


BINS = """d AS (SELECT l_returnflag AS grp, l_quantity AS v, l_tax*100 + l_discount*90 + (l_linenumber*0.37) AS temp FROM lineitem), lo AS (SELECT floor(min(temp)) AS lo FROM d),
  b AS (SELECT grp, v, temp, ceil(temp - lo) - 1 + lo AS bin FROM d, lo WHERE temp > lo), bn AS (SELECT grp, bin, median(v) AS response, avg(temp) AS temp, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 3)"""


def temp_rows(t: Tables):
    return t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("v"), (F.col("l_tax") * 100 + F.col("l_discount") * 90 + F.col("l_linenumber") * 0.37).alias("temp"))


@query("binned_response", "grp:s bin:i temp:f4 response:f4 n:i", f"{BINS}, final AS (SELECT * FROM bn)", covers="REG-07")
def binned_response(t: Tables):
    return R.degree_bins(temp_rows(t), ["grp"], "temp", "v")


# The same refined grid in SQL: each step of the recursion scores the 11 x 11 x 11 candidates of every group's box and narrows it.
CURVES = f"""RECURSIVE {BINS}, sd AS (SELECT grp, 'shallow' AS source, v, temp FROM d UNION ALL SELECT grp, 'deep', v, temp*1.3 + 1 FROM d),
  sl AS (SELECT source, floor(min(temp)) AS low FROM sd GROUP BY 1),
  sb AS (SELECT grp, source, median(v) AS y, avg(temp) AS x FROM sd JOIN sl USING (source) WHERE temp > low GROUP BY grp, source, ceil(temp - low) HAVING count(*) >= 3),
  g AS (SELECT grp, source, count(*) AS n, sum(ln(1 + y)*ln(1 + y)) AS yy, list({{'x': x, 'y': ln(1 + y)}} ORDER BY x) AS pts FROM sb GROUP BY 1, 2 HAVING count(*) >= 5),
  fit AS (SELECT 0 AS k, grp, source, 0.0::DOUBLE AS lt, 30.0::DOUBLE AS ht, 0.0::DOUBLE AS la, 1.0::DOUBLE AS ha, 0.0::DOUBLE AS lb, 1.0::DOUBLE AS hb,
      {{'off': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'sse': 0.0::DOUBLE}} AS f FROM g
    UNION ALL SELECT k + 1, grp, source, greatest(f.t - (ht-lt)*0.15, 0), least(f.t + (ht-lt)*0.15, 30), greatest(f.a - (ha-la)*0.15, 0), least(f.a + (ha-la)*0.15, 1),
      greatest(f.b - (hb-lb)*0.15, 0), least(f.b + (hb-lb)*0.15, 1), f FROM (
      SELECT k, grp, source, lt, ht, la, ha, lb, hb, min({{'off': round(sse/greatest(yy, 1e-300), 9), 't': t, 'a': a, 'b': b, 'c': c, 'sse': sse}}) AS f FROM (
        SELECT *, greatest(0, yy - 2*c*sy + c*c*ss) AS sse FROM (SELECT *, greatest(0, sy/greatest(ss, 1e-300)) AS c FROM (
          SELECT * EXCLUDE (pts), list_sum(list_transform(pts, lambda q: exp(-(CASE WHEN q.x <= t THEN a ELSE b END)*(q.x-t)*(q.x-t))*q.y)) AS sy,
            list_sum(list_transform(pts, lambda q: exp(-2*(CASE WHEN q.x <= t THEN a ELSE b END)*(q.x-t)*(q.x-t)))) AS ss FROM (
            SELECT fit.* EXCLUDE (f), g.yy, g.pts, lt + (ht-lt)*i/10 AS t, la + (ha-la)*j/10 AS a, lb + (hb-lb)*l/10 AS b
            FROM fit JOIN g USING (grp, source), range(11) r(i), range(11) s(j), range(11) u(l) WHERE k < 8))))
      GROUP BY k, grp, source, lt, ht, la, ha, lb, hb)),
  o AS (SELECT grp, source, n, f.t AS topt, f.a AS a, f.b AS b, f.c AS c, sqrt(f.sse/n) AS rmse, n*ln(f.sse/n) + 8 AS aic FROM fit JOIN g USING (grp, source) WHERE k = 8)"""


@query("thermal_curve", "grp:s source:s n:i topt:f2 a:f3 b:f3 c:f3 rmse:f4 aic:f3 best:b",
       f"{CURVES}, final AS (SELECT *, aic = min(aic) OVER (PARTITION BY grp) AS best FROM o)", covers="REG-08 WIN-10 REG-07")
def thermal_curve(t: Tables):
    temps = {"shallow": F.col("temp"), "deep": F.col("temp") * 1.3 + 1}
    fits = R.thermal_curve_grid(R.degree_bins(temp_rows(t), ["grp"], temps, "v"), ["grp", "source"], log=True)
    return R.flag_best(fits, ["grp"])


@query("relative_series", "step_no:i rel:f6", f"""{CUBE}, s AS (SELECT year, step, avg(value2) AS v FROM cube GROUP BY 1, 2),
  final AS (SELECT (year - 1995)*120 + step - 1 AS step_no, CAST(CAST(round(v/25 - 1 + 3e-9, 6) AS DECIMAL(18, 6)) AS DOUBLE) AS rel FROM s)""", covers="SRC-10")
def relative_series(t: Tables):
    s = cube(t).groupBy("year", "step").agg(F.avg("value2").alias("v"))
    text = s.select(((F.col("year") - 1995) * 120 + F.col("step") - 1).cast("string").alias("Pane"), F.lit("0").alias("c1"),
                    F.format_string("%.6f", F.round(F.col("v") / 25 - 1 + 3e-9, 6)).alias("c2"))
    extra = t.spark.createDataFrame([("", "21: other", "22: DE1-POC"), ("3.4e38", "0", "9.9")], "Pane string, c1 string, c2 string")
    return TB.relative_series(extra.unionByName(text), "Pane", "DE1-POC")


PRIORITIES = {"1-URGENT": ("4", "ZF1-ICT"), "2-HIGH": ("5", "ZC1-EUP"), "3-MEDIUM": ("6", "ZC2-AMP"), "4-NOT SPECIFIED": ("7", "ZC3-DEC"), "5-LOW": ("8", "ZC4-CLG")}
SUMS = {g: f"sum(o_totalprice) FILTER (o_orderpriority = '{p}')" for p, (_, g) in PRIORITIES.items()}


@query("series_groups", "date:d " + " ".join(f"{g}:f2" for g in SUMS) + " crustaceans:f2", "final AS (SELECT CAST(o_orderdate AS DATE) AS date, "
       + ", ".join(f'{e} AS "{g}"' for g, e in SUMS.items()) + ", " + " + ".join(f"coalesce({e}, 0)" for g, e in SUMS.items() if g.startswith("ZC"))
       + " AS crustaceans FROM orders GROUP BY 1)", covers="MAP-03 SET-03 PRJ-11 PRJ-08")
def series_groups(t: Tables):
    from ..functions.taxa import rename_series

    w = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date")).pivot("o_orderpriority", list(PRIORITIES)).agg(F.sum("o_totalprice"))
    w = rename_series(w.withColumnsRenamed({p: i for p, (i, _) in PRIORITIES.items()}))
    return w.withColumn("crustaceans", C.row_sum([F.col(f"`{g}`") for g in SUMS if g.startswith("ZC")]))


@query("output_keys", "scenario:s pass:s season:s n:i", f"""{PAIRED}, final AS (SELECT 'SC_' || grp AS scenario, CASE WHEN obs > 30000 THEN 'ZC' ELSE 'ZS' END AS pass, season, count(*) AS n FROM paired GROUP BY 1, 2, 3)""", covers="SNK-04")
def output_keys(t: Tables):
    from ..sources.outputs import output_key

    name = F.concat(F.lit("file:/out/skill_SC_"), "grp", F.when(F.col("obs") > 30000, "_ZC_").otherwise("_ZS_"), "season", F.lit(".csv"))
    d = paired(t).select(name.alias("file"))
    return d.select(*[c.alias(k) for k, c in output_key(F.col("file"), "skill").items()]).groupBy("scenario", "pass", "season").agg(F.count(F.lit(1)).alias("n"))
