"""Matching observations to model times, levels and rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import joins as J
from ..operators import skill as K
from ..operators.quantiles import grouped_quantiles
from .base import Tables, query, stage
from .bindings import DAILY_OBS, MODEL_SERIES, PAIRED, SERIES, daily_obs, model_series, paired, season_sql, series_table

MATCH_SQL = """near AS (SELECT * FROM (SELECT o.*, m.mdate, m.model, row_number() OVER (PARTITION BY o.date
    ORDER BY abs(date_diff('day', o.date, m.mdate)), m.mdate) AS rn
  FROM day_obs o JOIN model_series m ON abs(date_diff('day', o.date, m.mdate)) <= 3) WHERE rn = 1),
  pairs AS (SELECT year(date) AS year, (dayofyear(date)-1)//14+1 AS biweek, avg(obs) AS obs, avg(model) AS model,
    count(*) AS n_days FROM near GROUP BY 1, 2)"""


def day_median(t: Tables):
    d = t.lineitem.select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("v"))
    return grouped_quantiles(d, ["date"], "v", {"obs": 0.5}, few_groups=True)


DAY_MEDIAN = "day_obs AS (SELECT CAST(l_shipdate AS DATE) AS date, median(l_extendedprice) AS obs FROM lineitem GROUP BY 1)"


def matched_pairs(t: Tables):
    o = stage(day_median(t).withColumn("t", cal.days(F.col("date"))))
    m = stage(model_series(t).withColumn("mt", cal.days(F.col("mdate"))))
    near = J.asof_nearest(o, m, obs_t="t", model_t="mt", values=["model"], tolerance=3, bucket_width=366)
    near = near.where("model IS NOT NULL")
    return stage(near.groupBy(F.year("date").alias("year"), cal.biweek(F.col("date")).alias("biweek")).agg(
        F.avg("obs").alias("obs"), F.avg("model").alias("model"), F.count(F.lit(1)).alias("n_days")))


SKILL_SQL = """mean_obs AS (SELECT avg(obs) AS om FROM pairs),
  final AS (SELECT count(*) AS n, avg(model-obs) AS bias, stddev_samp(obs) AS obs_std, stddev_samp(model) AS model_std,
    avg(abs(model-obs)) AS mae, sqrt(avg((model-obs)^2)) AS rmse, corr(model, obs) AS r,
    1 - sum((model-obs)^2) / sum((abs(model-om)+abs(obs-om))^2) AS wss FROM pairs, mean_obs)"""


@query("asof_skill", "n:i bias:f4 obs_std:f4 model_std:f4 mae:f4 rmse:f4 r:f6 wss:f6",
       f"{DAY_MEDIAN}, {MODEL_SERIES}, {MATCH_SQL}, {SKILL_SQL}", covers="JOI-01 CAL-04 AGG-16 NUT-07 SKL-01")
def asof_skill(t: Tables):
    return K.skill(matched_pairs(t), [], "obs", "model", which="paired", summary=True)


@query("asof_biweek_pairs", "year:i biweek:i obs:f4 model:f4 n_days:i",
       f"{DAY_MEDIAN}, {MODEL_SERIES}, {MATCH_SQL}, final AS (SELECT * FROM pairs)", covers="JOI-01 AGG-16 NUT-07")
def asof_biweek_pairs(t: Tables):
    return matched_pairs(t)


@query("asof_keyed", "user_id:i event_id:i gap_s:f6 purchase:f2", """
  m AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
  o AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'),
  back AS (SELECT o.*, m.ts AS bt, m.value AS bv FROM o ASOF LEFT JOIN m ON o.user_id = m.user_id AND o.ts >= m.ts),
  bf AS (SELECT b.*, m.ts AS ft, m.value AS fv FROM back b ASOF LEFT JOIN m ON b.user_id = m.user_id AND b.ts <= m.ts),
  pick AS (SELECT user_id, event_id, ts, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND epoch_us(ts)-epoch_us(bt) <= epoch_us(ft)-epoch_us(ts)) THEN bt ELSE ft END AS mt,
    CASE WHEN ft IS NULL OR (bt IS NOT NULL AND epoch_us(ts)-epoch_us(bt) <= epoch_us(ft)-epoch_us(ts)) THEN bv ELSE fv END AS mv FROM bf),
  final AS (SELECT user_id, event_id,
    CASE WHEN abs(epoch_us(ts)-epoch_us(mt)) <= 259200000000 THEN abs(epoch_us(ts)-epoch_us(mt))/1e6 END AS gap_s,
    CASE WHEN abs(epoch_us(ts)-epoch_us(mt)) <= 259200000000 THEN mv END AS purchase FROM pick)""", covers="JOI-01")
def asof_keyed(t: Tables):
    e = t.events.withColumn("us", cal.micros(F.col("ts")))
    o = e.where("event_type = 'view'").select("user_id", "event_id", "us")
    m = e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("mus"), F.col("value").alias("purchase"))
    near = J.asof_nearest(o, m, keys=["user_id"], obs_t="us", model_t="mus", values=["purchase"],
                          tolerance=3 * 86_400e6)
    return near.withColumn("gap_s", F.abs(F.col("us") - F.col("matched_t")) / 1e6)


@query("closest_date", "date:d mdate_day:i gap:i model:f4", f"""{DAILY_OBS}, {MODEL_SERIES},
  final AS (SELECT o.date, date_diff('day', DATE '1970-01-01', m.mdate) AS mdate_day, abs(date_diff('day', o.date, m.mdate)) AS gap, m.model
   FROM daily_obs o JOIN model_series m ON true
   QUALIFY row_number() OVER (PARTITION BY o.date ORDER BY abs(date_diff('day', o.date, m.mdate)), m.mdate) = 1)""",
       covers="JOI-02")
def closest_date(t: Tables):
    o = daily_obs(t).withColumn("t", cal.days(F.col("date")))
    m = model_series(t).withColumn("mt", cal.days(F.col("mdate")))
    near = J.asof_nearest(o, m, obs_t="t", model_t="mt", values=["model"], bucket_width=366, matched_as="mdate_day")
    return near.withColumn("gap", F.abs(F.col("t") - F.col("mdate_day")))


@query("closest_step", "date:d year:i step:i gap:i obs:f4 model:f4", f"""{DAILY_OBS}, {MODEL_SERIES},
  c AS (SELECT y AS year, s AS step, make_date(y, 1, 1) + CAST(CASE WHEN s < 120 THEN s*3-1 WHEN (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 THEN 361 ELSE 360 END - 1 AS INTEGER) AS cd FROM range(1994, 2004) a(y), range(1, 121) b(s)),
  n AS (SELECT o.date, o.obs, c.year, c.step, abs(date_diff('day', o.date, cd)) AS gap FROM daily_obs o JOIN c ON abs(date_diff('day', o.date, cd)) <= 8
   QUALIFY row_number() OVER (PARTITION BY o.date ORDER BY abs(date_diff('day', o.date, cd)), cd) = 1),
  final AS (SELECT n.*, model FROM n LEFT JOIN model_series USING (year, step))""", covers="JOI-02 JOI-09 CAL-01")
def closest_step(t: Tables):
    o = daily_obs(t).withColumn("s", cal.nearest_step(F.col("date"))).select("date", "obs", "s.year", "s.step", "s.gap")
    return o.join(model_series(t).select("year", "step", "model"), ["year", "step"], "left")


@query("closest_depth", "l_linenumber:i depth:f2 level:f2 n:i", """
  lv AS (SELECT unnest([0.5, 1.5, 2.5, 5.0, 7.5, 10.5, 14.0, 18.0, 25.0]) AS level, unnest(range(9)) AS i),
  d AS (SELECT l_linenumber, l_linenumber * 2.5 AS depth, count(*) AS n FROM lineitem GROUP BY 1, 2),
  final AS (SELECT l_linenumber, depth, level, n FROM d, lv
   QUALIFY row_number() OVER (PARTITION BY l_linenumber ORDER BY abs(level - depth), i) = 1)""", covers="JOI-03")
def closest_depth(t: Tables):
    d = t.lineitem.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.col("l_linenumber") * 2.5)
    return d.withColumn("level", J.nearest_level(F.col("depth"), [0.5, 1.5, 2.5, 5.0, 7.5, 10.5, 14.0, 18.0, 25.0]))


@query("seasonal_join", "season:s grp:s obs:f4 model:f4 clim:f4 bias:f4", f"""{PAIRED},
  o AS (SELECT season, grp, avg(obs) AS obs FROM paired GROUP BY 1, 2),
  m AS (SELECT {season_sql('o_orderdate')} AS season, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS grp,
    avg(o_totalprice)/5 AS model FROM orders GROUP BY 1, 2),
  c AS (SELECT grp, avg(obs) AS clim FROM paired GROUP BY 1),
  final AS (SELECT season, grp, obs, model, clim, model - obs AS bias FROM o JOIN m USING (season, grp) LEFT JOIN c USING (grp))""",
       covers="JOI-11 AGG-07")
def seasonal_join(t: Tables):
    p = paired(t)
    o = p.groupBy("season", "grp").agg(F.avg("obs").alias("obs"))
    group = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    m = t.orders.groupBy(cal.season(F.col("o_orderdate")).alias("season"), group.alias("grp")).agg(
        (F.avg("o_totalprice") / 5).alias("model"))
    c = p.groupBy("grp").agg(F.avg("obs").alias("clim"))
    return o.join(m, ["season", "grp"]).join(c, "grp", "left").withColumn("bias", F.col("model") - F.col("obs"))


@query("semi_anti_years", "kind:s year:i n:i", """
  big AS (SELECT year(o_orderdate) AS year FROM orders GROUP BY 1 HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)),
  l AS (SELECT year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY 1),
  final AS (SELECT 'kept' AS kind, * FROM l WHERE year IN (SELECT year FROM big)
   UNION ALL SELECT 'left out', * FROM l WHERE year NOT IN (SELECT year FROM big))""", covers="JOI-13 SET-01")
def semi_anti_years(t: Tables):
    by_year = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.avg("o_totalprice").alias("a"), F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("c"))
    total = by_year.agg((F.sum("s") / F.sum("c")).alias("overall"))
    big = by_year.join(total, F.col("a") > F.col("overall")).select("year")
    rows = t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(big, "year", "left_semi").withColumn("kind", F.lit("kept")).unionByName(
        rows.join(big, "year", "left_anti").withColumn("kind", F.lit("left out")))


@query("key_overlap", "side:s n:i", """
  a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0),
  final AS (SELECT 'both' AS side, count(*) AS n FROM a JOIN b USING (k)
   UNION ALL SELECT 'only first', count(*) FROM a WHERE k NOT IN (SELECT k FROM b)
   UNION ALL SELECT 'only second', count(*) FROM b WHERE k NOT IN (SELECT k FROM a))""", covers="SET-05 SET-04 JOI-13")
def key_overlap(t: Tables):
    a = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")).distinct()

    def count(df, side):
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))

    return (count(a.intersect(b), "both").unionByName(count(a.join(b, "k", "left_anti"), "only first"))
            .unionByName(count(b.join(a, "k", "left_anti"), "only second")))


@query("cell_lookup", "o_orderkey:i row:i col:i step:i value:f4 value2:f4", """
  cube AS (SELECT year(l_shipdate) AS year, least((dayofyear(l_shipdate)-1)//3+1, 120) AS step, l_suppkey % 10 AS row,
    l_partkey % 10 AS col, avg(l_extendedprice) AS value, avg(l_quantity) AS value2 FROM lineitem GROUP BY ALL),
  b AS (SELECT o_orderkey, year(o_orderdate) AS year, least((dayofyear(o_orderdate)-1)//3+1, 120) AS step,
    o_custkey % 10 AS row, o_orderkey % 10 AS col FROM orders),
  final AS (SELECT b.*, value, value2 FROM b LEFT JOIN cube USING (year, step, row, col))""", covers="JOI-09 SRC-05 SRC-07")
def cell_lookup(t: Tables):
    from .bindings import cube

    d = F.col("o_orderdate").cast("date")
    b = t.orders.select(
        "o_orderkey", F.year(d).alias("year"), cal.model_step(d).alias("step"),
        (F.col("o_custkey") % 10).cast("int").alias("row"), (F.col("o_orderkey") % 10).cast("int").alias("col"))
    return b.join(cube(t), ["year", "step", "row", "col"], "left")


@query("two_source_lookup", "o_orderkey:i level:f1 grid_value:f4 deep_value:f4", """
  cube AS (SELECT year(l_shipdate) AS year, least((dayofyear(l_shipdate)-1)//3+1, 120) AS step, l_suppkey % 10 AS row,
    l_partkey % 10 AS col, avg(l_extendedprice) AS grid_value FROM lineitem GROUP BY ALL),
  deep AS (SELECT CAST(l_shipdate AS DATE) AS date, l_linenumber * 3.0 AS level, l_suppkey % 10 AS row, avg(l_quantity) AS deep_value FROM lineitem GROUP BY ALL),
  b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, year(o_orderdate) AS year, least((dayofyear(o_orderdate)-1)//3+1, 120) AS step,
    o_custkey % 10 AS row, o_orderkey % 10 AS col, (o_custkey % 23) * 1.0 AS depth FROM orders),
  c AS (SELECT *, least(greatest(ceil(depth / 3 - 0.5), 1), 7) * 3.0 AS level FROM b),
  final AS (SELECT o_orderkey, level, grid_value, deep_value FROM c LEFT JOIN cube USING (year, step, row, col) LEFT JOIN deep USING (date, level, row))""",
       covers="JOI-10 JOI-03 JOI-09")
def two_source_lookup(t: Tables):
    from .bindings import cube

    d = F.col("o_orderdate").cast("date")
    b = t.orders.select(
        "o_orderkey", d.alias("date"), F.year(d).alias("year"), cal.model_step(d).alias("step"),
        (F.col("o_custkey") % 10).cast("int").alias("row"), (F.col("o_orderkey") % 10).cast("int").alias("col"),
        J.nearest_level((F.col("o_custkey") % 23).cast("double"), [3.0 * i for i in range(1, 8)]).alias("level"))
    deep = t.lineitem.groupBy(
        F.col("l_shipdate").cast("date").alias("date"), (F.col("l_linenumber") * 3.0).alias("level"),
        (F.col("l_suppkey") % 10).cast("int").alias("row")).agg(F.avg("l_quantity").alias("deep_value"))
    g = cube(t).select("year", "step", "row", "col", F.col("value").alias("grid_value"))
    return b.join(g, ["year", "step", "row", "col"], "left").join(deep, ["date", "level", "row"], "left")


@query("flux_lookup", "year:i step:i model:f4 mult:f4 scaled:f4", f"""{MODEL_SERIES},
  s AS (SELECT year(l_shipdate) AS year, {"least((dayofyear(l_shipdate)-1)//3+1, 120)"} AS step, avg(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
  a AS (SELECT avg(q) AS aq FROM s),
  final AS (SELECT m.year, m.step, model, coalesce(q / aq, 1.0) AS mult, model * coalesce(q / aq, 1.0) AS scaled
   FROM model_series m LEFT JOIN s USING (year, step), a)""", covers="JOI-11 NUT-04")
def flux_lookup(t: Tables):
    from ..operators.nutrient import apply_multiplier

    d = F.col("l_shipdate")
    s = t.lineitem.where("l_returnflag = 'R'").groupBy(F.year(d).alias("year"), cal.model_step(d).alias("step")).agg(
        F.avg("l_quantity").alias("q"))
    mean = s.agg(F.avg("q").alias("aq"))
    table = s.crossJoin(mean).select("year", "step", F.try_divide("q", "aq").alias("mult"))
    return apply_multiplier(model_series(t), table, ["year", "step"], "model", "scaled")
