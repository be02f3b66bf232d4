"""Skill tables, correlations and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..operators import onset as O
from ..operators import skill as K
from .base import Tables, query, stage
from .bindings import MODEL_SERIES, PAIRED, SERIES, model_series, paired, series_table
from .onsets import doy_sql

CORE = """om AS (SELECT {k} avg(obs) AS om FROM {src} {g}),
  agg AS (SELECT {pk} count(*) AS n, avg(model-obs) AS bias, avg(abs(model-obs)) AS mae, avg((model-obs)^2) AS mse,
    sqrt(avg((model-obs)^2)) AS rmse, sqrt(avg((model-obs)^2))/avg(obs) AS nrmse, corr(model,obs) AS r, corr(model,obs)^2 AS r2,
    CASE WHEN bool_and(obs<>0) THEN avg(abs((model-obs)/obs))*100 END AS mape,
    1 - sum((model-obs)^2)/sum((obs-om)^2) AS nse, 1 - sum((model-obs)^2)/sum((abs(model-om)+abs(obs-om))^2) AS wss,
    stddev_samp(obs) AS obs_std, stddev_samp(model) AS model_std, stddev_pop(obs) AS obs_std_pop, stddev_pop(model) AS model_std_pop,
    stddev_pop(model-obs) AS crmse FROM {src} p {join} {g2})"""


def core(keys: list[str], src: str) -> str:
    if not keys:
        return CORE.format(k="", src=src, g="", pk="", join=", om", g2="")
    ks = ", ".join(keys)
    return CORE.format(k=ks + ",", src=src, g="GROUP BY " + ks, pk=ks + ",", join=f"JOIN om USING ({ks})", g2="GROUP BY " + ks)


@query("skill_classic", "grp:s n:i bias:f4 mae:f4 rmse:f4 nrmse:f6 r:f6 r2:f6 mape:f4 nse:f6 wss:f6",
       f"{PAIRED}, {core(['grp'], 'paired')}, final AS (SELECT * FROM agg)", covers="SKL-02 SKL-06")
def skill_classic(t: Tables):
    return K.skill(paired(t), ["grp"], "obs", "model", which="classic")


@query("skill_timing", "year:i n:i mse:f0 rmse:f4 mae:f4 bias:f4 r:f6 wss_floor:f6 obs_std_pop:f4 model_std_pop:f4",
       f"{PAIRED}, {core(['year'], 'paired')}, final AS (SELECT *, greatest(wss, 0.0) AS wss_floor FROM agg)", covers="SKL-03")
def skill_timing(t: Tables):
    return K.skill(paired(t), ["year"], "obs", "model", which="timing")


@query("skill_centred", "season:s n:i r:f6 obs_std_pop:f4 model_std_pop:f4 crmse:f4 rmse:f4 bias:f4 mae:f4 wss:f6",
       f"""{PAIRED}, d AS (SELECT season, obs, model FROM paired UNION ALL SELECT 'All', obs, model FROM paired),
       {core(['season'], 'd')}, final AS (SELECT * FROM agg WHERE n >= 2)""", covers="SKL-04")
def skill_centred(t: Tables):
    return K.skill(K.with_overall(paired(t), "season"), ["season"], "obs", "model", which="centred", min_pairs=2)


@query("skill_export", "grp:s season:s n:i bias:f4 obs_std_pop:f4 model_std_pop:f4 mae:f4 rmse:f4 r:f6 wss:f6",
       f"""{PAIRED}, l AS (SELECT grp, season, log10(obs + 1) AS obs, log10(model + 1) AS model FROM paired),
       d AS (SELECT * FROM l UNION ALL SELECT grp, 'All', obs, model FROM l), {core(['grp', 'season'], 'd')},
       final AS (SELECT * FROM agg)""", covers="SKL-06 SKL-05 PRJ-09")
def skill_export(t: Tables):
    p = paired(t).withColumns({"obs": F.log10(F.col("obs") + 1), "model": F.log10(F.col("model") + 1)})
    return K.skill(K.with_overall(p, "season"), ["grp", "season"], "obs", "model",
                   which=["n", "bias", "obs_std_pop", "model_std_pop", "mae", "rmse", "r", "wss"])


MONTHLY = f"{PAIRED}, my AS (SELECT grp, year, month, avg(obs) AS obs, avg(model) AS model, avg(dayofyear(date)) AS doy FROM paired GROUP BY 1, 2, 3)"


def monthly(t: Tables):
    return paired(t).groupBy("grp", "year", "month").agg(
        F.avg("obs").alias("obs"), F.avg("model").alias("model"), F.avg(F.dayofyear("date")).alias("doy"))


P_SQL = """CASE WHEN (n-2) % 2 = 0
    THEN greatest(0, 1 - abs(r) * list_sum(list_transform(range(0, (n-2)//2), lambda k: exp(lgamma(k+0.5)-lgamma(k+1.0))/sqrt(pi()) * pow(1-r*r, k))))
    ELSE greatest(0, 1 - 2/pi() * (asin(abs(r)) + abs(r)*sqrt(1-r*r) * list_sum(list_transform(range(0, (n-3)//2), lambda k: exp(lgamma(k+1.0)-lgamma(k+1.5))*sqrt(pi())/2 * pow(1-r*r, k))))) END"""


@query("correlation_ci", "grp:s year:i n:i r:f6 lo:f6 hi:f6 p:f6", f"""{MONTHLY},
  a AS (SELECT grp, year, corr(obs, model) AS r0, count(*) AS n FROM my GROUP BY 1, 2),
  b AS (SELECT grp, year, n, CASE WHEN n >= 5 THEN r0 END AS r FROM a),
  final AS (SELECT *, tanh(atanh(r) - 1.96/sqrt(n-3)) AS lo, tanh(atanh(r) + 1.96/sqrt(n-3)) AS hi, {P_SQL} AS p FROM b)""", covers="SKL-07")
def correlation_ci(t: Tables):
    return K.correlation(monthly(t), ["grp", "year"], "obs", "model")


@query("weighted_r", "grp:s r:f6", f"""{PAIRED}, m AS (SELECT grp, year, month, avg(obs) AS o, avg(model) AS m, count(*) AS w FROM paired GROUP BY 1, 2, 3),
  c AS (SELECT grp, sum(w*o)/sum(w) AS mo, sum(w*m)/sum(w) AS mm FROM m GROUP BY 1),
  final AS (SELECT grp, sum(w*(o-mo)*(m-mm))/sqrt(sum(w*(o-mo)^2)*sum(w*(m-mm)^2)) AS r FROM m JOIN c USING (grp) GROUP BY 1)""", covers="SKL-07")
def weighted_r(t: Tables):
    m = paired(t).groupBy("grp", "year", "month").agg(F.avg("obs").alias("o"), F.avg("model").alias("m"), F.count(F.lit(1)).alias("w"))
    return m.groupBy("grp").agg(K.weighted_corr("o", "m", "w").alias("r"))


@query("partial_corr", "grp:s r:f6 partial:f6", f"""{MONTHLY},
  c AS (SELECT grp, corr(obs, model) AS r, corr(obs, doy) AS a, corr(model, doy) AS b FROM my GROUP BY 1),
  final AS (SELECT grp, r, (r - a*b)/sqrt((1-a*a)*(1-b*b)) AS partial FROM c)""", covers="SKL-08")
def partial_corr(t: Tables):
    from ..functions.stats import partial_corr as pc

    c = monthly(t).groupBy("grp").agg(pearson("obs", "model").alias("r"), pearson("obs", "doy").alias("a"), pearson("model", "doy").alias("b"))
    return c.withColumn("partial", pc(F.col("r"), F.col("a"), F.col("b")))


@query("comparison_links", "comparison:s n:i r:f6 lo:f6 hi:f6 p:f6", f"""{MONTHLY},
  y AS (SELECT year, avg(obs) AS obs, avg(model) AS model, avg(doy) AS doy FROM my GROUP BY 1),
  x AS (SELECT 'obs vs model' AS comparison, obs AS a, model AS b FROM y UNION ALL SELECT 'obs vs day', obs, doy FROM y
    UNION ALL SELECT 'model vs day', model, doy FROM y),
  c AS (SELECT comparison, count(*) AS n, corr(a, b) AS r FROM x GROUP BY 1),
  final AS (SELECT *, tanh(atanh(r) - 1.96/sqrt(n-3)) AS lo, tanh(atanh(r) + 1.96/sqrt(n-3)) AS hi, {P_SQL} AS p FROM c)""", covers="SKL-09 SKL-07")
def comparison_links(t: Tables):
    y = monthly(t).groupBy("year").agg(F.avg("obs").alias("obs"), F.avg("model").alias("model"), F.avg("doy").alias("doy"))
    pairs = F.array(*[
        F.struct(F.lit(label).alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b"))
        for label, a, b in (("obs vs model", "obs", "model"), ("obs vs day", "obs", "doy"), ("model vs day", "model", "doy"))])
    return K.correlation(y.select(F.inline(pairs)), ["comparison"], "a", "b")


#: Yearly series that are compared with each other: spring means of the tows, springs of the whole series, and days of the bloom.
LINKS = [
    ("2-D spring vs 2-D bloom", "spring 2-D", "bloom 2-D"),
    ("1-D spring vs 1-D bloom", "spring 1-D", "bloom 1-D"),
    ("tows vs first bloom record", "tows", "bloom seen"),
    ("tows vs second bloom record", "tows", "bloom seen twice"),
    ("2-D at tows vs 2-D bloom", "2-D at tows", "bloom 2-D"),
    ("1-D at tows vs 1-D bloom", "1-D at tows", "bloom 1-D"),
    ("2-D bloom vs first record", "bloom 2-D", "bloom seen"),
    ("sampling day vs first record", "sampling day", "bloom seen"),
    ("sampling day vs second record", "sampling day", "bloom seen twice"),
]
LINK_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LINKS)


@query("phenology_links", "comparison:s offset:i n:i r:f5 lo:f4 hi:f4 p:f5", f"""{PAIRED}, {SERIES}, {MODEL_SERIES},
  {doy_sql('pair', name='one')}, {doy_sql('four', name='two')}, msrc AS (SELECT 'm' AS grp, year, mdate AS date, model AS v FROM model_series),
  {doy_sql('pair', src='msrc', name='mon')}, tw AS (SELECT year, avg(obs) AS o, avg(model) AS m, avg(log10(model + 1)) AS l, avg(dayofyear(date)) AS d FROM paired WHERE season = 'Spring' GROUP BY 1),
  ys AS (SELECT 'tows' AS source, year, o AS v FROM tw UNION ALL SELECT '2-D at tows', year, m FROM tw UNION ALL SELECT '1-D at tows', year, l FROM tw UNION ALL SELECT 'sampling day', year, d FROM tw
    UNION ALL SELECT 'spring 2-D', year, avg(v) FROM series WHERE month(date) IN (3, 4, 5) AND grp = 'N' GROUP BY 2
    UNION ALL SELECT 'spring 1-D', year, avg(model) FROM model_series WHERE month(mdate) IN (3, 4, 5) GROUP BY 2
    UNION ALL SELECT 'bloom seen', year, onset_doy FROM one WHERE grp = 'A' UNION ALL SELECT 'bloom seen twice', year, onset_doy FROM two WHERE grp = 'R'
    UNION ALL SELECT 'bloom 2-D', year, onset_doy FROM one WHERE grp = 'N' UNION ALL SELECT 'bloom 1-D', year, onset_doy FROM mon),
  pr AS (SELECT comparison, o.off AS "offset", a.v AS a, b.v AS b FROM (VALUES {LINK_SQL}) l(comparison, s1, s2), (VALUES (0), (1)) o(off), ys a, ys b
    WHERE a.source = s1 AND b.source = s2 AND a.year + o.off = b.year AND a.v IS NOT NULL AND b.v IS NOT NULL),
  c AS (SELECT comparison, "offset", count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS r FROM pr GROUP BY 1, 2),
  final AS (SELECT *, tanh(atanh(r) - 1.96/sqrt(n-3)) AS lo, tanh(atanh(r) + 1.96/sqrt(n-3)) AS hi, CASE WHEN r IS NOT NULL THEN {P_SQL} END AS p FROM c)""", covers="SKL-09 SKL-07 BLM-01 BLM-02")
def phenology_links(t: Tables):
    """Spring values against bloom days between sources, in the same year and with the second source one year later."""
    series, one_d = stage(series_table(t)), stage(model_series(t))
    tows = paired(t).where("season = 'Spring'").groupBy("year").agg(
        F.avg("obs").alias("tows"), F.avg("model").alias("2-D at tows"), F.avg(F.log10(F.col("model") + 1)).alias("1-D at tows"), F.avg(F.dayofyear("date")).alias("sampling day"))
    as_series = one_d.select(F.lit("m").alias("grp"), "year", F.col("mdate").alias("date"), F.col("model").alias("v"))
    first, twice = O.threshold_onset(series, ["grp"], value="v"), O.threshold_onset(series, ["grp"], value="v", rule="two_of_four")

    def part(df, source: str, v):
        return df.select(F.lit(source).alias("source"), "year", v.cast("double").alias("v"))

    spring = F.month("date").isin(3, 4, 5)
    day = F.col("onset_doy")
    parts = [tows.unpivot("year", ["tows", "2-D at tows", "1-D at tows", "sampling day"], "source", "v").select("source", "year", "v"),
             part(series.where(spring & (F.col("grp") == "N")).groupBy("year").agg(F.avg("v").alias("v")), "spring 2-D", F.col("v")),
             part(as_series.where(spring).groupBy("year").agg(F.avg("v").alias("v")), "spring 1-D", F.col("v")),
             part(first.where("grp = 'A'"), "bloom seen", day), part(twice.where("grp = 'R'"), "bloom seen twice", day),
             part(first.where("grp = 'N'"), "bloom 2-D", day), part(O.threshold_onset(as_series, ["grp"], value="v"), "bloom 1-D", day)]
    return K.yearly_links(reduce(lambda a, b: a.unionByName(b), parts), LINKS, offsets=(0, 1))


@query("best_fit_line", "grp:s n:i slope:f6 intercept:f4 r2:f6", f"""{PAIRED},
  final AS (SELECT grp, count(*) AS n, regr_slope(model, obs) AS slope, regr_intercept(model, obs) AS intercept, regr_r2(model, obs) AS r2
   FROM paired GROUP BY 1)""", covers="SKL-10")
def best_fit_line(t: Tables):
    return K.best_fit(paired(t), ["grp"], "obs", "model")


@query("trend_slope", "grp:s n:i trend:f4", f"""{PAIRED}, y AS (SELECT grp, year, avg(obs) AS v FROM paired GROUP BY 1, 2),
  z AS (SELECT grp, year, (v - avg(v) OVER w)/stddev_samp(v) OVER w AS z FROM y WINDOW w AS (PARTITION BY grp)),
  final AS (SELECT grp, count(*) AS n, regr_slope(z, year)*10 AS trend FROM z WHERE year BETWEEN 1996 AND 2000 GROUP BY 1)""", covers="SKL-12")
def trend_slope(t: Tables):
    from ..operators.anomaly import zscore

    y = paired(t).groupBy("grp", "year").agg(F.avg("obs").alias("v"))
    return K.trend_per_decade(zscore(y, ["grp"], "v", "z"), ["grp"], "year", "z", 1996, 2000)


def _skill_table(t: Tables):
    both = paired(t).withColumn("group", F.explode(F.array(F.col("grp"), F.lit("Total"))))
    return K.skill(K.with_overall(both, "season"), ["season", "group"], "obs", "model", which="paired")


SKILL_TABLE = f"""{PAIRED}, e AS (SELECT grp AS "group", season, obs, model FROM paired UNION ALL SELECT 'Total', season, obs, model FROM paired),
  d AS (SELECT * FROM e UNION ALL SELECT "group", 'All', obs, model FROM e), {core(['season', '"group"'], 'd')}"""


@query("manuscript_table", "season:s group:s n:i r:f2 rmse:f2 mae:f2 wss:f2",
       f"""{SKILL_TABLE}, final AS (SELECT season, "group", n, r, rmse, mae, wss FROM agg WHERE "group" = 'Total')""", covers="SNK-03 WIN-11")
def manuscript_table(t: Tables):
    return K.manuscript_table([_skill_table(t)], ["All", "Winter", "Spring", "Summer", "Fall"], decimals=9)


@query("supplement_table", "season:s group:s n:i r:f2 rmse:f2 mae:f2 wss:f2", f"""{SKILL_TABLE}, final AS (SELECT * FROM agg)""", covers="SNK-03 WIN-11")
def supplement_table(t: Tables):
    return K.supplement_table(_skill_table(t), ["All", "Winter", "Spring", "Summer", "Fall"], decimals=9)
