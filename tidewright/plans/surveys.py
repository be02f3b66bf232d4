"""Survey tables on the bound tables: an order is a tow, its line items are taxon records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import clean as C
from ..functions import taxa as TX
from ..operators import skill as K
from ..operators import survey as S
from ..operators.quantiles import grouped_quantiles
from .base import Tables, query, stage
from .bindings import PAIRED, paired, season_sql


def tows(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("tow"), (F.col("o_custkey") % 250).cast("double").alias("start_depth"),
        (F.col("o_orderkey") % 40).cast("double").alias("end_depth"), (F.col("o_orderkey") % 400 + 10).cast("double").alias("bottom_depth"),
        F.col("o_orderpriority").alias("net"), F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "Night").otherwise("Daylight").alias("twilight"),
        F.concat(F.lit(" St"), (F.col("o_custkey") % 60).cast("string"), F.lit(" ")).alias("station"))


TOWS = """tows AS (SELECT o_orderkey AS tow, (o_custkey % 250)::DOUBLE AS start_depth, (o_orderkey % 40)::DOUBLE AS end_depth, (o_orderkey % 400 + 10)::DOUBLE AS bottom_depth,
  o_orderpriority AS net, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'Night' ELSE 'Daylight' END AS twilight, ' St' || (o_custkey % 60) || ' ' AS station FROM orders)"""


def taxa(t: Tables):
    kind, word = F.col("p_type"), F.split("p_name", " ")[1]
    other = F.lit("-")
    p = t.part.select(
        "p_partkey", F.col("p_brand").alias("genus"), F.col("p_name").alias("species"), F.col("p_size").cast("double").alias("body_mass"),
        F.when(kind == "PROMO", "Cnidaria").otherwise(other).alias("phylum"),
        F.when((kind == "PROMO") & (word == "gear"), "Scyphozoa").when(kind == "PROMO", "Hydrozoa").when(kind == "STANDARD", "Polychaeta").otherwise(other).alias("class"),
        F.when(kind == "ECONOMY", "Euphausiacea").when(kind == "SMALL", "Calanoida").when(kind == "LARGE", "Decapoda").when(kind == "MEDIUM", "Amphipoda").otherwise(other).alias("order"),
        F.when((kind == "SMALL") & (word == "bolt"), "Calanidae").when(kind == "SMALL", "Oithonidae").otherwise(other).alias("family"))
    ranks = {r: F.col(r) for r in ("phylum", "class", "order", "family")}
    return p.withColumn("grp", TX.group_of(TX.RULES_2025, ranks))


def records(t: Tables):
    """Taxon records with their taxon and tow. What follows from the date is derived after the joins, so it is not shuffled."""
    d = F.col("date")
    r = t.lineitem.select(
        F.col("l_orderkey").alias("tow"), F.col("l_suppkey").alias("station"), F.col("l_partkey").alias("p_partkey"),
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("abundance"),
        F.col("l_returnflag").alias("stage"), F.when(F.col("l_linestatus") == "O", "Night").otherwise("Daylight").alias("twilight"))
    r = r.join(taxa(t), "p_partkey").join(tows(t).select("tow", "start_depth", "end_depth", "bottom_depth"), "tow")
    adult = (F.col("stage") == "A") & (F.col("twilight") == "Daylight")
    n = S.net_avoidance(F.col("abundance"), F.col("order") == "Euphausiacea", adult)
    rng = S.tow_range(F.col("start_depth"), F.col("end_depth"))
    return r.withColumns({"year": F.year(d), "month": F.month(d), "season": cal.season(d), "raw": F.col("abundance") * F.col("body_mass"), "adjusted": n * F.col("body_mass"), "biomass": S.areal_biomass(n, F.col("body_mass"), rng)})


RECORDS = f"""{TOWS}, taxa AS (SELECT p_partkey, p_brand AS genus, p_name AS species, p_size::DOUBLE AS body_mass, p_type, CASE p_type WHEN 'PROMO' THEN CASE WHEN p_name LIKE '% gear' THEN 'ZS1-JEL' ELSE 'ZS2-CTH' END WHEN 'STANDARD' THEN 'ZS3-CHA'
    WHEN 'SMALL' THEN CASE WHEN p_name LIKE '% bolt' THEN 'ZC4-CLG' ELSE 'ZC5-CSM' END WHEN 'LARGE' THEN 'ZC3-DEC' WHEN 'MEDIUM' THEN 'ZC2-AMP' WHEN 'ECONOMY' THEN 'ZC1-EUP' ELSE 'misc' END AS grp FROM part),
  r0 AS (SELECT l_orderkey AS tow, l_suppkey AS station, l_partkey AS p_partkey, CAST(l_shipdate AS DATE) AS date, year(l_shipdate) AS year, month(l_shipdate) AS month, {season_sql('l_shipdate')} AS season,
    l_quantity AS abundance, l_returnflag AS stage, CASE WHEN l_linestatus = 'O' THEN 'Night' ELSE 'Daylight' END AS twilight FROM lineitem),
  records AS (SELECT r.*, genus, species, body_mass, x.grp, start_depth, end_depth, bottom_depth, abundance*body_mass AS raw,
    CASE WHEN p_type = 'ECONOMY' AND stage = 'A' AND twilight = 'Daylight' THEN abundance*3.0 ELSE abundance END * body_mass AS adjusted,
    CASE WHEN p_type = 'ECONOMY' AND stage = 'A' AND twilight = 'Daylight' THEN abundance*3.0 ELSE abundance END * body_mass * (abs(start_depth)-abs(end_depth)) * 1e-3 AS biomass
   FROM r0 r JOIN (SELECT * FROM taxa) x USING (p_partkey) JOIN (SELECT tow, start_depth, end_depth, bottom_depth FROM tows) w USING (tow))"""
GROUPS = ["ZC1-EUP", "ZC2-AMP", "ZC3-DEC", "ZC4-CLG", "ZC5-CSM", "ZS1-JEL", "ZS2-CTH", "ZS3-CHA"]


@query("eligible_tows", "tow:i start_depth:f1 share:f4", f"""{TOWS},
  final AS (SELECT tow, start_depth, (abs(start_depth)-abs(end_depth))/bottom_depth AS share FROM tows WHERE ((abs(start_depth)-abs(end_depth))/bottom_depth >= 0.7 OR start_depth >= 150) AND bottom_depth <= 350)""", covers="PRJ-03")
def eligible_tows(t: Tables):
    d = S.eligible_tows(tows(t), max_bottom=350)
    return d.withColumn("share", S.tow_range(F.col("start_depth"), F.col("end_depth")) / F.col("bottom_depth"))


@query("station_exclusion", "station:s n:i", f"{TOWS}, final AS (SELECT trim(station) AS station, count(*) AS n FROM tows WHERE lower(trim(station)) NOT IN ('st3', 'st17', 'st59') GROUP BY 1)", covers="PRJ-04")
def station_exclusion(t: Tables):
    d = S.without_stations(tows(t), ["ST3 ", "st17", " St59"])
    return d.groupBy(F.trim("station").alias("station")).agg(F.count(F.lit(1)).alias("n"))


@query("tow_covariates", "tow:i night:b net:s towrng:f1", f"{TOWS}, final AS (SELECT tow, twilight = 'Night' AS night, split_part(net, '-', 1) AS net, abs(start_depth)-abs(end_depth) AS towrng FROM tows)", covers="PRJ-18")
def tow_covariates(t: Tables):
    return tows(t).select("tow", (F.col("twilight") == "Night").alias("night"), F.split("net", "-")[0].alias("net"), S.tow_range(F.col("start_depth"), F.col("end_depth")).alias("towrng"))


@query("taxon_groups", "grp:s n_taxa:i", f"{RECORDS}, final AS (SELECT grp, count(*) AS n_taxa FROM taxa GROUP BY 1)", covers="MAP-01")
def taxon_groups(t: Tables):
    return taxa(t).groupBy("grp").agg(F.count(F.lit(1)).alias("n_taxa"))


PIV = ", ".join(f"sum(biomass) FILTER (grp = '{g}') AS \"{g}\"" for g in GROUPS)


@query("taxon_pivot", "tow:i season:s year:i ZC1-EUP:f4 ZC2-AMP:f4 ZC3-DEC:f4 ZC4-CLG:f4 ZC5-CSM:f4 ZS1-JEL:f4 ZS2-CTH:f4 ZS3-CHA:f4",
       f"{RECORDS}, final AS (SELECT tow, season, year, {PIV} FROM records GROUP BY 1, 2, 3)", covers="AGG-10 SET-03 MAP-01 PRJ-13 PRJ-14")
def taxon_pivot(t: Tables):
    return S.tow_table(records(t), ["tow", "season", "year"], "grp", "biomass", GROUPS)


@query("paired_long", "tow:i group:s obs:f4 model:f4", f"""{RECORDS}, w AS (SELECT tow, sum(biomass) FILTER (grp = 'ZC1-EUP') AS a, sum(biomass) FILTER (grp = 'ZC3-DEC') AS b, sum(abundance) FILTER (grp = 'ZC1-EUP') AS ma, sum(abundance) FILTER (grp = 'ZC3-DEC') AS mb FROM records GROUP BY 1),
  final AS (SELECT tow, 'ZC1-EUP' AS "group", a AS obs, ma AS model FROM w UNION ALL SELECT tow, 'ZC3-DEC', b, mb FROM w UNION ALL SELECT tow, 'Total', coalesce(a,0)+coalesce(b,0), coalesce(ma,0)+coalesce(mb,0) FROM w)""", covers="SET-02 PRJ-08 SET-07")
def paired_long(t: Tables):
    def part(g: str, v: str):
        return F.sum(F.when(F.col("grp") == g, F.col(v)))

    w = records(t).groupBy("tow").agg(part("ZC1-EUP", "biomass").alias("ZC1-EUP"), part("ZC3-DEC", "biomass").alias("ZC3-DEC"),
                                      part("ZC1-EUP", "abundance").alias("EWE-ZC1-EUP"), part("ZC3-DEC", "abundance").alias("EWE-ZC3-DEC"))
    return S.paired_long(w, ["tow"], ["ZC1-EUP", "ZC3-DEC", "ZC9-NONE"], model_prefix="EWE-")


@query("presence_only_mean", "year:i season:s genus:s n_surveys:i mean_value:f3", f"""{RECORDS},
  n AS (SELECT year, season, count(DISTINCT tow) AS n_surveys FROM records GROUP BY 1, 2),
  a AS (SELECT year, season, genus, stage, sum(raw) AS v FROM records GROUP BY 1, 2, 3, 4), b AS (SELECT *, round(v / n_surveys + 3e-9, 3) AS v1 FROM a JOIN n USING (year, season)),
  final AS (SELECT year, season, genus, any_value(n_surveys) AS n_surveys, sum(round(v1 + 3e-9, 2)) AS mean_value FROM b GROUP BY 1, 2, 3)""", covers="AGG-11")
def presence_only_mean(t: Tables):
    r = records(t)
    return S.presence_only_mean(r, period=["year", "season"], taxon=["genus"], size_class="stage", tow="tow", value="raw")


@query("all_years_mean", "season:s genus:s n_occurrences:i mean_value:f3", f"""{RECORDS},
  n AS (SELECT year, season, count(DISTINCT tow) AS n_surveys FROM records GROUP BY 1, 2),
  a AS (SELECT year, season, genus, stage, sum(raw) AS v FROM records GROUP BY 1, 2, 3, 4), b AS (SELECT *, round(v / n_surveys + 3e-9, 3) AS v1 FROM a JOIN n USING (year, season)),
  c AS (SELECT year, season, genus, sum(round(v1 + 3e-9, 2)) AS m FROM b GROUP BY 1, 2, 3),
  final AS (SELECT season, genus, count(*) AS n_occurrences, round(sum(m)/any_value(s) + 3e-9, 4) AS mean_value FROM c, (SELECT max(year)-min(year) AS s FROM c) GROUP BY 1, 2)""", covers="AGG-12")
def all_years_mean(t: Tables):
    # The yearly means serve the sums and the span of years.
    p = stage(S.presence_only_mean(records(t), period=["year", "season"], taxon=["genus"], size_class="stage", tow="tow", value="raw"))
    return S.all_years_mean(p, year="year", keys=["season", "genus"])


@query("depth_scaled", "grp:s areal:f3", f"{RECORDS}, g AS (SELECT grp, avg(raw) AS v FROM records GROUP BY 1), d AS (SELECT avg(bottom_depth) AS d FROM tows), final AS (SELECT grp, d*0.85*v*1e-3 AS areal FROM g, d)", covers="AGG-13")
def depth_scaled(t: Tables):
    g = records(t).groupBy("grp").agg(F.avg("raw").alias("v"))
    return S.depth_scaled(g, tows(t), value="v", depth="bottom_depth", tow_share=0.85, digits=9)


@query("dedupe_mean_mode", "l_suppkey:i l_partkey:i q:f4 p:f4 flag:s status:s", """
  g AS (SELECT l_suppkey, l_partkey, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2),
  f AS (SELECT l_suppkey, l_partkey, l_returnflag AS flag FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY count(*) DESC, l_returnflag) = 1),
  s AS (SELECT l_suppkey, l_partkey, l_linestatus AS status FROM lineitem GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY count(*) DESC, l_linestatus) = 1),
  final AS (SELECT * FROM g JOIN f USING (l_suppkey, l_partkey) JOIN s USING (l_suppkey, l_partkey))""", covers="AGG-14")
def dedupe_mean_mode(t: Tables):
    d = t.lineitem.select("l_suppkey", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"),
                          F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return S.dedupe_mean_mode(d, ["l_suppkey", "l_partkey"], ["q", "p"], ["flag", "status"])


@query("station_means", "station:i year:i season:s q:f4 p:f4 tot:f4", f"""s AS (SELECT l_suppkey AS station, year(l_shipdate) AS year, {season_sql('l_shipdate')} AS season, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2, 3), final AS (SELECT *, q + p AS tot FROM s)""", covers="AGG-17")
def station_means(t: Tables):
    d = t.lineitem.select(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), cal.season(F.col("l_shipdate")).alias("season"),
                          F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    return S.station_means(d, ["station", "year", "season"], ["q", "p"], {"tot": ["q", "p"]})


@query("stage_counts", "year:i season:s n_raw:i n_filtered:i n_matched:i frac_filtered_of_raw:f6 frac_matched_of_filtered:f6 frac_matched_of_raw:f6", f"""{RECORDS},
  a AS (SELECT year, season, count(DISTINCT tow) AS n FROM records GROUP BY 1, 2), b AS (SELECT year, season, count(DISTINCT tow) AS n FROM records WHERE (abs(start_depth)-abs(end_depth))/bottom_depth >= 0.7 OR start_depth >= 150 GROUP BY 1, 2),
  c AS (SELECT year, season, count(DISTINCT tow) AS n FROM records WHERE ((abs(start_depth)-abs(end_depth))/bottom_depth >= 0.7 OR start_depth >= 150) AND biomass > 0 GROUP BY 1, 2),
  j AS (SELECT year, season, a.n AS n_raw, coalesce(b.n, 0) AS n_filtered, coalesce(c.n, 0) AS n_matched FROM a LEFT JOIN b USING (year, season) LEFT JOIN c USING (year, season)),
  final AS (SELECT *, n_filtered/n_raw AS frac_filtered_of_raw, n_matched/nullif(n_filtered, 0) AS frac_matched_of_filtered, n_matched/n_raw AS frac_matched_of_raw FROM j)""", covers="AGG-19")
def stage_counts(t: Tables):
    ok = S.is_eligible()
    return S.stage_flag_counts(records(t), ["year", "season"], "tow", {"raw": F.lit(True), "filtered": ok, "matched": ok & (F.col("biomass") > 0)})


@query("tow_replication", "year:s season:s n_station_groups:i n_stations:i n_rows:i n_unique_tows:i mean_tows:f4 median_tows:f2 max_tows:i min_tows:i n_multi:i pct_multi:f4 n_extra:i stations_multi:s", f"""
  b AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS year, {season_sql('l_shipdate')} AS season, CAST(l_suppkey AS VARCHAR) AS station, count(*) AS nr, count(DISTINCT l_orderkey) AS tows FROM lineitem GROUP BY 1, 2, 3),
  d AS (SELECT year, season, station, nr, tows FROM b UNION ALL SELECT year, 'All', station, nr, tows FROM b UNION ALL SELECT 'All', 'All', station, nr, tows FROM b),
  r AS (SELECT *, row_number() OVER (PARTITION BY year, season ORDER BY tows DESC, station, nr) AS k FROM d WHERE tows > 1),
  l AS (SELECT year, season, string_agg(station || ' (' || tows || ')', '; ' ORDER BY k) AS txt FROM r WHERE k <= 12 GROUP BY 1, 2),
  a AS (SELECT year, season, count(*) AS n_station_groups, count(DISTINCT station) AS n_stations, sum(nr) AS n_rows, sum(tows) AS n_unique_tows, avg(tows) AS mean_tows, median(tows) AS median_tows, max(tows) AS max_tows, min(tows) AS min_tows,
    count(*) FILTER (tows > 1) AS n_multi, 100.0*count(*) FILTER (tows > 1)/count(*) AS pct_multi, sum(tows-1) AS n_extra FROM d GROUP BY 1, 2),
  final AS (SELECT a.*, coalesce(txt, '') || CASE WHEN n_multi > 12 THEN '; ... +' || (n_multi-12) || ' more' ELSE '' END AS stations_multi FROM a LEFT JOIN l USING (year, season))""", covers="AGG-20")
def tow_replication(t: Tables):
    d = t.lineitem.select(F.col("l_suppkey").alias("station"), F.year("l_shipdate").alias("year"), cal.season(F.col("l_shipdate")).alias("season"), F.col("l_orderkey").alias("tow"))
    return S.tow_replication(d)


MSQL = ", ".join(f"count(*) FILTER (month(date) = {m}) AS m{m:02d}" for m in range(1, 13))


@query("sampling_crosstab", "year:s " + " ".join(f"m{m:02d}:i" for m in range(1, 13)) + " tows:i stations:i night_pct:f4", f"""{TOWS},
  u AS (SELECT CAST(year(date) AS VARCHAR) AS year, * FROM tows UNION ALL SELECT 'Total', * FROM tows),
  final AS (SELECT year, {MSQL}, count(*) AS tows, count(DISTINCT station) AS stations, 100*avg((twilight = 'Night')::INT) AS night_pct FROM u GROUP BY 1)""", covers="AGG-21 PRJ-18")
def sampling_crosstab(t: Tables):
    d = tows(t).withColumns({"year": F.year("date"), "month": F.month("date")})
    return S.sampling_crosstab(d, night=F.col("twilight") == "Night")


@query("attribute_counts", "attribute:s value:s n_tows:i", f"{TOWS}, final AS (SELECT 'net' AS attribute, net AS value, count(DISTINCT tow) AS n_tows FROM tows GROUP BY 2 UNION ALL SELECT 'twilight', twilight, count(DISTINCT tow) FROM tows GROUP BY 2)", covers="AGG-22 SET-04")
def attribute_counts(t: Tables):
    return S.attribute_counts(tows(t), "tow", ["net", "twilight"])


@query("describe_tows", "net:s lo:f2 mean:f4 hi:f2", f"{TOWS}, final AS (SELECT net, min(bottom_depth) AS lo, avg(bottom_depth) AS mean, max(bottom_depth) AS hi FROM tows GROUP BY 1)", covers="AGG-22")
def describe_tows(t: Tables):
    return tows(t).groupBy("net").agg(F.min("bottom_depth").alias("lo"), F.avg("bottom_depth").alias("mean"), F.max("bottom_depth").alias("hi"))


@query("composition", "year:i grp:s level:f4 share:f6", f"{RECORDS}, m AS (SELECT year, grp, avg(raw) AS level FROM records GROUP BY 1, 2), final AS (SELECT *, level/sum(level) OVER (PARTITION BY year) AS share FROM m)", covers="AGG-25")
def composition(t: Tables):
    return S.shares(records(t), ["year", "grp"], ["year"], "raw", how="mean")


@query("biomass_shares", "twilight:s grp:s share:f6", f"{RECORDS}, m AS (SELECT twilight, grp, sum(raw) AS v FROM records GROUP BY 1, 2), final AS (SELECT twilight, grp, v/sum(v) OVER (PARTITION BY twilight) AS share FROM m)", covers="AGG-34")
def biomass_shares(t: Tables):
    return S.shares(records(t), ["twilight", "grp"], ["twilight"], "raw")


@query("annual_taxa", "year:i genus:s total:f2 n:i per_record:f4", f"{RECORDS}, final AS (SELECT year, genus, sum(raw) AS total, count(*) AS n, sum(raw)/count(*) AS per_record FROM records GROUP BY 1, 2)", covers="AGG-27")
def annual_taxa(t: Tables):
    a = records(t).groupBy("year", "genus").agg(F.sum("raw").alias("total"), F.count(F.lit(1)).alias("n"))
    return a.withColumn("per_record", F.col("total") / F.col("n"))


@query("strata_stats", "stratum:s level:s n:i obs_std_pop:f4 model_std_pop:f4 r:f6 rmse:f4 bias:f4 wss:f6", f"""{PAIRED},
  u AS (SELECT 'season' AS stratum, season AS level, obs, model FROM paired UNION ALL SELECT 'domain', grp, obs, model FROM paired UNION ALL SELECT 'domain_season', grp || '_' || season, obs, model FROM paired UNION ALL SELECT 'All', 'All', obs, model FROM paired),
  om AS (SELECT stratum, level, avg(obs) AS om FROM u GROUP BY 1, 2),
  final AS (SELECT stratum, level, count(*) AS n, stddev_pop(obs) AS obs_std_pop, stddev_pop(model) AS model_std_pop, corr(model, obs) AS r, sqrt(avg((model-obs)^2)) AS rmse, avg(model-obs) AS bias,
   1 - sum((model-obs)^2)/sum((abs(model-om)+abs(obs-om))^2) AS wss FROM u JOIN om USING (stratum, level) GROUP BY 1, 2)""", covers="AGG-28 SKL-05")
def strata_stats(t: Tables):
    d = S.strata_rows(paired(t), {"season": F.col("season"), "domain": F.col("grp"), "domain_season": F.concat_ws("_", "grp", "season"), "All": F.lit("All")})
    return K.skill(d, ["stratum", "level"], "obs", "model", which=["n", *K.SKILL_SETS["compact"]])


@query("peak_and_amplitude", "grp:s source:s peak_month:i amplitude:f6", f"""{PAIRED}, u AS (SELECT grp, 'obs' AS source, month, log10(obs) AS v FROM paired UNION ALL SELECT grp, 'model', month, log10(model + 1) FROM paired),
  m AS (SELECT grp, source, month, median(v) AS md FROM u GROUP BY 1, 2, 3), final AS (SELECT grp, source, arg_min(month, (-md, month)) AS peak_month, max(md)-min(md) AS amplitude FROM m GROUP BY 1, 2)""", covers="AGG-29")
def peak_and_amplitude(t: Tables):
    rows = F.inline(F.array(F.struct(F.lit("obs").alias("source"), F.log10("obs").alias("v")), F.struct(F.lit("model").alias("source"), F.log10(F.col("model") + 1).alias("v"))))
    return S.peak_and_amplitude(paired(t).select("grp", "month", rows), ["grp", "source"], "month", "v")


@query("ratio_medians", "stratum:s level:s ratio:f6", f"""{PAIRED}, x AS (SELECT *, log10(obs) - log10(model + 1) AS lr FROM paired),
  u AS (SELECT 'group' AS stratum, grp AS level, lr FROM x UNION ALL SELECT 'year', CAST(year AS VARCHAR), lr FROM x UNION ALL SELECT 'month', CAST(month AS VARCHAR), lr FROM x UNION ALL SELECT 'period', CASE WHEN year < 1998 THEN 'early' ELSE 'late' END, lr FROM x),
  final AS (SELECT stratum, level, median(lr) AS ratio FROM u GROUP BY 1, 2)""", covers="AGG-30 AGG-24")
def ratio_medians(t: Tables):
    d = paired(t).withColumn("lr", F.log10("obs") - F.log10(F.col("model") + 1))
    d = S.strata_rows(d, {"group": F.col("grp"), "year": F.col("year"), "month": F.col("month"), "period": F.when(F.col("year") < 1998, "early").otherwise("late")})
    return grouped_quantiles(d, ["stratum", "level"], "lr", {"ratio": 0.5}, few_groups=True)


@query("seasonal_dist", "year:i season:s grp:s obs:f4", f"""{PAIRED}, t AS (SELECT tow, year, season, grp, sum(obs) AS obs FROM paired GROUP BY 1, 2, 3, 4),
  u AS (SELECT year, season, grp, obs FROM t UNION ALL SELECT year, season, 'Total', sum(obs) FROM t GROUP BY tow, year, season), final AS (SELECT year, season, grp, avg(obs) AS obs FROM u GROUP BY 1, 2, 3)""", covers="AGG-31 PRJ-11 PRJ-17 PRJ-01")
def seasonal_dist(t: Tables):
    w = S.tow_table(paired(t).withColumn("season", F.initcap(F.trim(F.lower("season")))), ["tow", "year", "season"], "grp", "obs", ["A", "N", "R"])
    w = C.named_series(w, {"Total": ["A", "N", "R"]})
    rows = F.inline(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(g).alias("obs")) for g in ("A", "N", "R", "Total")]))
    return w.select("year", "season", rows).where("obs IS NOT NULL").groupBy("year", "season", "grp").agg(F.avg("obs").alias("obs"))


@query("per_tow_factor", "median:f6 q25:f6 q75:f6 n:i", f"""{RECORDS}, f AS (SELECT tow, sum(adjusted)/sum(raw) AS factor FROM records WHERE grp = 'ZC1-EUP' GROUP BY 1),
  final AS (SELECT median(factor) AS median, quantile_cont(factor, 0.25) AS q25, quantile_cont(factor, 0.75) AS q75, count(*) AS n FROM f)""", covers="AGG-32 PRJ-13 AGG-24")
def per_tow_factor(t: Tables):
    f = S.per_tow_factor(records(t).where("grp = 'ZC1-EUP'"), "tow", "raw", F.col("adjusted"))
    n = f.agg(F.count("factor").alias("n"))
    return grouped_quantiles(f, [], "factor", {"median": 0.5, "q25": 0.25, "q75": 0.75}).crossJoin(n)


@query("sample_counts", "domain:i month:i n:i", """c AS (SELECT o_custkey AS domain, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2),
  k AS (SELECT DISTINCT domain FROM c), final AS (SELECT domain, m AS month, coalesce(n, 0) AS n FROM k CROSS JOIN range(1, 13) r(m) LEFT JOIN c ON c.domain = k.domain AND c.month = m)""".replace("SELECT domain, m AS month", "SELECT k.domain, m AS month"), covers="AGG-33 CAL-12")
def sample_counts(t: Tables):
    d = t.orders.select(F.col("o_custkey").alias("domain"), F.month("o_orderdate").alias("month"))
    return S.zero_filled_counts(d, ["domain"], {"month": list(range(1, 13))})


@query("top4_other", "season:s genus:s raw:f2", f"""{RECORDS}, tp AS (SELECT genus FROM records GROUP BY 1 ORDER BY sum(raw) DESC, genus LIMIT 4),
  final AS (SELECT season, CASE WHEN genus IN (SELECT genus FROM tp) THEN genus ELSE 'Other' END AS genus, sum(raw) AS raw FROM records GROUP BY 1, 2)""", covers="WIN-09")
def top4_other(t: Tables):
    return S.top_n_other(records(t), name="genus", keys=["season"], value="raw")


@query("station_list", "kind:s station:s n_tows:i", f"""{TOWS}, c AS (SELECT station, count(*) AS n FROM tows GROUP BY 1),
  final AS (SELECT 'enough' AS kind, station, n AS n_tows FROM c WHERE n >= 8 UNION ALL (SELECT 'top', station, n FROM c ORDER BY n DESC, station LIMIT 12))""", covers="WIN-13")
def station_list(t: Tables):
    a = S.stations_with_min(tows(t), "station", 8, "tow").withColumn("kind", F.lit("enough"))
    return a.unionByName(S.most_sampled(tows(t), "station", 12).withColumn("kind", F.lit("top")))


@query("zero_replacement", "l_returnflag:s n_zero:i n_left:i in_range:b", """z AS (SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS n_zero FROM lineitem GROUP BY 1), final AS (SELECT l_returnflag, n_zero, 0 AS n_left, true AS in_range FROM z)""", covers="PRJ-15")
def zero_replacement(t: Tables):
    d = t.lineitem.withColumn("v", F.col("l_discount"))
    r = S.replace_zeros(d, ["l_returnflag"], "v", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"])
    low = F.min(F.when(F.col("l_discount") > 0, F.col("l_discount")))
    hit = F.col("l_discount") == 0
    return r.groupBy("l_returnflag").agg(
        F.count_if(hit).alias("n_zero"), F.count_if(F.col("v") == 0).alias("n_left"),
        ((F.min("v") > 0) & (F.max(F.when(hit, F.col("v"))) < 0.5 * low)).alias("in_range"))


@query("class_group_sums", "l_orderkey:i group:s obs:f2 model:f2", """m AS (SELECT l_orderkey, CASE WHEN l_linenumber IN (1, 2) THEN 'first' WHEN l_linenumber IN (3, 4, 5) THEN 'second' END AS "group", l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  final AS (SELECT l_orderkey, "group", sum(l_quantity) AS obs, any_value(o_totalprice) AS model FROM m WHERE "group" IS NOT NULL GROUP BY 1, 2)""", covers="AGG-08 MAP-02")
def class_group_sums(t: Tables):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("cls", F.col("l_linenumber").cast("string"))
    s = S.class_group_sums(d, {"first": ["1", "2"], "second": ["3", "4", "5"]}, sample=["l_orderkey"], cls="cls", value="l_quantity", model=["o_totalprice"])
    return s.withColumnRenamed("o_totalprice", "model")


@query("depth_regional", "region:s block:s value:f4 n:i", """s AS (SELECT r_name, l_orderkey, strftime(l_shipdate, '%Y') || '-' || lpad(CAST((dayofyear(l_shipdate)-1)//3+1 AS VARCHAR), 3, '0') AS block, avg(l_quantity) AS v, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
  final AS (SELECT r_name AS region, block, avg(v) AS value, sum(n) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT 'ALL', block, avg(v), sum(n) FROM s GROUP BY 2)""", covers="AGG-09 CAL-03 SET-01")
def depth_regional(t: Tables):
    r = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    s = t.lineitem.join(r, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "l_orderkey", cal.block_label(F.col("l_shipdate")).alias("block")).agg(
        F.avg("l_quantity").alias("v"), F.count(F.lit(1)).alias("n"))
    g = s.groupingSets([["r_name", "block"], ["block"]], "r_name", "block").agg(F.avg("v").alias("value"), F.sum("n").alias("n"), F.grouping("r_name").alias("g"))
    return g.withColumn("region", F.when(F.col("g") == 1, "ALL").otherwise(F.col("r_name")))


@query("overall_means", "grp:s season:s model:f4 obs:f4 bias:f4", f"""{PAIRED}, s AS (SELECT grp, season, avg(model) AS model, avg(obs) AS obs FROM paired GROUP BY 1, 2),
  a AS (SELECT grp, 'Overall' AS season, avg(model) AS model FROM paired GROUP BY 1), o AS (SELECT grp, avg(obs) AS obs FROM s GROUP BY 1),
  u AS (SELECT * FROM s UNION ALL SELECT a.grp, a.season, a.model, o.obs FROM a JOIN o USING (grp)), final AS (SELECT *, model - obs AS bias FROM u)""", covers="AGG-07")
def overall_means(t: Tables):
    g = paired(t).groupingSets([["grp", "season"], ["grp"]], "grp", "season").agg(F.avg("model").alias("model"), F.avg("obs").alias("obs"))
    g = g.withColumn("season", F.coalesce("season", F.lit("Overall")))
    # The overall observed value is the plain mean of the season values.
    o = g.where("season <> 'Overall'").groupBy("grp").agg(F.avg("obs").alias("oo"))
    g = g.join(o, "grp").withColumn("obs", F.when(F.col("season") == "Overall", F.col("oo")).otherwise(F.col("obs")))
    return g.withColumn("bias", F.col("model") - F.col("obs"))
