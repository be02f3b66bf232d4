"""Operators against brute force, also with one key holding most of the rows."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import clean as C
from tidewright.functions import geo as G
from tidewright.operators import anomaly as A
from tidewright.operators import depth as D
from tidewright.operators import joins as J
from tidewright.operators import quantiles as Q
from tidewright.operators import skill as K
from tidewright.operators import spatial as S

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@SLOW
@given(st.lists(st.integers(0, 200), min_size=1, max_size=40), st.lists(st.integers(0, 200), min_size=1, max_size=12, unique=True),
       st.sampled_from([None, 5.0, 30.0]), st.sampled_from([3.0, 20.0, None]))
def test_asof_matches_brute_force(spark, obs, model, tol, width):
    o = spark.createDataFrame([(i, "k", float(t)) for i, t in enumerate(obs)], "id int, k string, t double")
    m = spark.createDataFrame([("k", float(t), float(t) * 10) for t in model], "k string, mt double, v double")
    got = {r.id: r.v for r in J.asof_nearest(o, m, keys=["k"], obs_t="t", model_t="mt", values=["v"], tolerance=tol, bucket_width=width, rows_per_bucket=3).collect()}
    for i, t in enumerate(obs):
        best = min(sorted(model), key=lambda x: abs(x - t))
        want = best * 10.0 if tol is None or abs(best - t) <= tol else None
        assert got[i] == want
    assert len(got) == len(obs)


def test_counted_buckets_split_one_hour(spark):
    """Nine of ten times of one key in one hour of thirty years: ordered buckets, none beyond twice the bound."""
    hour, years, bound = 3_600_000_000, 946_000_000_000_000, 500
    rnd = random.Random(11)
    t = {years // 3 + rnd.randrange(hour) for _ in range(18_000)} | {rnd.randrange(years) for _ in range(2_000)} | {0, years}
    rows = [("hot", float(x)) for x in sorted(t)] + [("few", 5.0), ("few", 9.0), ("one", 3.0), (None, 4.0), (None, 4.5)]
    d = J.counted_buckets(spark.createDataFrame(rows, "k string, t double"), ["k"], "t", bound)
    b = d.groupBy("k", "__b").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("k", "__b").collect()
    hot = [x for x in b if x.k == "hot"]
    assert sum(x.n for x in b) == len(rows) and max(x.n for x in b) <= 2 * bound and len(hot) >= len(t) // (2 * bound)
    assert all(x.hi < y.lo for x, y in zip(hot, hot[1:])) and sorted((x.k is None, x.n) for x in b if x.k != "hot") == [(False, 1), (False, 2), (True, 2)]


def test_asof_of_clustered_times(spark):
    rnd = random.Random(12)
    at = lambda n: [1e9 + rnd.randrange(3600) if rnd.random() < 0.9 else float(rnd.randrange(10**10)) for _ in range(n)]
    obs, model = at(1500), sorted(set(at(400)))
    o = spark.createDataFrame([(i, t) for i, t in enumerate(obs)], "id int, t double")
    m = spark.createDataFrame([(t, t / 7) for t in model], "mt double, v double")
    got = {r.id: (r.matched_t, r.v) for r in J.asof_nearest(o, m, obs_t="t", model_t="mt", values=["v"], rows_per_bucket=40).collect()}
    near = {t: min(model, key=lambda x: (abs(x - t), x)) for t in obs}
    assert got == {i: (near[t], near[t] / 7) for i, t in enumerate(obs)}


def test_asof_tie_gap_and_duplicates(spark):
    o = spark.createDataFrame([(2.0,), (2.0,), (50.0,), (None,)], "t double")
    m = spark.createDataFrame([(1.0, 7.0), (1.0, 5.0), (3.0, 9.0)], "mt double, v double")
    r = J.asof_nearest(o, m, obs_t="t", model_t="mt", values=["v"], tolerance=3).collect()
    assert sorted(((x.t is None, x.t, x.v) for x in r), key=str) == sorted([(False, 2.0, 5.0), (False, 2.0, 5.0), (False, 50.0, None), (True, None, None)], key=str)


def test_order_codes_keep_the_order(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 64, 3000, np.uint64).view(np.float64)
    near = [f(2.0**k) for k in range(-1074, 1024, 7) for f in (float, lambda v: np.nextafter(v, 0), lambda v: -np.nextafter(v, 9e300))]
    x = sorted(float(v) for v in [*x[np.isfinite(x)], *near, 0.0, -0.0, 5e-324, np.inf, -np.inf])
    one, two = Q.order_codes(F.col("v"))
    rows = spark.createDataFrame([(v,) for v in x], "v double").select("v", one.alias("a"), two.alias("b")).collect()
    codes = [(r.a, r.b) for r in sorted(rows, key=lambda r: r.v)]
    assert codes == sorted(codes) and len(set(codes)) > 1000


def test_quantiles_of_a_million_values_in_one_group(spark):
    """One scan, and no window over more than a part of the values."""
    n = 1_000_003
    d = spark.range(n).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % n / 1000 - 300).alias("v"))
    q = Q.grouped_quantiles(d, ["k"], "v", {"lo": 0.0, "a": 0.1, "b": 0.5, "hi": 1.0})
    r = q.collect()[0]
    assert (r.lo, r.a, r.b, r.hi) == pytest.approx((-300, (n - 1) / 10 / 1000 - 300, (n - 1) / 2 / 1000 - 300, (n - 1) / 1000 - 300), abs=1e-9)
    plan = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Range (") <= 1


def test_quantiles_with_a_hot_group_and_ties(spark):
    rnd = random.Random(3)
    rows = [("hot", rnd.gauss(0, 5)) for _ in range(3000)] + [("hot", 1.5)] * 2000 + [("small", float(i)) for i in range(7)] + [("one", 4.0), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in Q.grouped_quantiles(d, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9, "lo": 0.0, "hi": 1.0}).collect()}
    assert set(got) == {"hot", "small", "one"}
    for k in got:
        v = [x for kk, x in rows if kk == k]
        for name, p in (("a", 10), ("b", 50), ("c", 90), ("lo", 0), ("hi", 100)):
            assert got[k][name] == pytest.approx(np.percentile(v, p), rel=1e-12, abs=1e-12)
    total = Q.grouped_quantiles(d, [], "v", {"m": 0.5}).first().m
    assert total == pytest.approx(np.median([x for _, x in rows if x is not None]))


def test_medians_of_several_columns(spark):
    d = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, None), ("a", 9.0, 7.0)], "k string, x double, y double")
    r = Q.grouped_medians(d, ["k"], ["x", "y"]).first()
    assert (r.x, r.y) == (2.0, 6.0)


def test_next_row_across_buckets(spark):
    z = [0.5, 3.0, 80.0, 81.0, 400.0]
    d = spark.createDataFrame([("p", v, v * 2) for v in z], "k string, z double, c double")
    got = {r.z: (r.next_z, r.next_c) for r in J.with_next(d, ["k"], "z", ["z", "c"], F.floor(F.col("z") / 10)).collect()}
    assert got == {a: (b, None if b is None else b * 2) for a, b in zip(z, [*z[1:], None])}


def test_group_stats_keep_every_row(spark):
    d = spark.range(1000).select(F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, None).otherwise("cold").alias("k"), F.col("id").alias("v"))
    r = J.with_group_stats(d, ["k"], m=F.avg("v"), n=F.count(F.lit(1)))
    assert {(x.k, x.n, x["count"]) for x in r.groupBy("k", "n").count().collect()} == {("hot", 900, 900), (None, 90, 90), ("cold", 10, 10)}


def test_nearest_cell_of_far_points(spark):
    """Points 40 degrees from a dense grid find their cell, ties going to the least one, and meet few boxes on the way."""
    cells = [(r * 100 + c, 48 + r / 50, -125 + c / 50) for r in range(100) for c in range(100)]
    pts = [(0, 8.0, -124.0), (1, 88.0, -124.0), (2, 49.0, -165.3), (3, 49.0, -83.0), (4, 9.5, -160.0), (5, 49.003, -124.004), (6, 49.99, -123.5), (7, 49.01, -124.01)]
    g = spark.createDataFrame(cells, "cell int, glat double, glon double")
    p = spark.createDataFrame([*pts, (8, None, 3.0)], "id int, lat double, lon double")
    a = dict(lat="lat", lon="lon", glat="glat", glon="glon", cell=["cell"])
    for scale in (None, 1.0):
        got = {r.id: (r.cell, r.dist_deg) for r in S.nearest_cell_planar(p, g, lon_scale=scale, **a).collect()}
        for i, la, lo in pts:
            k = math.cos(math.radians(la)) if scale is None else scale
            d = {x[0]: math.sqrt((x[1] - la) ** 2 + ((x[2] - lo) * k) ** 2) for x in cells}
            assert got[i][1] == pytest.approx(min(d.values())) and d[got[i][0]] == pytest.approx(min(d.values()), abs=1e-13)
        assert got[8] == (None, None)


def test_descent_meets_few_boxes(spark):
    g = spark.range(250_000).select(F.struct(F.col("id").alias("cell")).alias("cell"), (F.lit(40.0) + F.floor(F.col("id") / 500) / 50).alias("g_lat"),
                                    (F.lit(-130.0) + F.col("id") % 500 / 50).alias("g_lon"))
    far = [(8.0, -126.0), (85.0, -124.0), (45.0, -165.3), (46.3, -83.0), (2.0, -170.0), (45.111, -125.555)]
    p = spark.createDataFrame([(la, lo, 0.7) for la, lo in far], "p_lat double, p_lon double, k double")
    met = []
    best = S._descend(p, g, 0.01, met.append).collect()
    assert len(best) == len(far) and len(met) == 5
    for level in met:
        assert max(r["count"] for r in level.groupBy("p_lat", "p_lon").count().collect()) <= 16
    for r in best:
        want = min((math.hypot(40 + i // 500 / 50 - r.p_lat, (-130 + i % 500 / 50 - r.p_lon) * 0.7)) for i in range(250_000))
        assert r.m.d == pytest.approx(want)


def test_nearest_cells_match_brute_force(spark):
    rnd = random.Random(5)
    cells = [(i, rnd.uniform(48, 50), rnd.uniform(-125, -123), rnd.random() < 0.7) for i in range(150)]
    pts = [(i, rnd.uniform(47.5, 50.5), rnd.uniform(-126, -122)) for i in range(40)] + [(40, 30.0, 100.0)]
    g = spark.createDataFrame(cells, "cell int, glat double, glon double, wet boolean")
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    a = dict(lat="lat", lon="lon", glat="glat", glon="glon", cell=["cell"])

    def hav(la, lo, gla, glo):
        h = math.sin(math.radians(gla - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(gla)) * math.sin(math.radians(glo - lo) / 2) ** 2
        return 2 * 6367 * math.asin(math.sqrt(h))

    box = {r.id: r.cell for r in S.nearest_cell_in_box(p, g, dx=0.2, mask=F.col("wet"), **a).collect()}
    near = {r.id: (r.cell, r.dist_deg) for r in S.nearest_cell_planar(p, g, lon_scale=None, **a).collect()}
    lim = {r.id: r.cell for r in S.nearest_cell_planar(p, g, lon_scale=0.65, max_km=15, **a).collect()}
    for i, la, lo in pts:
        c = [(hav(la, lo, x[1], x[2]), x[0]) for x in cells if x[3] and abs(x[1] - la) < 0.2 and abs(x[2] - lo) < 0.2]
        assert box[i] == (min(c)[1] if c else None)
        k = math.cos(math.radians(la))
        d, c = min((math.hypot(x[1] - la, (x[2] - lo) * k), x[0]) for x in cells)
        assert near[i][0] == c and near[i][1] == pytest.approx(d)
        d, c = min((math.hypot(x[1] - la, (x[2] - lo) * 0.65), x[0]) for x in cells)
        assert lim[i] == (c if d * 111 <= 15 else None)


def test_box_is_open(spark):
    g = spark.createDataFrame([(1, 49.0, -124.0)], "cell int, glat double, glon double")
    p = spark.createDataFrame([(1, 49.25, -124.0), (2, 49.125, -124.0)], "id int, lat double, lon double")
    r = {x.id: x.cell for x in S.nearest_cell_in_box(p, g, lat="lat", lon="lon", glat="glat", glon="glon", cell=["cell"], dx=0.25).collect()}
    assert r == {1: None, 2: 1}


@SLOW
@given(st.integers(3, 9), st.integers(0, 10_000))
def test_polygon_against_half_planes(spark, n, seed):
    rnd = random.Random(seed)
    ang = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(49 + math.sin(a), -124 + math.cos(a)) for a in ang]
    pts = [(i, rnd.uniform(47.8, 50.2), rnd.uniform(-125.2, -122.8)) for i in range(60)]
    got = {r.id: r.hit for r in spark.createDataFrame(pts, "id int, y double, x double").select("id", G.in_ring(F.col("y"), F.col("x"), ring).alias("hit")).collect()}
    closed = [*ring, ring[0]]
    for i, y, x in pts:
        inside = all((b[1] - a[1]) * (y - a[0]) - (b[0] - a[0]) * (x - a[1]) > 0 for a, b in zip(closed[:-1], closed[1:]))
        assert got[i] == inside


def test_first_domain_wins(spark):
    sq = {"a": [(0, 0), (0, 2), (2, 2), (2, 0)], "b": [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]}
    r = spark.createDataFrame([(1.5, 1.5), (2.5, 2.5), (9.0, 9.0)], "y double, x double").select(G.first_domain(F.col("y"), F.col("x"), sq).alias("d"))
    assert [x.d for x in r.collect()] == ["a", "b", None]


@SLOW
@given(st.floats(-3, 3), st.floats(-50, 50), st.lists(st.floats(0, 30), min_size=2, max_size=8, unique=True))
def test_linear_profile_has_exact_area(spark, slope, icept, depths):
    z = sorted({round(x, 1) for x in depths} | {0.0, 30.0})
    d = spark.createDataFrame([("p", x, icept + slope * x) for x in z], "k string, z double, c double")
    r = D.profile_integral(d, ["k"], "z", "c", zmin=2, zmax=25, pad_surface=1, pad_deep=1).first()
    assert r.integral == pytest.approx(icept * 23 + slope * (25**2 - 2**2) / 2, abs=1e-6)


def test_profile_rules(spark):
    rows = [("dup", 1.0, 2.0), ("dup", 1.0, 4.0), ("dup", 9.0, 5.0), ("single", 4.0, 7.0), ("gap", 4.0, 1.0), ("gap", 9.0, 1.0), ("deep", 30.0, 1.0), ("deep", 40.0, 2.0)]
    d = spark.createDataFrame(rows, "k string, z double, c double")
    a = dict(zmin=0, zmax=10, pad_surface=2, pad_deep=2)
    r = {x.k: x for x in D.profile_integral(d, ["k"], "z", "c", **a).collect()}
    assert set(r) == {"dup", "single"}
    assert r["dup"].integral == pytest.approx(3 * 1 + 8 * (3 + 5) / 2 + 5 * 1) and r["dup"].n_depths == 2 and r["dup"].pad_surface and not r["dup"].extrap_deep
    assert r["single"].integral == 70 and r["single"].extrap_surface
    e = {x.k: x for x in D.profile_integral(d, ["k"], "z", "c", extrapolate=True, **a).collect()}
    assert e["gap"].integral == pytest.approx(10) and e["gap"].extrap_surface and e["deep"].integral == pytest.approx(10)
    assert D.profile_integral(d, ["k"], "z", "c", allow_single=False, **a).count() == 1
    s = {x.k: x.integral for x in D.profile_integral_sampled(d, ["k"], "z", "c", zmin=0, zmax=10, factor=1.0).collect()}
    assert s["dup"] == pytest.approx(32) and s["single"] is None and s["deep"] is None


def test_skill_limits(spark):
    d = spark.createDataFrame([("same", 1.0, 1.0), ("same", 3.0, 3.0), ("one", 2.0, 5.0), ("zero", 0.0, 1.0), ("zero", 2.0, 1.0), ("none", None, 1.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0)],
                              "k string, o double, m double")
    r = {x.k: x for x in K.skill(d, ["k"], "o", "m", which=["n", "wss", "nse", "mape", "r", "rmse", "obs_std"]).collect()}
    assert set(r) == {"same", "one", "zero", "flat"}
    assert r["same"].wss == 1 and r["same"].nse == 1 and r["one"].r is None and r["one"].obs_std is None and r["zero"].mape is None
    assert r["flat"].wss is None and r["flat"].nse is None


def test_anomalies_are_standardised(spark):
    rnd = random.Random(1)
    rows = [(f"t{y}{i}", "g", "Spring", y, rnd.uniform(1, 9), rnd.uniform(1, 9)) for y in range(2000, 2009) for i in range(2 if y == 2004 else 3)]
    p = spark.createDataFrame(rows, "tow string, grp string, season string, year int, obs double, model double")
    a = A.seasonal_anomalies(p, with_all=False).toPandas()
    base = a[a.n_tows >= 3]
    assert len(a) == 9 and len(base) == 8
    assert base.obs_anom.mean() == pytest.approx(0, abs=1e-9) and base.obs_anom.std() == pytest.approx(1)
    flat = p.withColumn("obs", F.lit(4.0))
    assert A.seasonal_anomalies(flat, with_all=False).where("obs_anom IS NOT NULL").count() == 0
    pooled = A.pooled_anomalies(p, ["grp"]).toPandas().set_index("year")
    pd_ = p.toPandas()
    z = (pd_.obs - pd_.obs.mean()) / pd_.obs.std()
    assert pooled.obs_anom.sort_index().tolist() == pytest.approx(z.groupby(pd_.year).mean().tolist())


def test_weighted_climatology(spark):
    v, n = [1.0, 2.0, 4.0, 7.0], [3, 5, 9, 2]
    d = spark.createDataFrame([("g", y, x, x, k) for y, (x, k) in enumerate(zip(v, n))], "g string, year int, obs_value double, model_value double, n_tows int")
    r = A.climatology_anomalies(d, ["g"], mode="year_weighted", cap=6).orderBy("year").toPandas()
    w = np.sqrt(np.minimum(n[:3], 6))
    x = np.array(v[:3])
    mu = (w * x).sum() / w.sum()
    sd = math.sqrt((w * (x - mu) ** 2).sum() / (w.sum() - (w**2).sum() / w.sum()))
    assert r.obs_anom.tolist() == pytest.approx([(q - mu) / sd for q in v])


def test_all_needs_its_seasons(spark):
    rows = [(f"{s}{y}{i}", "g", s, y, float(y % 7 + i), 1.0 + i) for s in ("Spring", "Fall") for y in range(2000, 2006) for i in range(3) if not (s == "Fall" and y == 2003)]
    p = spark.createDataFrame(rows, "tow string, grp string, season string, year int, obs double, model double")
    both = A.seasonal_anomalies(p, min_seasons=2).where("season = 'All'")
    assert both.count() == 5 and A.seasonal_anomalies(p).where("season = 'All'").count() == 6


def test_zero_replacement_is_repeatable(spark):
    from tidewright.operators.survey import replace_zeros

    d = spark.createDataFrame([(i, "g" if i < 8 else "allzero", 0.0 if i % 2 else float(i + 2)) for i in range(8)] + [(9, "allzero", 0.0)], "id int, k string, v double")
    a = {r.id: r.v for r in replace_zeros(d, ["k"], "v", ["id"]).collect()}
    b = {r.id: r.v for r in replace_zeros(d.repartition(7), ["k"], "v", ["id"]).collect()}
    assert a == b and a[9] == 0.0 and all(0 < a[i] < 1.0 for i in range(1, 8, 2)) and len({a[i] for i in range(1, 8, 2)}) == 4


def test_strict_log_raises(spark):
    d = spark.createDataFrame([(-1.0,)], "v double")
    assert d.select(C.log_offset(F.col("v")).alias("x")).first().x is None
    with pytest.raises(Exception, match="non-positive"):
        d.select(C.log_offset(F.col("v"), strict=True)).collect()


def test_row_sums(spark):
    d = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    r = d.select(C.row_sum(["a", "b"]).alias("x"), C.row_sum(["a", "b"], 1).alias("y")).collect()
    assert [tuple(x) for x in r] == [(1.0, 1.0), (0.0, None)]


def test_hot_key_is_spread_over_tasks(spark):
    """With half of the rows on one key and no broadcast, the salted join keeps them in many partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        d = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("double").alias("v"))
        r = J.with_group_stats(d, ["k"], m=F.avg("v")).withColumn("p", F.spark_partition_id())
        hot = r.where("k = 'hot'").groupBy("p").count().collect()
        assert sum(x["count"] for x in hot) == 10_000 and len(hot) >= 6 and max(x["count"] for x in hot) < 5_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_quantile_ranges_stay_small(spark):
    """The rows ranked for a hot group are a small part of it."""
    d = spark.range(50_000).select(F.lit("hot").alias("k"), F.sqrt(F.col("id")).alias("v"))
    vals = Q.grouped_quantiles(d, ["k"], "v", {"m": 0.5})
    assert vals.first().m == pytest.approx((math.sqrt(24_999) + math.sqrt(25_000)) / 2)
    cuts = d.agg(F.percentile_approx("v", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(1280)).alias("c")).first().c
    sizes = np.histogram(np.sqrt(np.arange(50_000)), bins=[-1, *cuts, 1e9])[0]
    assert sizes.max() < 50_000 / 64 * 3


def test_stage_counts_from_tables_and_flags(spark):
    from tidewright.operators import survey as V

    d = spark.createDataFrame([(2000, "a", 1), (2000, "a", 5), (2000, "b", 9), (2001, "c", 1), (2001, None, 9)], "year int, tow string, v int")
    a = V.stage_counts({"raw": d, "filtered": d.where("v > 4"), "matched": d.where("v > 8")}, ["year"], "tow").orderBy("year").collect()
    b = V.stage_flag_counts(d, ["year"], "tow", {"raw": F.lit(True), "filtered": F.col("v") > 4, "matched": F.col("v") > 8}).orderBy("year").collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b] == [(2000, 2, 2, 1, 1.0, 0.5, 0.5), (2001, 1, 0, 0, 0.0, None, 0.0)]


def test_radius_search_near_the_pole(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(78, 89.9) * rng.choice([-1, 1]), rng.uniform(-20, 20)) for i in range(60)] + [(60, 85.0, 10.0)]
    cells = [(i, la + rng.uniform(-0.03, 0.03), lo + rng.uniform(-1, 1)) for i, la, lo in pts[:60]] + [(60, 85.0, 10.5)]
    p, g = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(cells, "cell int, glat double, glon double")
    got = {r.id: r.cell for r in S.nearest_cell_planar(p, g, lat="lat", lon="lon", glat="glat", glon="glon", cell=["cell"], lon_scale=None, max_km=5).collect()}
    want = {}
    for i, la, lo in pts:
        near = min((math.hypot(y - la, (x - lo) * math.cos(math.radians(la))), c) for c, y, x in cells)
        want[i] = near[1] if near[0] <= 5 / 111 else None
    assert got == want and got[60] == 60
