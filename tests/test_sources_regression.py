"""Text grids, tables, stores and least squares."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import taxa as TX
from tidewright.operators import regression as R
from tidewright.session import cut_lineage
from tidewright.sources import grids as G
from tidewright.sources import outputs as U
from tidewright.sources import tables as TB

HEAD = "ncols 3\nnrows 2\nxllcorner -125.0\nyllcorner 48.0\ncellsize 0.5\nNODATA_value -9999"


def test_asc_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, rows in {"temp_1999_002.asc": "1 2.5 0\n-9999 5 6", "temp__2000_363.asc": "7 8 9\n1 1 1", "sal_2001_00122.asc": "1 1 1\n2 2 2"}.items():
        (tmp_path / "in" / name).write_text(f"{HEAD}\n{rows}\n")
    cells = G.with_step(G.read_asc(spark, str(tmp_path / "in")))
    got = {(r["var"], r.year, r.step, r.row, r.col): r.value for r in cells.collect()}
    assert len(got) == 18 and got[("temp", 1999, 1, 1, 2)] == 2.5 and got[("temp", 2000, 120, 1, 3)] == 9 and got[("sal", 2001, 2, 2, 1)] == 2
    grid = spark.createDataFrame([(r, c, 48.0 + r, -125.0 + c) for r in (1, 2) for c in (1, 2, 3)], "row int, col int, lat double, lon double")
    cube = G.build_cube(cells, grid, corner=(2, 2))
    assert cube.where("value IS NULL").count() == 1 + 3
    G.write_cube(cube.drop("file"), str(tmp_path / "cube"))
    back = G.read_cube(spark, str(tmp_path / "cube"), variables=["temp"], years=(1999, 1999), steps=(1, 1))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 6 and "PartitionFilters: [isnotnull" in plan and "PushedFilters: [IsNotNull(step)" in plan
    assert G.missing_steps(cells.where("var = 'temp'"), spark.createDataFrame([(1999, 1), (1999, 2), (2000, 120)], "year int, step int")).collect() == [(1999, 2)]
    G.write_asc(cells.where("var = 'temp'"), str(tmp_path / "out"), ["year"], header=HEAD, decimals=1, reverse_rows=True)
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "year=1999")).collect())
    assert text == f"{HEAD}\n-9999.0 5.0 6.0\n1.0 2.5 0.0"
    h = G.asc_header(spark.createDataFrame([("f", HEAD + "\n1 2 3\n4 5 6")], "file string, text string")).first()
    assert (h.ncols, h.nrows, h.cellsize, h.nodata_value) == (3, 2, 0.5, -9999)


def test_csv_with_preamble(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\n".join([f"note {i}" for i in range(14)]) + "\ntimestep,5,6\n1,0.5,2\n2,0.25,\n")
    d = TX.rename_series(TB.read_csv_skipping(spark, str(tmp_path / "m.csv"), "timestep int, `5` double, `6` double", 14), prefix="EWE-")
    assert [(r.timestep, r["EWE-ZC1-EUP"], r["EWE-ZC2-AMP"]) for r in d.collect()] == [(1, 0.5, 2.0), (2, 0.25, None)]


def test_relative_series(spark):
    raw = spark.createDataFrame([("", "5: A", "22: DE1-POC"), ("0", "1", "0"), ("1", "1", "0.5"), ("3.4E+38", "1", "9")], "Pane string, a string, b string")
    assert [tuple(r) for r in TB.relative_series(raw, "Pane", "DE1-POC").orderBy("step_no").collect()] == [(0, 0.0), (1, 0.5)]
    with pytest.raises(ValueError):
        TB.relative_series(raw, "Pane", "nothing like this")


def test_stage_outputs(spark, tmp_path):
    d = spark.createDataFrame([("g", 3, 0.5)], "group string, n int, r double")
    for s in ("Spring", "All"):
        U.write_stage(d.coalesce(1), str(tmp_path / "csv" / s), fmt="csv")
        part = next((tmp_path / "csv" / s).glob("part*.csv"))
        (tmp_path / f"perf_SC215_ZC_{s}.csv").write_text(part.read_text())
    r = U.read_outputs(spark, str(tmp_path / "perf_*.csv"), "group string, n int, r double", "perf")
    assert sorted((x.scenario, x["pass"], x.season, x.n) for x in r.collect()) == [("SC215", "ZC", "All", 3), ("SC215", "ZC", "Spring", 3)]
    U.write_stage(r, str(tmp_path / "store"), partition_by=["season"])
    assert spark.read.parquet(str(tmp_path / "store")).where("season = 'All'").count() == 1
    assert U.run_stages([("a", lambda x: 1), ("b", lambda x: x["a"] + 1), ("c", lambda x: 0)], {"c": False}) == {"a": 1, "b": 2}


def test_checkpoint_cuts_the_plan(spark):
    d = cut_lineage(spark.range(10).withColumn("v", F.col("id") * 2))
    assert d.count() == 10 and "Range" not in d._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    n = 400
    year = rng.integers(2000, 2006, n)
    st = rng.integers(0, 5, n)
    net = np.where(st == 3, "a", rng.choice(["a", "b", "c"], n))
    x = rng.uniform(-30, 59, n)
    night = rng.integers(0, 2, n).astype(float)
    y = 0.3 * (year - 2000) + 0.2 * st + 0.01 * x - 1e-4 * x**2 + 0.5 * night + rng.normal(0, 0.1, n)
    return year, st, net, x, night, y


def frame(spark, rows, key="g"):
    return spark.createDataFrame([(key, int(a), int(b), str(c), float(d), float(e), float(f)) for a, b, c, d, e, f in zip(*rows)],
                                 "k string, year int, station int, net string, x double, night double, y double")


def design(rows, factors=("year", "station", "net"), poly=3, night=True):
    year, st, net, x, n, _ = rows
    cols = [np.ones(len(x))]
    for f, v in (("year", year), ("station", st), ("net", net)):
        if f in factors:
            lv = sorted(set(map(str, v)))
            cols += [(v.astype(str) == q).astype(float) for q in lv[1:]]
    z = (x - x.mean()) / max(x.std(), 1.0)
    cols += [z**k for k in range(1, poly + 1)]
    if night:
        cols.append(n)
    return np.column_stack(cols)


def test_year_grids_are_written_whole(spark):
    from tidewright.plans import REGISTRY
    from tidewright.plans.base import Tables
    from tidewright.plans.calendars import year_grid

    folder = "/root/testdata/sf0.001"
    want = {(r.year, r.row + 1, r.col + 1): r.value for r in year_grid(Tables(spark, folder)).collect()}
    cells = {(r.year, r.row, r.col): r.value for r in REGISTRY["asc_parse"].run(spark, folder).collect()}
    assert set(want) <= set(cells) and len(cells) == 700 and cells == pytest.approx({k: want.get(k, -9999) for k in cells})
    assert {(r.ncols, r.nrows) for r in REGISTRY["asc_headers"].run(spark, folder).collect()} == {(10, 10)}
    cube = {(r.year, r.row, r.col): (r.lat, r.value) for r in REGISTRY["grid_cube"].run(spark, folder).collect()}
    assert set(cube) == set(cells) and all(v == (pytest.approx(48 + (k[1] - 1) / 100), pytest.approx(want.get(k))) for k, v in cube.items())


def test_fixed_effects_match_plain_least_squares(spark, rows):
    t = R.Terms(factors=("year", "station", "net"), numeric=("night",), poly=(("x", 3),))
    got = {r.year: r["index"] for r in R.year_index(frame(spark, rows), ["k"], "y", models=[t]).collect()}
    b, *_ = np.linalg.lstsq(design(rows), rows[5], rcond=None)
    e = np.r_[0.0, b[1:6]]
    assert [got[y] for y in range(2000, 2006)] == pytest.approx(list(e - e.mean()), abs=1e-8)


def test_drop_one(spark, rows):
    full = R.Terms(factors=("year", "station", "net"), numeric=("night",), poly=(("x", 3),))
    got = {r.dropped: (r.full_r2, r.unique_r2) for r in R.drop_one_r2(frame(spark, rows), ["k"], "y", full).collect()}

    def r2(x):
        b, *_ = np.linalg.lstsq(x, rows[5], rcond=None)
        return 1 - (rows[5] - x @ b).var() / rows[5].var()

    f = r2(design(rows))
    want = {"year": r2(design(rows, ("station", "net"))), "station": r2(design(rows, ("year", "net"))), "net": r2(design(rows, ("year", "station"))),
            "night": r2(design(rows, night=False)), "x": r2(design(rows, poly=0))}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (pytest.approx(f, abs=1e-9), pytest.approx(f - v, abs=1e-9))


def test_rank_deficient_design_gets_minimum_norm(spark, rows):
    d = frame(spark, rows).withColumn("copy", F.col("night"))
    t = R.Terms(factors=("year",), numeric=("copy", "night"))
    r = {x.term: x for x in R.fit_terms(d, [], "y", [t]).where("level = ''").collect()}
    assert r["copy"].effect == pytest.approx(r["night"].effect) and r["(1)"].rank == r["(1)"].n_terms - 1


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_absorbed_factor_matches_the_dense_fit(spark, rows, keys):
    d = frame(spark, rows)
    t = R.Terms(factors=("year", "station", "net"), numeric=("night",), poly=(("x", 3),))
    want = {r.level: r for r in R.factor_effects(R.fit_terms(d, keys, "y", [t]), keys, "station").collect()}
    got = {r.level: r for r in R.absorbed_effects(d, keys, "y", t, "station").collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert (got[k].effect, got[k].r2, got[k].n) == (pytest.approx(r.effect, abs=1e-8), pytest.approx(r.r2), r.n)


def test_absorbed_factor_of_many_levels(spark):
    """More levels than the former limit of 4,000 terms."""
    d = spark.range(20_000).selectExpr("id div 4 AS station", "id % 4 AS year", "(id div 4) % 7 + 2.0D * (id % 4) AS y")
    got = {int(r.level): r.effect for r in R.absorbed_effects(d, [], "y", R.Terms(factors=("station", "year")), "station").collect()}
    mean = np.mean([i % 7 for i in range(5000)])
    assert len(got) == 5000 and all(got[i] == pytest.approx(i % 7 - mean, abs=1e-8) for i in got)


def test_term_limit_is_checked(spark, rows):
    with pytest.raises(Exception, match="more than 3"):
        R.fit_terms(frame(spark, rows), ["k"], "y", [R.Terms(factors=("year",))], max_terms=3).collect()


def test_poly_residuals_both_ways(spark, rows):
    year, *_, x, _, y = rows
    d = frame(spark, rows).withColumn("tow", F.monotonically_increasing_id())
    p = R.poly_residuals(d, ["k"], "x", ["y"]).toPandas()
    want = y - np.polyval(np.polyfit(x, y, 3), x)
    assert sorted(p.y_res) == pytest.approx(sorted(want), abs=1e-9)
    yr = R.yearly_residuals(d, ["k"], "x", ["y"], centre=F.lit(15), scale=45.0).orderBy("year").toPandas()
    assert yr.y_res.tolist() == pytest.approx([want[year == q].mean() for q in range(2000, 2006)], abs=1e-9)


def test_thermal_curve_is_recovered(spark):
    def f(t):
        return 3.0 * np.exp(-(0.05 if t <= 12 else 0.02) * (t - 12) ** 2)

    d = spark.createDataFrame([("g", s, t + 0.5, float(f(t + 0.5)) + (0.2 if s == "deep" and t % 2 else 0.0)) for s in ("top", "deep") for t in range(4, 22)],
                              "k string, s string, temp double, response double")
    r = {x.s: x for x in R.flag_best(R.thermal_curve_grid(d, ["k", "s"]), ["k"]).collect()}
    assert r["top"].best and not r["deep"].best and r["top"].n == 18
    assert (r["top"].topt, r["top"].c) == (pytest.approx(12, abs=0.2), pytest.approx(3, abs=0.05))
    assert r["top"].rmse < 0.02


def test_degree_bins_are_right_closed(spark):
    d = spark.createDataFrame([("g", t, v) for t, v in ((1.2, 1.0), (2.0, 2.0), (1.5, 9.0), (2.1, 5.0))], "k string, t double, v double")
    r = R.degree_bins(d, ["k"], "t", "v").collect()
    assert len(r) == 1 and (r[0].bin, r[0].response, r[0].n) == (1, 2.0, 3)


def test_taxon_rules(spark):
    d = spark.createDataFrame([("Chordata", "Appendicularia", "-", "-"), ("Chordata", "Ascidiacea", "-", "-"), ("Cnidaria", "Hydrozoa", "-", "Aequoreidae"), ("Cnidaria", "Hydrozoa", "-", None),
                               ("-", "-", "Calanoida", "Calanidae"), ("-", "-", "Calanoida", "Metridinidae"), ("-", "-", "Poecilostomatoida", "Corycaeidae"), (None, None, None, None)],
                              "phylum string, class string, order string, family string")
    c = {k: F.col(k) for k in d.columns}
    r = d.select(TX.group_of(TX.RULES_2025, c).alias("a"), TX.group_of(TX.RULES_EARLIER, c).alias("b")).collect()
    assert [x.a for x in r] == ["ZS4-LAR", "ZF1-ICT", "ZS1-JEL", "misc", "ZC4-CLG", "ZC5-CSM", "ZC4-CLG", "misc"]
    assert [x.b for x in r][1] == "ZF1-ICH" and r[6].b == "misc"


def test_cube_store_prunes_folders_and_columns(spark, tmp_path):
    rows = [(v, y, s, r, c, float(y + s)) for v in ("a", "b") for y in (2000, 2001, 2002) for s in (1, 40, 120) for r in (1, 2) for c in (1, 2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one task anyway
    try:
        G.write_cube(spark.createDataFrame(rows, "var string, year int, step int, row int, col int, v double"), str(tmp_path / "c"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    c = G.read_cube(spark, str(tmp_path / "c"), variables=["a"], years=(2001, 2001), steps=(30, 60)).groupBy("year").agg(F.sum("v").alias("v"))
    plan = c._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*var#\d+[^\]]*year#\d+", plan) and "GreaterThanOrEqual(step,30)" in plan and "LessThanOrEqual(step,60)" in plan
    assert "ReadSchema: struct<step:int,v:double>" in plan
    assert [tuple(r) for r in c.collect()] == [(2001, 4 * 2041.0)]
    assert len(list((tmp_path / "c" / "var=a" / "year=2001").glob("*.parquet"))) > 1  # a year is not one task's work


def test_preamble_over_many_splits(spark, tmp_path):
    """Files longer than a split, and a preamble that ends in a later split, empty lines and a file that is only preamble."""
    for name, n in (("a", 3000), ("b", 10), ("c", 0)):
        lines = [f"note {i} " + "x" * 30 for i in range(14)] + ["k,v"] + [f"{i},{i}.5" for i in range(n)]
        (tmp_path / f"{name}.csv").write_text("\n\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("200b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            d = TB.read_csv_skipping(spark, str(tmp_path / "*.csv"), "k int, v double", 14)
            assert split != "200b" or d.rdd.getNumPartitions() >= 3
            got = {r.f[-5]: (r.n, r.lo, r.v) for r in d.groupBy(F.col("file").alias("f")).agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.sum("v").alias("v")).collect()}
            assert got == {"a": (3000, 0, 3000 * 2999 / 2 + 1500), "b": (10, 0, 50.0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_first_offset_wins(spark):
    names = ["v_2001_001", "v_2001_003", "v_2001_004", "v_2001_006", "v__2001_006", "v_2001_363", "v_2001_361", "v_2000_363", "v_2000_359", "v_2002_359", "x"]
    files = spark.createDataFrame([(f"/d/{n}.asc",) for n in names], "file string")
    got = {(r.year, r.step): (r.offset, r.file[3:-4]) for r in G.resolve_files(G.calendar_of(spark.createDataFrame([(2000,), (2002,)], "year int")), files).collect()}
    # Centres 2 and 5 of 2001: +1 beats -1, then +1 by the single underscore; the last steps end at 360 and 361 (leap year).
    assert got == {(2001, 1): (1, "v_2001_003"), (2001, 2): (1, "v_2001_006"), (2001, 120): (1, "v_2001_361"), (2001, 3): (-2, "v_2001_006"),
                   (2000, 120): (2, "v_2000_363"), (2002, 120): (-1, "v_2002_359")}


def test_stage_tables_come_back_with_their_types(spark, tmp_path):
    d = spark.createDataFrame([("a", None, 1, 2000), (None, 2.5, 2, 2001)], "g string, v double, n long, year int")
    for fmt in ("csv", "parquet"):
        U.write_stage(d, str(tmp_path / fmt), fmt=fmt, partition_by=["year"])
        back = U.read_stage(spark, str(tmp_path / fmt), "g string, v double, n long, year int", fmt=fmt)
        assert dict(back.dtypes) == {"g": "string", "v": "double", "n": "bigint", "year": "int"}
        assert sorted(map(str, back.select(d.columns).collect())) == sorted(map(str, d.collect()))


def test_corrected_year_index_equals_plain_least_squares(spark):
    """Both methods against numpy, with an uneven design, an empty factor level and rows without a response."""
    rng = np.random.default_rng(4)
    rows = [(g, int(y), str(rng.choice(["", "a", "b"])), float(rng.uniform(0, 90)), float(rng.normal())) for g in "pq" for y in rng.integers(2000, 2006, 60)]
    d = spark.createDataFrame(rows + [("p", 2001, "a", 5.0, None)], "g string, year int, net string, dos double, y double")
    sets = [R.Terms(name="none"), R.Terms(factors=("net",), name="net"), R.Terms(poly=(("dos", 1),), name="line"), R.Terms(poly=(("dos", 3),), name="cubic")]
    got = {(r.g, r.correction, r.method, int(r.year)): (r["index"], r.n) for r in R.corrected_year_index(d, ["g"], "y", corrections=sets).collect()}
    for g in "pq":
        own = [r for r in rows if r[0] == g]
        year, net, x, y = (np.array([r[i] for r in own]) for i in (1, 2, 3, 4))
        t, one = (x - x.mean()) / x.std(), np.ones(len(own))
        season = {"none": [], "net": [net == n for n in sorted(set(net))[1:]], "line": [t], "cubic": [t, t**2, t**3]}
        years = sorted(set(year))
        for name, columns in season.items():
            alone = np.column_stack([one, *columns]).astype(float)
            left = y - alone @ np.linalg.lstsq(alone, y, rcond=None)[0]
            both = np.column_stack([one, *[year == k for k in years[1:]], *columns]).astype(float)
            e = np.r_[0, np.linalg.lstsq(both, y, rcond=None)[0][1 : len(years)]]
            m = np.array([left[year == k].mean() for k in years])
            for method, want in (("residual-then-average", m - m.mean()), ("joint", e - e.mean())):
                for k, v in zip(years, want):
                    assert got[g, name, method, k] == (pytest.approx(v, abs=1e-9), int((year == k).sum()))
    assert len(got) == 2 * 4 * 2 * 6


def test_a_missing_column_is_an_error_unless_allowed(spark):
    from tidewright.operators import survey as S

    d = spark.createDataFrame([(1,)], "tow int")
    assert S.eligible_tows(d, mode="if_present").count() == S.eligible_tows(d, mode="none").count() == S.without_stations(d, ["a"], if_present=True).count() == 1
    for call in (lambda: S.eligible_tows(d), lambda: S.eligible_tows(d, mode="all"), lambda: S.without_stations(d, ["a"])):
        with pytest.raises(ValueError):
            call()


def test_flux_factor_of_each_row(spark):
    from tidewright.operators import nutrient as N

    d = spark.createDataFrame([("monthly", "5"), ("monthly", "13"), ("seasonal", "Spring"), ("seasonal", "5"), ("none", "5"), ("monthly", None)], "kind string, key string")
    assert [r[0] for r in d.select(N.flux_multiplier(F.col("kind"), F.col("key"))).collect()] == [0.65, 1.0, 0.8, 1.0, 1.0, 1.0]
