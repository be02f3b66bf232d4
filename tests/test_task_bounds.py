"""What keeps the work of one task, and what is shuffled, from growing with the tables; the results stay those of the plain ways."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import quantiles as Q
from tidewright.operators import regression as R
from tidewright.operators import survey as S
from tidewright.plans import REGISTRY
from tidewright.plans.base import Tables, stage
from tidewright.plans.matching import day_median
from tidewright.session import bound_tasks, prepare

ADVISED, STORED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def settings(spark):
    old = {k: spark.conf.get(k) for k in (ADVISED, STORED)}
    yield spark.conf
    for k, v in old.items():
        spark.conf.set(k, v)


def test_tasks_are_bounded(spark, settings):
    settings.set(ADVISED, "64MB")
    settings.set(STORED, "134217728b")
    bound_tasks(spark)
    assert (settings.get(ADVISED), settings.get(STORED)) == (str(16 << 20), str(32 << 20))
    settings.set(ADVISED, "8m")
    settings.set(STORED, "1024")
    bound_tasks(spark)
    assert (settings.get(ADVISED), settings.get(STORED)) == ("8m", "1024")


@pytest.mark.parametrize("name", ["all_years_mean", "presence_only_mean", "asof_skill"])
def test_bound_queries_are_bounded(spark, settings, name):
    settings.set(ADVISED, "64MB")
    REGISTRY[name].run(spark, "/root/testdata/sf0.001")
    spark.catalog.clearCache()
    assert settings.get(ADVISED) == str(16 << 20)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tow_table_groups_once(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 4.0), (2, "c", 8.0), (3, None, 16.0), (4, "b", None)], "tow int, grp string, v double")
    got = S.tow_table(d, ["tow"], "grp", "v", ["a", "b"])
    assert plan(got).count("Aggregate") == 1
    assert {r.tow: (r.a, r.b) for r in got.collect()} == {1: (3.0, 4.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_seasonal_dist_groups_tows_once(spark):
    assert plan(REGISTRY["seasonal_dist"].run(spark, "/root/testdata/sf0.001")).count("Aggregate") == 2


def design_rows(spark, n=600):
    rng = random.Random(5)
    rows = [("k" if i % 3 else None, 2000 + i % 4, f"n{rng.randrange(3)}", rng.choice([0.0, 1.0, None] if i % 50 == 0 else [0.0, 1.0]), float(rng.randrange(-30, 330)),
             rng.gauss(2, 1) if i % 40 else None, rng.gauss(5, 2)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, year int, net string, night double, dos double, a double, b double")


def test_fits_from_design_sums_are_those_of_the_rows(spark):
    d = design_rows(spark)
    d = d.unionByName(d.withColumns({"a": F.col("a") + 1, "b": F.col("b") * 2}))
    models = [R.Terms(factors=("year", "net"), numeric=("night",), poly=(("dos", 3),), name="all"), R.Terms(factors=("year",), name="years")]
    sums = R.design_sums(d, ["k"], ["a", "b"], models)
    assert sums.count() < d.count()
    for y in ("a", "b"):
        one, two = ({(r.k, r.model, r.term, r.level): r for r in R.fit_terms(x, ["k"], y, models).collect()} for x in (d, sums))
        assert set(one) == set(two) and len(one) > 20
        for key, r in one.items():
            assert (r.n, r.n_terms, r["rank"]) == (two[key].n, two[key].n_terms, two[key]["rank"])
            assert two[key].effect == pytest.approx(r.effect, rel=1e-6, abs=1e-8) and two[key].r2 == pytest.approx(r.r2, rel=1e-8)


@pytest.mark.parametrize("name", ["control_sweep", "correction_sweep"])
def test_sweeps_join_once(spark, name):
    text = plan(REGISTRY[name].run(spark, "/root/testdata/sf0.001"))
    spark.catalog.clearCache()
    # Every join but those of the small tables of effects lies in the one cached table that both responses read.
    assert "lineitem" not in text or "InMemoryRelation" in text
    assert "parquet" not in text.replace("InMemoryRelation", "\nInMemoryRelation").split("InMemoryRelation")[0]


def test_quantiles_of_few_groups(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(400)] + [0.0, -0.0, 7.0] * 30 + [float("inf"), -float("inf"), None, None]
    d = spark.createDataFrame([(rng.choice(["a", "b", None]), v) for v in values] + [("c", None), ("d", 4.0), ("e", float("nan"))], "g string, v double")
    probs = {"low": 0.05, "mid": 0.5, "high": 0.9}
    one, two = (Q.grouped_quantiles(d, ["g"], "v", probs, few_groups=few) for few in (False, True))
    a, b = ({r.g: tuple(map(str, r[1:])) for r in x.collect()} for x in (one, two))
    assert a == b and set(a) == {"a", "b", None, "d", "e"}
    text = two._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in text


PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.mark.parametrize("name", ["all_years_mean", "presence_only_mean", "asof_skill"])
def test_shuffles_are_dealt_by_the_size_of_the_tables(spark, settings, name):
    """Adaptive execution never cuts a part that is merely large, so the session's few would each grow with the tables."""
    folder, few = "/root/testdata/sf0.001", int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings.set(ADVISED, "4k")
    try:
        df = REGISTRY[name].run(spark, folder)
        parts = int(spark.conf.get(PARTS, None) or few)
        stored = sum(os.path.getsize(f"{folder}/{t}.parquet") for t in ("lineitem", "orders"))
        assert parts > few and parts * 4096 >= 4 * stored
        assert f", {parts})" in df._jdf.queryExecution().executedPlan().toString()
        # What the cluster sets higher is kept.
        settings.set(PARTS, str(parts + 1))
        REGISTRY[name].run(spark, folder)
        assert settings.get(PARTS) == str(parts + 1)
    finally:
        spark.conf.unset(PARTS)
        spark.catalog.clearCache()


def test_all_years_mean_reads_the_rows_once(spark):
    text = plan(REGISTRY["all_years_mean"].run(spark, "/root/testdata/sf0.001"))
    spark.catalog.clearCache()
    # Both the sums and the span of years come from the cached yearly means.
    assert text.count("InMemoryRelation") == 2
    assert "parquet" not in text.replace("InMemoryRelation", "\nInMemoryRelation").split("InMemoryRelation")[0]


def test_presence_only_mean_reads_the_rows_once(spark):
    text = plan(REGISTRY["presence_only_mean"].run(spark, "/root/testdata/sf0.001"))
    assert text.count("Relation [l_orderkey") == 1


def test_presence_only_mean_on_odd_records(spark):
    rng = random.Random(8)
    rows = [(rng.choice([2000, 2001, None]), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, 3, None]), rng.choice([0.5, 2.25, None])) for _ in range(200)]
    rows += [(2005, "a", "x", None, None), (2005, "a", "x", 7, None), (2005, "b", "x", 7, 4.0), (2005, "b", "x", 8, 4.0)]
    d = spark.createDataFrame(rows, "year int, genus string, stage string, tow int, raw double")
    tows, sums = {}, {}
    for year, genus, stage, tow, raw in rows:
        tows.setdefault(year, set()).update([] if tow is None else [tow])
        sums.setdefault((year, genus), {}).setdefault(stage, []).extend([] if raw is None else [raw])
    want = {}
    for (year, genus), by_stage in sums.items():
        means = [sum(v) / len(tows[year]) for v in by_stage.values() if v]
        want[year, genus] = (len(tows[year]), sum(means) if means else None)
    got = S.presence_only_mean(d, period=["year"], taxon=["genus"], size_class="stage", tow="tow", value="raw").collect()
    assert len(got) == len(want) > 8
    for r in got:
        n, mean = want[r.year, r.genus]
        assert r.n_surveys == n and (r.mean_value is mean is None or r.mean_value == pytest.approx(mean, abs=0.02))


def test_day_median_shuffles_counts_only(spark):
    text = plan(day_median(Tables(spark, "/root/testdata/sf0.001")))
    # Rows are joined with a broadcast of the few ranges that hold a rank, never grouped whole by their values.
    assert "broadcast" in text and "Aggregate [date#" in text
    assert not [line for line in text.splitlines() if "Aggregate [" in line and "__v#" in line.split("]")[0] and "__b2#" not in line.split("]")[0]]


def test_kept_tables_have_no_empty_parts(spark):
    """Every use of a small kept table runs a task for each of its parts."""
    prepare(spark)
    spark.conf.set(PARTS, "60")
    try:
        d = stage(spark.range(100).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s")))
        assert d.count() == 10 and d.rdd.getNumPartitions() < 10
    finally:
        spark.conf.unset(PARTS)
        spark.catalog.clearCache()
