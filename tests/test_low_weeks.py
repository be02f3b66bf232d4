"""Weekly onsets on tables whose weeks are low, blank or without a key: every week with a value counts, as in the reference."""

import datetime as dt
from statistics import median

import duckdb
import pytest

from tidewright.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"
UNIT = 2.0**-30  # exact in binary; it brings every price below 0.05


def tables(folder, price, flag="l_returnflag", day="l_shipdate"):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (({price})::DOUBLE AS l_extendedprice, {flag} AS l_returnflag, {day} AS l_shipdate) FROM '{FOLDER}/lineitem.parquet') "
                f"TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{FOLDER}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def low(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("low"), f"l_extendedprice * {UNIT!r}")


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Weeks of 0 and refunds, a group's year without a price, rows without a flag or a day."""
    week = "(dayofyear(l_shipdate)-1)//8"
    price = (f"CASE WHEN l_returnflag = 'N' AND year(l_shipdate) = 1997 THEN NULL WHEN {week} = 5 THEN 0 "
             f"WHEN {week} = 20 THEN -l_extendedprice ELSE l_extendedprice END")
    return tables(tmp_path_factory.mktemp("odd"), price, "CASE WHEN l_orderkey % 97 <> 0 THEN l_returnflag END", "CASE WHEN l_orderkey % 89 <> 0 THEN l_shipdate END")


def ordered(rows):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: [(v is not None, 0 if v is None else v) for v in r])


def result(spark, folder, name):
    got = ordered(REGISTRY[name].run(spark, folder).collect())
    spark.catalog.clearCache()
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    assert got == ordered(con.sql(REGISTRY[name].sql).fetchall())
    return got


def first_week(weeks, pairs):
    """Onset by plain steps over the weeks that have a value."""
    s = sorted((k, v) for k, v in weeks.items() if v is not None)
    if len(s) < 5:
        return None
    v = [x for _, x in s]
    level = 1.05 * median(v)
    for j in range(len(v) - 2):
        two = v[j + 1:j + 3]
        four = v[j + 3:j + 5]
        mean = lambda x: len(x) == 2 and sum(x) / 2 > 0.7 * level
        if v[j] >= level and ((mean(two) or mean(four)) if pairs else max(two) > 0.7 * level):
            return float(s[j][0])
    return None


def plain(folder):
    rows = duckdb.sql(f"SELECT l_returnflag, CAST(l_shipdate AS DATE), l_extendedprice FROM '{folder}/lineitem.parquet'").fetchall()
    sums = {}
    for grp, day, price in rows:
        year, week = (None, None) if day is None else (day.year, min((day - dt.date(day.year, 1, 1)).days // 8, 45))
        sums.setdefault((grp, year), {}).setdefault(week, []).append(price)
    means = {}
    for key, weeks in sums.items():
        kept = {w: [p for p in prices if p is not None] for w, prices in weeks.items()}
        means[key] = {w: sum(p) / len(p) if p else None for w, p in kept.items()}
    return ordered((*key, first_week(w, False), first_week(w, True)) for key, w in means.items())


def test_weekly_onsets_of_low_prices(spark, low):
    got = result(spark, low, "onset_weekly_gaps")
    assert got == result(spark, FOLDER, "onset_weekly_gaps") == plain(low)
    assert any(r[2] is not None for r in got)


def test_weekly_onsets_with_blank_years_and_keys(spark, odd):
    got = result(spark, odd, "onset_weekly_gaps")
    assert got == plain(odd)
    assert ("N", 1997, None, None) in got and any(r[0] is None for r in got) and any(r[1] is None for r in got)


def test_recipe_scores_of_low_prices(spark, low, odd):
    got = result(spark, low, "onset_recipe_scores")
    assert len(got) == 6 and got == result(spark, FOLDER, "onset_recipe_scores")
    result(spark, odd, "onset_recipe_scores")


def test_best_recipe_of_low_prices(spark, low, odd):
    got = result(spark, low, "onset_best_recipe")
    assert len(got) == 1 and got == result(spark, FOLDER, "onset_best_recipe")
    result(spark, odd, "onset_best_recipe")
