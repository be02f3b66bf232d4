"""Calendars, event timing and windows on small hand-made cases."""

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewright.functions import calendar as cal
from tidewright.operators import grid as GR
from tidewright.operators import joins as J
from tidewright.operators import onset as O

D = dt.date


def test_calendar_table(spark):
    c = {(r.year, r.step): r for r in cal.calendar_table(spark, 1999, 2001).collect()}
    assert len(c) == 360 and c[(1999, 1)].date == D(1999, 1, 2) and c[(1999, 119)].doy == 356
    assert (c[(1999, 120)].doy, c[(2000, 120)].doy, c[(2001, 120)].doy) == (360, 361, 360)
    assert c[(2000, 120)].date == D(2000, 12, 26) and c[(2000, 3)].time_index == 122
    assert cal.calendar_table(spark, 1999, 2000, last_month=6).where("year = 2000").agg(F.max("date")).first()[0] <= D(2000, 6, 30)


def test_series_dates(spark):
    r = spark.createDataFrame([(1,), (120,), (121,)], "t int").select(cal.series_step_date(F.col("t"), 1978).alias("d")).collect()
    assert [x.d for x in r] == [D(1978, 1, 2), D(1978, 12, 25), D(1979, 1, 2)]
    assert r[1].d.timetuple().tm_yday == 359


def test_bins_and_seasons(spark):
    d = spark.createDataFrame([(D(2000, 12, 31),), (D(2001, 12, 31),), (D(2001, 3, 1),), (D(2001, 11, 16),), (D(2001, 9, 15),), (D(2001, 9, 16),)], "d date")
    c = F.col("d")
    r = d.select(cal.biweek(c).alias("b"), cal.biweek(c, 26).alias("bc"), cal.week8(c).alias("w"), cal.model_step(c).alias("s"), cal.block_label(c).alias("l"),
                 cal.season(c).alias("djf"), cal.season(c, "mid_month").alias("mid"), cal.season(c, "nov_feb").alias("nf"), cal.day_of_season(c).alias("dos"),
                 cal.winter_year(c).alias("wy")).collect()
    assert (r[0].b, r[0].bc, r[0].w, r[0].s, r[0].l) == (27, 26, 45, 120, "2000-122")
    assert (r[0].dos, r[1].dos, r[0].wy) == (1, 0, 2001)
    assert [x.mid for x in r] == ["Winter", "Winter", "Winter", "Winter", "Summer", "Fall"]
    assert r[4].nf is None and r[4].djf == "Fall"


def test_season_of_biweek(spark):
    r = spark.range(1, 28).select(cal.season_of_biweek(F.col("id")).alias("s")).collect()
    assert [x.s for x in r][:1] == ["Winter"] and r[5].s == "Spring" and r[26].s == "Winter"


def series(spark, values, year=2001, step=3):
    start = D(year, 1, 2)
    rows = [(year, start + dt.timedelta(days=step * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "year int, date date, v double")


def test_onset_persistence_rules(spark):
    # Threshold is 1.05 x median = 10.5, persistence level 7.35.
    one_spike = [10, 10, 20, 1, 1, 1, 1, 10, 10, 10, 10]
    assert O.threshold_onset(series(spark, one_spike), [], value="v").first().onset_date is None
    # The two steps after the next two are high: the first rule passes, two of the next four as well.
    later = [10, 10, 20, 1, 1, 9, 9, 10, 10, 10, 10]
    assert O.threshold_onset(series(spark, later), [], value="v").first().onset_date == D(2001, 1, 8)
    assert O.threshold_onset(series(spark, later), [], value="v", rule="two_of_four").first().onset_date == D(2001, 1, 8)
    # One high and one low follower average above the level, but only one of four reaches it.
    mean_only = [10, 10, 20, 15, 1, 1, 1, 10, 10, 10, 10]
    assert O.threshold_onset(series(spark, mean_only), [], value="v").first().onset_date == D(2001, 1, 8)
    assert O.threshold_onset(series(spark, mean_only), [], value="v", rule="two_of_four").first().onset_date is None


def test_onset_at_year_end(spark):
    tail = [10] * 9 + [20, 20, 20]
    a = O.threshold_onset(series(spark, tail), [], value="v").first()
    assert a.onset_date == series(spark, tail).collect()[9].date
    assert O.threshold_onset(series(spark, tail), [], value="v", rule="two_of_four").first().onset_date is None
    assert O.threshold_onset(series(spark, [10] * 10 + [20, 20]), [], value="v").first().onset_date is None


def test_trailing_window_is_left_open(spark):
    d = spark.createDataFrame([(1, D(2001, 1, 1), 100.0), (1, D(2001, 1, 6), 2.0), (1, D(2001, 1, 7), 4.0)], "k int, date date, v double")
    r = {x.date: x.smooth for x in O.trailing_mean(d, ["k"], value="v").collect()}
    assert r[D(2001, 1, 6)] == 51.0 and r[D(2001, 1, 7)] == 3.0
    t = d.withColumn("ts", F.col("date").cast("timestamp"))
    assert {x.date: x.smooth for x in O.trailing_mean_time(t, ["k"], value="v", ts="ts").collect()} == r


def test_percent_of_max(spark):
    assert O.percent_of_max_onset(series(spark, [-1, -2, -3]), [], value="v").first().onset_date is None
    r = O.percent_of_max_onset(series(spark, [1, 2, 10, 10, 1]), [], value="v").first()
    assert r.onset_date == D(2001, 1, 11)


def test_weekly_onset_uses_available_weeks(spark):
    v = [10, 10, 10, 10, 20, None, 1, 19, 10, 10]
    d = spark.createDataFrame([(2001, i, None if x is None else float(x)) for i, x in enumerate(v)], "year int, week int, v double")
    assert O.weekly_onset(d, [], value="v").first().onset_week == 4
    few = d.where("week < 4")
    assert O.weekly_onset(few, [], value="v").first().onset_week is None


def test_labels(spark):
    d = spark.createDataFrame([(x,) for x in (66, 68, 69, 75, 107, 110, None)], "doy int")
    c = F.col("doy")
    r = d.select(O.labels_by_bounds(c).alias("m"), O.labels_by_bounds(c, scheme="margin_wide").alias("w"), O.labels_by_bounds(c, scheme="plain").alias("p")).collect()
    assert [x.m for x in r] == ["early", "cusp", "cusp", "avg", "cusp", "late", None]
    assert [x.w for x in r][2] == "avg" and [x.p for x in r] == ["early", "early", "avg", "avg", "avg", "late", "na"]


def test_complete_axis(spark):
    d = spark.createDataFrame([("a", 1, 5)], "k string, m int, n int")
    r = {(x.k, x.m): x.n for x in J.complete_axis(d, ["k"], {"m": [1, 2, 3]}, {"n": 0}).collect()}
    assert r == {("a", 1): 5, ("a", 2): 0, ("a", 3): 0}


def test_two_of_three_days(spark):
    d = spark.createDataFrame([(D(2001, 1, i), float(i)) for i in range(1, 7)] + [(D(2001, 12, 29 + i), 50.0 + i) for i in range(3)], "date date, v double")
    two = {r.step: r.v for r in GR.daily_blocks(d, [], "date", "v", days_used=2).collect()}
    three = {r.step: r.v for r in GR.daily_blocks(d, [], "date", "v").collect()}
    assert two == {1: 1.5, 2: 4.5, 120: 51.0} and three == {1: 2.0, 2: 5.0, 120: 51.0}


def test_padded_mean(spark):
    from tidewright.operators import forcing as FR

    d = spark.createDataFrame([(1, i, None if v is None else float(v)) for i, v in enumerate([1, 2, None, 4, 9])], "c int, t int, v double")
    r = [x.v for x in FR.centred_mean_padded(d, ["c"], ["t"], "v", half=1).orderBy("t").collect()]
    assert r == pytest.approx([4 / 3, 1.5, 3.0, 6.5, 22 / 3])


def test_nearest_level(spark):
    r = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "z double").select(J.nearest_level(F.col("z"), [0.0, 2.0, 4.0]).alias("l")).collect()
    assert [x.l for x in r] == [0.0, 2.0, 4.0, None]


def test_weeks_are_blanked_by_value_not_by_row_count(spark):
    from tidewright.plans.onsets import weekly

    rows = [("A", D(1995, 1, 1), 10.0)] * 30 + [("A", D(1995, 1, 9), 20.0), ("A", D(1995, 1, 17), 0.01), ("A", D(1995, 1, 25), None)]
    items = spark.createDataFrame(rows, "l_returnflag string, l_shipdate date, l_extendedprice double")
    assert {r.week: r.v for r in weekly(SimpleNamespace(lineitem=items)).collect()} == {0: 10.0, 1: 20.0, 2: None, 3: None}
