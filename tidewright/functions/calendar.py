"""Model calendars, bins and seasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS_PER_YEAR = 120
STEP_DAYS = 3

# Month number -> season name, by naming scheme.
SEASON_SCHEMES: dict[str, dict[int, str]] = {
    "djf": {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
            6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall"},
    "nov_feb": {11: "Winter", 12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring",
                5: "Spring", 6: "Summer", 7: "Summer", 8: "Summer"},
    "quarters": {1: "Winter", 2: "Winter", 3: "Winter", 4: "Spring", 5: "Spring", 6: "Spring",
                 7: "Summer", 8: "Summer", 9: "Summer", 10: "Fall", 11: "Fall", 12: "Fall"},
    "nov_winter": {11: "Winter", 12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring",
                   5: "Spring", 6: "Summer", 7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall"},
    "single_month": {1: "Winter", 4: "Spring", 7: "Summer", 10: "Fall"},
}
SEASON_ORDER = ["Winter", "Spring", "Summer", "Fall"]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with or without time zone."""
    return F.unix_micros(ts.cast("timestamp"))


def days(d: Column) -> Column:
    """Days since the epoch."""
    return F.unix_date(d.cast("date"))


def model_step(date: Column, last_step: int = STEPS_PER_YEAR) -> Column:
    """3-day step of the year; everything past the last full block is pooled into ``last_step``."""
    return F.least(F.floor((F.dayofyear(date) - 1) / STEP_DAYS) + 1, F.lit(last_step)).cast("int")


def pool_tail_doy(doy: Column, last_step: int = STEPS_PER_YEAR) -> Column:
    """Step of a file's day-of-year key; late or shifted year-end keys fall on the last step."""
    return F.least(F.floor((doy - 1) / STEP_DAYS) + 1, F.lit(last_step)).cast("int")


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def step_centre_doy(year: Column, step: Column) -> Column:
    """Day of year at the block centre: 2, 5, ... 356, then 360 (361 in leap years)."""
    return F.when(step < STEPS_PER_YEAR, step * STEP_DAYS - 1).otherwise(
        F.when(is_leap(year), F.lit(361)).otherwise(F.lit(360))
    )


def step_date(year: Column, step: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (step_centre_doy(year, step) - 1).cast("int"))


def series_step_date(timestep: Column, first_year: int) -> Column:
    """Date of a running step of the 1-D model (step 120 is day 359, unlike the grid calendar)."""
    year = F.lit(first_year) + F.floor((timestep - 1) / STEPS_PER_YEAR)
    offset = ((timestep - 1) % STEPS_PER_YEAR) * STEP_DAYS + STEP_DAYS // 2
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), offset.cast("int"))


def block_label(date: Column) -> Column:
    """'YYYY-BBB' label of the 3-day block, without pooling (up to 122 blocks)."""
    block = (F.floor((F.dayofyear(date) - 1) / STEP_DAYS) + 1).cast("int")
    return F.concat(F.date_format(date, "yyyy"), F.lit("-"), F.lpad(block.cast("string"), 3, "0"))


def biweek(date: Column, cap: int | None = None) -> Column:
    b = (F.floor((F.dayofyear(date) - 1) / 14) + 1).cast("int")
    return b if cap is None else F.least(b, F.lit(cap))


def week8(date: Column) -> Column:
    """0-based 8-day week, 46 per year."""
    return F.least(F.floor((F.dayofyear(date) - 1) / 8), F.lit(45)).cast("int")


def season_of_month(month: Column, scheme: str = "djf") -> Column:
    """Season name of a month number; months outside the scheme give NULL."""
    names = SEASON_SCHEMES[scheme]
    out: Column | None = None
    for season in SEASON_ORDER:
        months = [m for m, s in names.items() if s == season]
        if months:
            out = F.when(month.isin(months), season) if out is None else out.when(month.isin(months), season)
    return out


def season(date: Column, scheme: str = "djf") -> Column:
    if scheme == "mid_month":
        md = F.month(date) * 100 + F.dayofmonth(date)
        return (
            F.when((md >= 1116) | (md <= 301), "Winter")
            .when(md <= 531, "Spring")
            .when(md <= 915, "Summer")
            .otherwise("Fall")
        )
    return season_of_month(F.month(date), scheme)


def season_of_biweek(b: Column) -> Column:
    """Season of the bin's middle day in a non-leap year."""
    mid = F.least((b - 1) * 14 + 8, F.lit(365))
    return season(F.date_add(F.lit("2001-01-01").cast("date"), (mid - 1).cast("int")))


def infer_season(season_name: Column, date: Column, model_time: Column, b: Column) -> Column:
    """First available of: given season, season of date, season of model time, season of bin."""
    return F.coalesce(F.initcap(F.trim(season_name)), season(date), season(model_time), season_of_biweek(b))


def day_of_season(date: Column) -> Column:
    """Day of year with December moved before January, so that winter is continuous."""
    doy = F.dayofyear(date)
    return F.when(F.month(date) == 12, doy - 365).otherwise(doy)


def winter_year(date: Column) -> Column:
    """Year with December counted to the following winter."""
    return F.year(date) + F.when(F.month(date) == 12, 1).otherwise(0)


def week_block(week: Column, kind: str = "month") -> Column:
    """Month (1..12) or half-month (1..24) that holds the middle day of a 0-based 8-day week."""
    mid = F.date_add(F.lit("2001-01-01").cast("date"), (week * 8 + 4).cast("int"))
    mid = F.least(mid, F.lit("2001-12-31").cast("date"))
    if kind == "month":
        return F.month(mid)
    return (F.month(mid) - 1) * 2 + F.when(F.dayofmonth(mid) <= 15, 1).otherwise(2)


def calendar_table(spark: SparkSession, first_year: int, last_year: int, last_month: int = 12) -> DataFrame:
    """One row per model step: year, step, time_index, doy, date. Size is years x 120."""
    n = (last_year - first_year + 1) * STEPS_PER_YEAR
    cal = spark.range(n).select(
        (F.lit(first_year) + F.floor(F.col("id") / STEPS_PER_YEAR)).cast("int").alias("year"),
        (F.col("id") % STEPS_PER_YEAR + 1).cast("int").alias("step"),
        F.col("id").alias("time_index"),
    )
    cal = cal.withColumn("doy", step_centre_doy(F.col("year"), F.col("step"))).withColumn(
        "date", step_date(F.col("year"), F.col("step"))
    )
    return cal.where((F.col("year") < last_year) | (F.month("date") <= last_month))


def nearest_step(date: Column) -> Column:
    """struct(date, year, step, gap): calendar step nearest to a day, the earlier one on a tie.

    On the complete regular calendar this replaces an as-of join by an equality join.
    """
    y, s = F.year(date), model_step(date)

    def candidate(year: Column, step: Column) -> Column:
        d = step_date(year, step)
        return F.struct(F.abs(F.datediff(d, date)).alias("gap"), d.alias("date"), year.alias("year"), step.alias("step"))

    before = candidate(F.when(s > 1, y).otherwise(y - 1), F.when(s > 1, s - 1).otherwise(F.lit(STEPS_PER_YEAR)))
    after = candidate(F.when(s < STEPS_PER_YEAR, y).otherwise(y + 1), F.when(s < STEPS_PER_YEAR, s + 1).otherwise(F.lit(1)))
    return F.when(date.isNotNull(), F.array_min(F.array(before, candidate(y, s), after)))
