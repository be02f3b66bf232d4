import datetime as dt

from pyspark.sql import functions as F

from tidewright.functions import calendar as cal
from tidewright.operators import joins as J
from tidewright.streaming.blocks import match_calendar, windowed_means


def run(df, path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_means_match_the_batch_result(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 2, start + dt.timedelta(hours=5 * i), float(i)) for i in range(60)]
    d = spark.createDataFrame(rows, "k int, ts timestamp, v double")
    d.where("hour(ts) < 12").write.parquet(str(tmp_path / "in"))
    d.where("hour(ts) >= 12").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(windowed_means(stream, ["k"], "ts", "v", lateness="30 days"), tmp_path / "c", "means", "complete")
    want = d.groupBy(F.date_trunc("day", "ts").alias("start"), "k").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    key = lambda r: (r.start, r.k)
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_late_rows_close_their_window(spark, tmp_path):
    for i, day in enumerate((1, 20, 2, 40)):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(days=day), 1.0)], "ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema("ts timestamp, v double, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(windowed_means(stream, [], "ts", "v", lateness="3 days"), tmp_path / "c", "late")
    assert {r.start.day for r in got.collect()} >= {2}
    assert all(r.n == 1 for r in got.collect())


def test_calendar_match_agrees_with_the_asof_join(spark, tmp_path):
    days = spark.range(800).select(F.date_add(F.lit("1999-12-20").cast("date"), F.col("id").cast("int")).alias("date"))
    c = cal.calendar_table(spark, 1999, 2002).withColumn("v", F.col("time_index").cast("double"))
    a = J.asof_nearest(days.withColumn("t", cal.days(F.col("date"))), c.withColumn("mt", cal.days(F.col("date"))).select("mt", "v"), obs_t="t", model_t="mt", values=["v"], tolerance=3)
    want = {r.date: r.v for r in a.collect()}
    assert {r.date: r.v for r in match_calendar(days, "date", c, ["v"], 3).collect()} == want
    days.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(days.schema).parquet(str(tmp_path / "in"))
    got = run(match_calendar(stream, "date", c, ["v"], 3), tmp_path / "c", "matched")
    assert {r.date: r.v for r in got.collect()} == want
