"""Text tables: headers to skip, label rows, and survey files with their own column names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 0, line) of the lines that are not blank, without bringing a file together.

    Each split of a file counts its own lines; the splits before it, a few rows for each file, give the offset. So a long
    file is read by many tasks, wherever its preamble ends.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"))
    lines = lines.where(F.trim("line") != "").withColumn("__id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("file").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.select("file", "__at", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = lines.join(splits, ["file", "__at"])
    return rows.select("file", (F.col("__before") + F.col("__id") - F.col("__first")).alias("line_no"), "line")


def read_csv_skipping(spark: SparkSession, path: str, schema: T.StructType | str, skip: int) -> DataFrame:
    """CSV files whose data start after ``skip`` lines and one line of column names; blank lines do not count.

    The files are read split by split like any text, see :func:`numbered_lines`.
    """
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = numbered_lines(spark, path).where(F.col("line_no") > skip)
    return rows.select("file", F.from_csv("line", F.lit(ddl), {"mode": "PERMISSIVE"}).alias("r")).select("file", "r.*")


def parse_csv_skipping(raw: DataFrame, schema: T.StructType | str, skip: int) -> DataFrame:
    """The same for texts that hold a whole file each."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    rows = raw.select("file", F.explode(F.slice(lines, skip + 2, F.size(lines))).alias("line"))
    return rows.select("file", F.from_csv("line", F.lit(ddl), {"mode": "PERMISSIVE"}).alias("r")).select("file", "r.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Plain CSV with a header and a declared schema."""
    return spark.read.csv(path, header=True, schema=schema, nanValue="NaN", nullValue="")


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[\"']", "")


def normalise_survey(df: DataFrame, dataset: str, columns: Mapping[str, str], *, date_format: str = "yyyy-MM-dd", zmin: float = 0.1) -> DataFrame:
    """Rename to (date, lat, lon, depth, value, dataset), strip quotes, coerce, and set depth 0 to ``zmin``."""
    def num(name: str) -> Column:
        return _unquoted(F.col(f"`{columns[name]}`")).try_cast("double")

    d = df.select(
        F.to_date(F.try_to_timestamp(_unquoted(F.col(f"`{columns['date']}`")), F.lit(date_format))).alias("date"),
        num("lat").alias("lat"), num("lon").alias("lon"), num("depth").alias("depth"), num("value").alias("value"), F.lit(dataset).alias("dataset"))
    return d.withColumn("depth", F.when(F.col("depth") == 0, F.lit(float(zmin))).otherwise(F.col("depth")))


def union_surveys(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def relative_series(raw: DataFrame, step_col: str, label_contains: str, max_step: float = 1e9) -> DataFrame:
    """Step and value from a diagnostic table of strings whose first data row labels the columns.

    The column is chosen by a text found in the label row, the only row brought to the driver; label rows and
    rows with the huge sentinel step are dropped.
    """
    step = F.col(f"`{step_col}`").try_cast("double")
    label = raw.where(step.isNull()).limit(1).collect()
    if not label:
        raise ValueError("no label row")
    wanted = label_contains.lower()
    found = [c for c in raw.columns if c != step_col and wanted in f"{c} {label[0][c] or ''}".lower()]
    if not found:
        raise ValueError(f"no column labelled {label_contains!r}")
    return raw.where(step.isNotNull() & (step < max_step)).select(
        step.cast("int").alias("step_no"), F.col(f"`{found[0]}`").try_cast("double").alias("rel"))
