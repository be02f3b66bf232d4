"""Result tables: one partitioned store per stage, and the key parts of older one-file-per-table names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Store a stage table (matched, pairs, skill, anomalies, counts) as Parquet or CSV."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_stage(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet") -> DataFrame:
    """A stored stage table with its declared schema, which fixes types and order whatever the files hold; folders prune by ``partition_by``."""
    r = spark.read.schema(schema)
    return r.option("header", True).option("nullValue", "").csv(path) if fmt == "csv" else r.parquet(path)


def output_key(file: Column, prefix: str, passes: Sequence[str] = ("ZC", "ZS"),
               seasons: Sequence[str] = ("All", "Winter", "Spring", "Summer", "Fall")) -> dict[str, Column]:
    """scenario, pass and season from ``{prefix}_{scenario}_{pass}_{season}.csv``; other names give empty text."""
    pat = rf"{prefix}_(.+?)_({'|'.join(passes)})_({'|'.join(seasons)})\.csv$"
    name = F.regexp_extract(file, r"([^/]+)$", 1)
    return {k: F.regexp_extract(name, "^" + pat, i + 1) for i, k in enumerate(("scenario", "pass", "season"))}


def read_outputs(spark: SparkSession, path: str, schema: str, prefix: str, **names) -> DataFrame:
    """Stack many result files of one shape, tagged with the parts of their names."""
    df = spark.read.csv(path, header=True, schema=schema).withColumn("__f", F.col("_metadata.file_path"))
    return df.withColumns(output_key(F.col("__f"), prefix, **names)).drop("__f")


def run_stages(stages: Sequence[tuple[str, callable]], enabled: Mapping[str, bool] | None = None) -> dict[str, object]:
    """Run the switched-on steps of a pipeline in order; each gets the results so far."""
    results: dict[str, object] = {}
    for name, step in stages:
        if enabled is None or enabled.get(name, True):
            results[name] = step(results)
    return results
