"""Session settings, shared folder and materialised tables for the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

#: Rows of a text batch that a Python worker holds at once.
BATCH_ROWS = 1000


_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Adaptive skew splitting, text batches small enough for a worker, and this package on all executors."""
    prepare(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def _ship(spark: SparkSession) -> None:
    """Hand the package's source to Spark, which sends it to every worker; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(SparkFiles.getRootDirectory()) / "ship" / f"{top.name}.zip"  # Spark's own folder of the driver, from which it serves files
    path.parent.mkdir(exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, named by ``spark.checkpoint.dir``; only a local session may lack it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    This cuts the lineage, fixes what a retried task could give in another order, and survives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{table}.parquet")


def row_key(*more: str) -> Column:
    """A hash of what a row of documents holds, which tells rows of equal doc_id apart; ``more`` names further columns."""
    return F.xxhash64("doc_id", text_or_empty(), *more)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))
