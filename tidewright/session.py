"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "tidewright", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    return prepare(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings that the operators count on, for sessions made elsewhere.

    A sort-merge join whose output feeds an aggregate on the same key is only split at a hot key when adaptive
    execution may add a shuffle for it. A kept table has as many parts as its last shuffle unless adaptive execution may put them together.
    """
    for key in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin",
                "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"):
        spark.conf.set(key, "true")
    return spark


#: Bytes of shuffled and of stored data that a task of a bound query gets at most, as far as Spark can split them.
TASK_BYTES = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20, "spark.sql.files.maxPartitionBytes": 32 << 20}


#: The parts a shuffle is dealt into before adaptive execution puts them together, and the bytes allowed for in it per stored byte.
SHUFFLE_PARTS, SHUFFLED_PER_STORED = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 4


def _conf_bytes(spark: SparkSession, key: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index((unit or "b")[0])


def bound_tasks(spark: SparkSession) -> SparkSession:
    """Runtime settings under which the memory of a task does not grow with the tables.

    Compressed rows take many times their size in sorts and hash tables, so Spark's own 64 and 128 MB let one task hold more
    than a gigabyte. Smaller settings of the cluster are kept. :func:`bound_shuffles` goes with it.
    """
    for key, most in TASK_BYTES.items():
        if _conf_bytes(spark, key) > most:
            spark.conf.set(key, str(most))
    return spark


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files under ``path``, from their listing."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def bound_shuffles(spark: SparkSession, stored: int) -> None:
    """Deal shuffles into enough parts for tables of ``stored`` bytes.

    Adaptive execution puts parts together up to the advised size but cuts only skewed ones, so with a fixed number of parts each
    grows with the tables. More parts of the cluster's own are kept.
    """
    parts = -(-SHUFFLED_PER_STORED * stored // _conf_bytes(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    if parts > int(spark.conf.get(SHUFFLE_PARTS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(SHUFFLE_PARTS, str(parts))


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach: the one the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only when the cluster names none, which is the case in local tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for one table of files in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder, see :func:`shared_folder`, and continue from there."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
