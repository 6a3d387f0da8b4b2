"""Session helpers: a tuned local session and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    n = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("millrace")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    importable(spark)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only in local mode (tests), where none is set. It goes with the process."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def dropped(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate rows, wherever it is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are computed once, and outlive any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_A_BATCH = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started; a cluster may also ship it with --py-files.

    Texts are long, so Arrow batches are kept smaller than Spark's default where the session says nothing.
    """
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, ROWS_A_BATCH)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        own["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
