"""Session defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "12g", name: str = "quire") -> SparkSession:
    """A session for tests and the bench. On a cluster use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder reliable checkpoints go to, taken from the session.

    A folder of our own is set only in local mode, where the driver's disk is
    the executors' disk; anywhere else a missing setting is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


#: Bytes of a batch of rows on its way to a Python worker. Rows differ so much in length that a
#: number of rows is no bound.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on, batches for Python workers in this session are bounded by bytes too."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(BATCH_BYTES + 1)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def fix(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder, so that several readers see the same rows."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
