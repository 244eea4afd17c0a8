"""Session helpers: a local session for tests/bench and a checkpoint directory policy."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidepool") -> SparkSession:
    """A local session for tests and the bench. On a cluster, build the session yourself."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEPOOL_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we use it as is. Only when
    nothing is set (local tests) do we create a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            # a machine-local folder is not reachable from other executors
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's file system)")
        configured = tempfile.mkdtemp(prefix="tidepool-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_folder(spark: SparkSession, name: str = "tidepool") -> str:
    """A new folder below the checkpoint directory, which driver and executors share. The file system
    removes it when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint directory (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows of a task of an iterative learner, which holds or reads them again in every pass.
ROWS_PER_TASK = 1 << 18


def learner_tasks(spark: SparkSession, rows: int) -> int | None:
    """Tasks over which a learner's counted rows are dealt: a multiple of the cores, at most ROWS_PER_TASK rows each. None
    if the rows of one task are few: they stay where they are. (A file's splits say little: rows come by row group.)"""
    cores = spark.sparkContext.defaultParallelism
    return None if rows <= ROWS_PER_TASK else cores * -(-rows // (ROWS_PER_TASK * cores))


# Bytes of an Arrow batch of packed rows; as much is held several times over by a task and its Python worker.
PACKED_BATCH_BYTES = 4 << 20
# A packed row is a batch of rows: so few make a row group, which a reader holds whole.
PACKED_WRITES = {"parquet.block.row.count.limit": "16"}


def packed_session(spark: SparkSession) -> SparkSession:
    """A copy of the session that reads packed rows (large binary values): its Arrow batches hold few of them."""
    copy = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PACKED_BATCH_BYTES))
    return copy


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def default_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
