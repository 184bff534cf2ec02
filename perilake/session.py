"""Session settings and the durable-cut helper shared by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "perilake", master: str | None = None, shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Session with the settings the operators rely on; cluster settings stay the cluster's.

    UTC is required because dates are derived from instants. AQE sizes reducers, turns
    shuffled joins into broadcast joins when the *measured* side is small, and splits
    skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A local session without one (tests, laptops) gets a fresh temporary folder. A cluster
    session without one is an error: a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()  # already set, or taken from spark.checkpoint.dir
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    context.setCheckpointDir(configured)
    return configured


def durable(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back.

    Used where a later step must see exactly the same rows in the same ranges, and where a
    lost executor must not change an answer that was already used. A Parquet table rather than
    an RDD checkpoint: it is compressed, later steps read only the columns they need, and the
    planner knows its size.
    """
    spark = frame.sparkSession
    path = f"{run_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's durable tables; it goes with :func:`release` or when Python ends."""
    context = spark.sparkContext
    folder = f"{checkpoint_folder(spark)}/run-{context.applicationId}"
    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(release, spark)
    return folder


_OWNED: set[str] = set()


def release(spark: SparkSession) -> None:
    """Delete the durable tables of this application. Frames that read them are of no use afterwards."""
    context = spark.sparkContext
    if context._jsc is None:  # already stopped; the folder is named after the application, for its owner to clear
        return
    for folder in list(_OWNED):
        if folder.endswith(context.applicationId):
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            _OWNED.discard(folder)


def reducers(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


TASK_ROWS = 250_000  # narrow rows a task groups or sorts in memory, a few hundred megabytes


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = TASK_ROWS) -> int:
    """Number of tasks for a deal of this many rows: the session's reducers, more where a task would get over ``rows_per_task``."""
    return max(reducers(spark), -(-rows // rows_per_task))
