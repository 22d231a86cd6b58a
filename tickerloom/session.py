"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tickerloom") -> SparkSession:
    """Session for tests and benchmarks; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared checkpoint location.

    The location is read from the session.  Only a local session without one
    gets a temporary folder; on a cluster that folder would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def last_key_wins(spark: SparkSession) -> None:
    """Let a JSON object with a repeated key parse with its last value, like the vendor's own readers do."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


#: Table bytes per shuffle partition and bucket at most; packed columns hold some hundred thousand rows in them.
_PARTITION_BYTES = 4 << 20


def partitions_for(spark: SparkSession, size: float) -> int:
    """The session's shuffle partitions, doubled until each has at most ``_PARTITION_BYTES`` of ``size`` table bytes."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while n * _PARTITION_BYTES < size:
        n *= 2
    return n


def scaled_partitions(spark: SparkSession) -> int:
    """Partitions that shuffles start from: what the largest table read so far needs."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or n))


def scale_partitions(df: DataFrame) -> DataFrame:
    """Let shuffles start from more partitions if the table needs them, so that no task's sort or hash table grows with it.

    Adaptive execution puts small partitions together again.
    """
    spark = df.sparkSession
    n = partitions_for(spark, float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    if n > scaled_partitions(spark):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return df


#: Packed bytes of a task's input where rows are sorted or grouped, see ``small_tasks``.
_TASK_BYTES = 8 << 20


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Scans and shuffles of the plans run inside give a task ``_TASK_BYTES`` at most where rows can be split that far.

    With the default of 128 and 64 MB of packed columns a task sorts some ten million rows, which a larger input makes it spill.
    """
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(_TASK_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a shared intermediate once to the scratch location and read it back.

    Unlike caching it survives the loss of executors, and every consumer reads
    the table instead of repeating the work behind it.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
