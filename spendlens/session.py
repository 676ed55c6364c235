"""Session helpers: local test sessions and the folder all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Bytes of rows that a Python worker is given at a time; Spark's own bound is 64 MB, on both sides of the pipe.
BATCH_BYTES = 4 << 20


def local_session(cpus: int | str = 8, app: str = "spendlens") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cluster_settings(total_cores: int) -> dict[str, str]:
    """Settings for large panels, to be given to the session builder or spark-submit.

    Shuffles start with three partitions per core and adaptive execution merges small
    ones up to 256 MB, so sorts and windows fit a task; partitions above that are split
    in skewed joins. Scans are cut into 256 MB pieces.
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(3 * total_cores),
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.sql.session.timeZone": "UTC",
    }


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, readable by every executor.

    Where the setting is missing, a temporary folder is used in local mode only: on
    a cluster a machine-local folder would lose data with its machine.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spendlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    return f"{shared_root(spark).rstrip('/')}/spendlens/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Python workers get ``BATCH_BYTES`` at a time, or what it has been set to.

    A row larger than that still comes whole. For jobs that send whole texts through many operators:
    executors keep the memory that their largest batches took.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def free_shuffles(spark: SparkSession) -> None:
    """Lets go of the shuffle files that no plan can read any more.

    Spark removes them when the driver's JVM collects its garbage; a job that shuffles the corpus several times would
    hold them all until then. The counts are there because Spark holds on to the plans of the last few executions.
    """
    gc.collect()
    for _ in range(4):
        spark.range(1).count()
    spark.sparkContext._jvm.System.gc()
