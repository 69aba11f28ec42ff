"""SparkSession helpers.

The library never creates a session on its own inside an analysis; callers pass
one in.  ``get_spark`` is a convenience for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "ordersight",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or fetch) a session with settings suited to these jobs.

    AQE stays on: it coalesces the many small post-aggregation partitions,
    turns sort-merge joins against small aggregated sides into broadcast joins
    at runtime, and splits skewed join partitions.
    """
    master = master or os.environ.get("ORDERSIGHT_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Coalesce post-shuffle partitions to the advisory size (64 MB) rather than
        # keeping the default parallelism: fewer tiny tasks, same plans at scale.
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Remove checkpoint files (tile / running-aggregate positions) once unreferenced.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("ORDERSIGHT_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only if none exists.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is;
    a cluster session without it is an error.  Only in local mode, when it is
    unset (tests), a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get(CHECKPOINT_CONF, None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} to a folder shared by all executors (e.g. on the cluster file system)"
        )
    local_dir = tempfile.mkdtemp(prefix="ordersight-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()
