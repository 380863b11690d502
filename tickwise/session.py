"""Session helpers.

Operators never depend on session settings: the driver passes its own
session (ANSI on), so every expression uses ``try_*`` forms where a bad
input must yield NULL instead of an error.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tickwise") -> SparkSession:
    """Local session for tests and the benchmark (cluster jobs get theirs from the launcher)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "1075")  # top ranks of F2 are cut before the shuffle
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TICKWISE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no per-call Python call-site capture
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it to a shared file system; only when it
    is unset on a local master (tests) do we pick a fresh local folder; on a
    cluster that would be another disk on every executor, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tickwise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
