"""Spark session set-up shared by tests, the bench and the entry points.

On a cluster the session already exists and names a shared checkpoint folder
in ``spark.checkpoint.dir``; we only read it, and without one nothing is
written.  A private folder is created only where the setting is missing and
driver and executors are one process (``local[...]``: tests and the bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "codetrail") -> SparkSession:
    master = master or os.environ.get("CODETRAIL_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder; one is made only in local mode, elsewhere an unset one is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="codetrail-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def join_by_measured_size(spark: SparkSession) -> None:
    """Let adaptive execution alone choose broadcast joins, by the measured size of a shuffled side.

    Without it Spark goes by the size of Parquet files before a join runs.  Intermediate tables here shrink to a small part
    of their rows' size on disk, so a table of hundreds of megabytes would pass for one under the threshold and be
    collected on the driver.  The session's threshold stays the limit; explicit broadcasts aren't touched.
    """
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not limit.startswith("-"):
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
