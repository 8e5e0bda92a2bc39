"""Session settings the jobs are designed for, and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE does the run-time work: coalescing small shuffle partitions, splitting skewed join
# partitions and splitting hot partitions of the rebalanced ingest write.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Shuffles start with many partitions, so that each fits in memory at 100 TB (about 0.5 TB of narrow
# rows per latency join: 128 MB each); AQE merges them down to the data at hand.
CLUSTER_SETTINGS = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096"}


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`. On a cluster leave ``master`` unset and let submit choose it."""
    builder = SparkSession.builder.appName(app)
    settings = {**SETTINGS, **({} if master else CLUSTER_SETTINGS), **extra}
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a single machine (``local[n]``) takes a temporary folder; a cluster, whose executors
    would each write to their own disk, is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="qapulse-")
    return f"{root.rstrip('/')}/qapulse/{label}-{uuid.uuid4().hex}"
