"""Session construction and the shared scratch location.

Lineage is cut with ``DataFrame.checkpoint()`` (reliable, written to the
cluster's ``spark.checkpoint.dir``) or with tables written under the same
shared folder.  The folder is read from the session; only when it is unset
(local tests) a private temporary folder is chosen.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the reference scores in 4,096-row batches; Arrow batches follow suit
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.shuffle.partitions": "8",
}


def get_spark(master: str | None = None, app: str = "flowlens", **conf) -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[8]")
    settings = dict(DEFAULT_CONF)
    settings.setdefault("spark.driver.memory", "16g")
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, choosing a private one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # unset: local runs and tests only
        configured = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_dir(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A folder on the shared checkpoint filesystem for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = "/".join([base, "flowlens", *parts])
    if unique:
        path = f"{path}/{uuid.uuid4().hex}"
    return path

