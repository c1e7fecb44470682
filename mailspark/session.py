"""SparkSession helpers.

Library code never creates a session on its own: every operator receives the
caller's session through the DataFrames it is given.  ``local_session`` is for
tests, the bench and examples only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Shared defaults for runs on one machine; a cluster brings its own.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # bodies can be up to 500 KB: keep Arrow batches small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.driver.memory": "16g",
}


def local_session(cores: int | str = "*", app: str = "mailspark", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session.  Only a session on one
    machine (a local master) may go without: it gets a fresh scratch folder.
    On a cluster a folder of the driver is no shared folder, so that fails.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
    if cur:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(cur)
        return cur
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    path = tempfile.mkdtemp(prefix="mailspark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint_dir(spark: SparkSession, sub: str) -> str:
    """A sub-folder of the shared checkpoint folder (streaming checkpoints, staged tables)."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + sub
