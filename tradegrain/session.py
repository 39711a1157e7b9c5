"""Session settings this package is written for, and access to the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tradegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` entries win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A split hot key is worth one more shuffle when an aggregate follows the join.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoint files go once no DataFrame refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A private temporary folder stands in only in local mode, where driver and executors share a disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="tradegrain-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one written intermediate."""
    return os.path.join(shared_folder(spark), f"tradegrain-{label}-{uuid.uuid4().hex}")


def cut_lineage(df):
    """Write ``df`` to the shared checkpoint folder and return the stored copy."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
