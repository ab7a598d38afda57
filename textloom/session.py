"""Session settings that matter for correctness and for large shuffles."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins that attach one row per key to many rows are split at run time when one
    # key dominates; the unique side is what gets replicated.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also where the next step groups by the same key and needs one more shuffle for it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "textloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library settings; the master comes from the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply the settings to a session that somebody else has built."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder.

    Only a session on one machine may do without it, as in tests, and gets a local folder; on a
    cluster it is an error, as every executor would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getCheckpointDir()
    )
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    return os.path.join(base, f"{name}-{spark.sparkContext.applicationId}-{os.urandom(4).hex()}")
