"""Session settings and the few helpers that touch cluster state."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "causalspark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for (AQE, skew joins, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All event arithmetic is done on UTC microseconds."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(tempfile.gettempdir(), "causalspark-checkpoints")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never forces a long recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, so that two applications never meet."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    The reader then has file statistics (for broadcast decisions and pruning) and no lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}"
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
