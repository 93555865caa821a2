"""Session helpers for tests, tools and the benchmark; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(name: str = "threadloom", cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", os.environ.get("THREADLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=None)
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="threadloom-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder the cluster names in spark.checkpoint.dir.

    Executors and driver both see that folder, so what is written there survives the loss of an executor.  Where the
    setting is missing, on one machine (tests), a temporary folder is chosen once per application; the session's own
    settings are left alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def saved(df, purpose: str):
    """Write an intermediate result once and read it back: cuts the lineage and is shared by later steps."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
