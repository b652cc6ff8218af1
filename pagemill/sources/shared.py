"""The folder that the driver and all executors share, and tables that are cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, on one machine (tests), a temporary folder."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if held.isEmpty():
        if not path and context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="pagemill-"))
        held = context._jsc.sc().getCheckpointDir()
    return path or held.get()


def scratch(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def stored(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder."""
    path = scratch(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def saved(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()
