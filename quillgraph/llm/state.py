"""Cutting lineage where every executor can read it again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: the session's setting, or what it was given as checkpoint folder; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    return f"{tempfile.gettempdir()}/checkpoints"


#: Bytes of one Arrow batch that goes to a Python worker, unless the session was made with another bound.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def tune(spark: SparkSession) -> None:
    """Bound the batches of long texts by bytes as well as by rows: both sides hold a few of them at a time."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder; what follows does not depend on executors' disks."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
