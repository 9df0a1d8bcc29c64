"""Lineage cuts and working files in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets a folder of its own, gone at its end."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        made = tempfile.mkdtemp(prefix="spark-solterra-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local[context.applicationId] = f"file://{made}"
    return _local[context.applicationId]


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the folder that nothing has used."""
    return f"{folder(spark)}/solterra/{uuid.uuid4().hex}/{label}"


def rest(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
