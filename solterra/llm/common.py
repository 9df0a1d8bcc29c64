"""What the operators of this subpackage share: a shared folder for working tables, typed inputs, text bytes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; for a local master without that setting, a folder of this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        made = tempfile.mkdtemp(prefix="spark-solterra-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _local_dirs[context.applicationId] = made
    return "file://" + _local_dirs[context.applicationId]


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/solterra/{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.staged_path = path
    return again


def stage_bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """As ``stage``, in as many buckets by ``column`` as shuffles have partitions: joins on it leave these rows in place."""
    spark = df.sparkSession
    name = f"solterra_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/solterra/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), column).saveAsTable(name)
    return spark.table(name)


def drop_staged(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that no other column's name can clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def as_bytes(column) -> list:
    """UTF-8 bytes of the strings in an Arrow column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
