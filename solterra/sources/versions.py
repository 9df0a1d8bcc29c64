"""A table of rows by key that batches are merged into: buckets by key, and a manifest of which version of each bucket counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import parquet_at

#: Buckets of a table; each manifest names as many folders at most.
BUCKETS = 64


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, path: str, number: int | None = None) -> tuple[int, dict[int, int]]:
    """(number of the last batch, or of the one asked for, version of each bucket); -1 and nothing before the first."""
    store, folder = _store(spark, f"{path}/manifests")
    if not store.exists(folder):
        return -1, {}
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    known = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
    if not known or number is not None and number not in known:
        return -1, {}
    last = known[-1] if number is None else number
    text = spark.read.text(f"{path}/manifests/{last:012d}.json").first()[0]
    return last, {int(b): v for b, v in json.loads(text).items()}


def read_version(spark: SparkSession, path: str, schema, number: int | None = None) -> DataFrame:
    """The table after its last batch, or after batch ``number``: folders are never written again once a manifest names them, so that
    a reader keeps its version while batches go on. Before the first batch it is empty."""
    _, buckets = manifest(spark, path, number)
    return parquet_at(spark, [f"{path}/v={v}/bucket={b}" for b, v in sorted(buckets.items())], schema)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _put(spark: SparkSession, path: str, number: int, buckets: dict[int, int]) -> None:
    """Write the manifest beside its place and move it there in one step."""
    beside = f"{path}/manifests/{uuid.uuid4().hex}.tmp"
    store, temporary = _store(spark, beside)
    out = store.create(temporary)
    out.write(bytearray(json.dumps(buckets).encode()))
    out.close()
    if not store.rename(temporary, _store(spark, f"{path}/manifests/{number:012d}.json")[1]):
        raise OSError(f"manifest {number} of {path} could not be put in place")


def merge_batch(batch: DataFrame, path: str, keys: list[str], order: str, number: int, buckets: int = BUCKETS) -> bool:
    """Merge the rows of batch ``number`` into the table at ``path``: of rows with the same keys the one of the greatest ``order`` counts, of
    equal ones the greatest row. Only the buckets that the batch touches are read and written anew, below their own version; one rename
    of the manifest then makes them count. A batch whose manifest stands is done (False); one that broke off before is
    simply written again. Numbers must rise, as those of a stream's batches do, and ``buckets`` stay what they were."""
    spark = batch.sparkSession
    last, known = manifest(spark, path)
    if number <= last:
        return False
    touched = sorted(r[0] for r in batch.select(_bucket(keys, buckets)).distinct().collect())  # as many as there are buckets
    old = parquet_at(spark, [f"{path}/v={known[b]}/bucket={b}" for b in touched if b in known], batch.schema)
    rows = F.struct(F.col(order), F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("row"))
    newest = old.unionByName(batch).groupBy(*keys).agg(F.max(rows).alias("r")).select("r.row.*")
    placed = newest.withColumn("bucket", _bucket(keys, buckets))
    placed.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/v={number}")
    _put(spark, path, number, known | {b: number for b in touched})
    return True
