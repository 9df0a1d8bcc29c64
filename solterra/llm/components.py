"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step over edges (hi, lo) with hi > lo."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    large = (
        both.where("other > node").join(least, "node")
        .select(F.col("other").alias("node"), F.col("least").alias("other")).where("node <> other").distinct()
    )
    least = large.groupBy("node").agg(F.min("other").alias("least"))
    small = large.join(least, "node").where("other <> least").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    return small.unionByName(least.toDF("hi", "lo")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Rows with a null end and loops are ignored; repeated edges count once; no edges give no rows. Every round is written
    to the shared folder, so that a lost executor costs one round at most.
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("hi"), F.least("a", "b").cast("long").alias("lo")).distinct(), "edges"
    )
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h"))
    before = current.select(sign.alias("s")).first()["s"]
    for _ in range(max_rounds):
        if before["n"] == 0:
            break
        after = stage(_stars(current), "edges")
        drop_staged(current)
        now = after.select(sign.alias("s")).first()["s"]
        current = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
