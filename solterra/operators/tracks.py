"""Operators on the order of a device's rows: segments, groups of stays, distances, positions at an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from .mobility import durations, gap_segments, speed_jumps


def long_segments(points: DataFrame, by: str, order: list[str], max_gap: int = 600, least_s: int = 300) -> DataFrame:
    """Rows of segments that last ``least_s`` seconds at least, steps clamped to 1..300 and 60 for the last row; the
    segments that stay are numbered anew from 1 without gaps."""
    seg = gap_segments(points, by, order, max_gap)
    step = F.lead("timestamp").over(Window.partitionBy(by, "segment").orderBy(*order)) - F.col("timestamp")
    timed = seg.withColumn("_step", F.when(step.isNull(), 60).otherwise(F.greatest(F.lit(1), F.least(step, F.lit(300)))))
    kept = timed.withColumn("segment_s", F.sum("_step").over(Window.partitionBy(by, "segment"))).where(F.col("segment_s") >= least_s)
    return kept.withColumn("segment", F.dense_rank().over(Window.partitionBy(by).orderBy("segment")).cast("long")).drop("_step")


def cleaned(points: DataFrame, by: str, order: list[str], max_gap: int = 600, max_kmh: float = 200.0, least_s: int = 300) -> DataFrame:
    """points (row_index once) with reason (kept, invalid (position or time), jump_speed or short_segment), segment (of kept rows,
    from 1) and duration_s (see ``durations``)."""
    valid = F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90) & F.col("timestamp").isNotNull()
    flagged = points.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    jumped = speed_jumps(flagged.where("_valid"), by, order, max_gap, max_kmh)
    kept = long_segments(jumped.where("not jump"), by, order, max_gap, least_s).select("row_index", "segment")
    marks = jumped.select("row_index", "jump").join(kept, "row_index", "left")
    reason = F.when(F.col("jump").isNull(), "invalid").when(F.col("jump"), "jump_speed").when(F.col("segment").isNull(), "short_segment").otherwise("kept")
    return durations(points, by, order).join(marks, "row_index", "left").withColumn("reason", reason).drop("jump")


def clean(points: DataFrame, by: str, order: list[str], max_gap: int = 600, max_kmh: float = 200.0, least_s: int = 300) -> DataFrame:
    """row_index and reason of every row (see ``cleaned``)."""
    return cleaned(points, by, order, max_gap, max_kmh, least_s).select("row_index", "reason")


def stay_groups(points: DataFrame, by: str, key: str, order: list[str]) -> DataFrame:
    """Neighbouring rows of one ``key``: by, key, grp (from 1), start_ts, end_ts, n."""
    w = Window.partitionBy(by).orderBy(*order)
    new = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    grouped = points.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w).cast("long"))
    return grouped.groupBy(by, key, "grp").agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count(F.lit(1)).alias("n"))


def with_distance(points: DataFrame, by: str, order: list[str]) -> DataFrame:
    """step_m from the row before (0 for the first) and total_m so far."""
    w = Window.partitionBy(by).orderBy(*order)
    step = F.coalesce(haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("total_m", F.sum("step_m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def position_at(points: DataFrame, queries: DataFrame, by: str) -> DataFrame:
    """queries (by, at) with row_index of the first row at ``at`` or later, else of the last row: one window over both,
    read from its end, so that each frame is one pass. Of rows at one instant the least row_index counts ahead, the
    greatest behind; queries of a key without rows get null; repeated queries give one row."""
    p = points.select(by, F.col("timestamp").alias("at"), "row_index")
    q = queries.select(by, "at").distinct().withColumn("row_index", F.lit(None).cast("long"))
    so_far = lambda *order: Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.last("row_index", True).over(so_far(F.desc("at"), F.col("row_index").desc_nulls_last()))
    behind = F.last("row_index", True).over(so_far(F.asc("at"), F.col("row_index").asc_nulls_first()))
    return p.unionByName(q).withColumn("found", F.coalesce(ahead, behind)).where("row_index is null").select(by, "at", F.col("found").alias("row_index"))
