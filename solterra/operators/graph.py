"""Tasks, memberships, spans and partition edges: joins, merges and metrics of the task graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import rest
from . import scans
from .quantiles import at_ranks

PAD_DEGREE_M = 111_320.0


def padded(boxes: DataFrame, context_m: float) -> DataFrame:
    """boxes (west, south, east, north, more) widened by ``context_m``: the degree of longitude by the cosine at the middle
    latitude; 180 degrees where that is nearly 0."""
    cosine = F.abs(F.cos(F.radians((F.col("south") + F.col("north")) / 2)))
    lat = F.lit(context_m / PAD_DEGREE_M)
    lon = F.when(cosine < 1e-6, 180.0).otherwise(lat / cosine)
    return boxes.withColumn("_lon", lon).withColumns({"west": F.col("west") - F.col("_lon"), "east": F.col("east") + F.col("_lon"), "south": F.col("south") - lat, "north": F.col("north") + lat}).drop("_lon")


def with_all_partitions(edges: DataFrame, available: DataFrame) -> DataFrame:
    """(task_id, partitions): tasks of which every partition is available. Tasks without a partition aren't in edges and don't
    come; a partition listed twice as available counts once."""
    there = available.select("partition_id").distinct().withColumn("_there", F.lit(1))
    counted = edges.select("task_id", "partition_id").distinct().join(there, "partition_id", "left").groupBy("task_id").agg(F.count(F.lit(1)).alias("partitions"), F.count("_there").alias("_there"))
    return counted.where("partitions = _there").drop("_there")


def eligible(tasks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tasks with the columns of ``chosen`` (task_id once, more) that names them."""
    return tasks.join(chosen, "task_id")


def files_of(memberships: DataFrame, tasks: DataFrame) -> DataFrame:
    """Different files of the tasks."""
    return memberships.join(tasks.select("task_id").distinct(), "task_id", "left_semi").select("file_relpath").distinct()


def points_of(points: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Points, keyed like tasks, with the other columns of their task; points of no task go, null keys match none. There may be as
    many tasks as points: both are dealt out by key."""
    return points.join(tasks.hint("merge"), keys)


def minutes_of(stays: DataFrame, minutes: DataFrame, step: int = 60) -> DataFrame:
    """(row_index, minute_ts): selected minutes (cell, minute_ts) of a stay's cell that begin within it, its first minute
    included: the stay meets the minutes of its cell hour by hour, so that a busy cell is spread."""
    first = F.floor(F.col("start_time") / step) * step
    last = F.greatest(F.coalesce("end_time", "start_time"), F.col("start_time"))
    s = stays.select("row_index", "cell", first.alias("_from"), last.alias("_to"))
    s = s.withColumn("_hour", F.explode(F.sequence(F.floor(F.col("_from") / 3600), F.floor(F.col("_to") / 3600))))
    m = minutes.select("cell", "minute_ts").distinct().withColumn("_hour", F.floor(F.col("minute_ts") / 3600))
    return s.join(m, ["cell", "_hour"]).where((F.col("minute_ts") >= F.col("_from")) & ((F.col("minute_ts") < F.col("_to")) | (F.col("minute_ts") == F.col("_from")))).select("row_index", "minute_ts")


def merge_tasks(parts: DataFrame) -> DataFrame:
    """Tasks of several shards as one: counts add up, bounds widen. file_count is a sum of the shards' counts: a file that
    several shards hold counts in each."""
    return parts.groupBy("task_id", "minute_ts", "cell_key").agg(
        F.sum("point_count").alias("point_count"), F.sum("file_count").alias("file_count"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    )


def merge_spans(parts: DataFrame) -> DataFrame:
    """Spans of several shards as one: equal spans are one row whose counts add up; nulls of a key are equal."""
    keys = [c for c in parts.columns if c != "n"]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"))


def task_fanout(edges: DataFrame) -> DataFrame:
    """Per task its partitions and what it carries (minute_ts, cell_key, point_count, file_count)."""
    return edges.groupBy("task_id").agg(
        F.min("minute_ts").alias("minute_ts"), F.min("cell_key").alias("cell_key"), F.max("point_count").alias("point_count"), F.max("file_count").alias("file_count"), F.count(F.lit(1)).alias("partition_count")
    )


def partition_fanout(edges: DataFrame) -> DataFrame:
    """Per partition its tasks, their points and the mean."""
    return edges.groupBy("partition_id").agg(F.count(F.lit(1)).alias("task_count"), F.sum("point_count").alias("point_count"), F.avg("point_count").alias("avg_points_per_task"))


def edge_metrics(edges: DataFrame, n_tasks: Column | None = None) -> DataFrame:
    """One row: edges, matched tasks and partitions, mean and most partitions of a task, tasks of several partitions and their
    share of the matched, mean and most tasks of a partition. Two small aggregates feed it; no edges give zeros and nulls."""
    by_task = edges.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("matched_task_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count"), F.avg("n").alias("avg_partitions_per_task"), F.max("n").alias("max_partitions_per_task"),
        F.count_if(F.col("n") > 1).alias("multi_partition_task_count"),
    )
    by_partition = edges.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("matched_partition_count"), F.avg("n").alias("avg_tasks_per_partition"), F.max("n").alias("max_tasks_per_partition"))
    share = F.coalesce(F.col("multi_partition_task_count") / F.nullif(F.col("matched_task_count"), F.lit(0)), F.lit(0.0))
    return by_task.crossJoin(F.broadcast(by_partition)).withColumn("multi_partition_task_fraction", share)  # one row and one row


def merge_summaries(parts: DataFrame, sums: list[str], maxima: list[str], minima: list[str], by: list[str] | None = None) -> DataFrame:
    """Summaries of chunks as one: named columns add up (none: 0), take the largest, or the least that isn't null."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima] + [F.min(c).alias(c) for c in minima]
    return parts.groupBy(*(by or [])).agg(*aggs)


def profile(stays: DataFrame, step: int = 60) -> DataFrame:
    """One row about stays: rows, ids, seconds, instants after expansion, first start and last end. An end that is null or before
    the start is the start; rows without a start count as rows and ids only, empty ids as none."""
    end = F.greatest(F.coalesce("end_time", "start_time"), F.col("start_time"))
    spent = F.when(F.col("start_time").isNotNull(), end - F.col("start_time"))
    return stays.agg(
        F.count(F.lit(1)).alias("raw_rows"), F.countDistinct(F.nullif(F.trim(F.col("ad_id").cast("string")), F.lit(""))).alias("unique_users"), F.coalesce(F.sum(spent), F.lit(0)).alias("total_seconds"),
        F.coalesce(F.sum(F.greatest(F.lit(1), F.ceil(spent / step))), F.lit(0)).cast("long").alias("expanded_points"), F.min("start_time").alias("min_start"), F.max(F.when(F.col("start_time").isNotNull(), end)).alias("max_end"),
    )


def files(memberships: DataFrame) -> DataFrame:
    """Per file its tasks and points."""
    return memberships.groupBy("file_relpath").agg(F.countDistinct("task_id").alias("tasks"), F.sum("point_count").alias("points"))


def global_metrics(tasks: DataFrame) -> DataFrame:
    """One row about tasks: tasks, cells, minutes, points, means and maxima; no tasks give 0 and nulls."""
    return tasks.agg(
        F.count(F.lit(1)).alias("tasks"), F.countDistinct("cell_key").alias("cells"), F.countDistinct("minute_ts").alias("minutes"), F.sum("point_count").alias("points"), F.max("point_count").alias("largest"),
        F.round(F.avg("point_count"), 9).alias("avg_points"), F.round(F.avg("file_count"), 9).alias("avg_files"), F.max("file_count").alias("max_files"),
    )


def run_files(file_runs: DataFrame) -> DataFrame:
    """As ``files``, of tasks by file as runs of minutes: each minute is a task."""
    n = F.col("to_min") - F.col("from_min")
    return file_runs.groupBy("file_relpath").agg(F.sum(n).alias("tasks"), F.sum(n * F.col("point_count")).alias("points"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """As ``global_metrics``, of tasks as runs of minutes. The minutes of the globe are counted from the different stretches of each
    hour, the cells from themselves, the rest by weight: one small row each."""
    n = F.col("to_min") - F.col("from_min")
    total = runs.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("tasks"), F.sum(n * F.col("point_count")).alias("points"), F.max("point_count").alias("largest"), F.sum(n * F.col("file_count")).alias("_files"), F.max("file_count").alias("max_files")
    )
    cells = runs.where("cell_x is not null or cell_y is not null").select("cell_x", "cell_y").distinct().agg(F.count(F.lit(1)).alias("cells"))
    minutes = runs.select("from_min", "to_min").distinct().select(F.explode(F.sequence(F.col("from_min"), F.col("to_min") - 1)).alias("m")).distinct().agg(F.count(F.lit(1)).alias("minutes"))
    mean = lambda c: F.round(F.col(c) / F.nullif(F.col("tasks"), F.lit(0)), 9)
    one = total.crossJoin(F.broadcast(cells)).crossJoin(F.broadcast(minutes))  # a row each
    return one.select("tasks", "cells", "minutes", "points", "largest", mean("points").alias("avg_points"), mean("_files").alias("avg_files"), "max_files")


def meta_pairs(row: DataFrame) -> DataFrame:
    """(key, value) of a table of one row: a pair for each column, its value as JSON; null is ``null``."""
    encoded = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), encoded(c).alias("value")) for c in row.columns))).alias("p")).select("p.key", "p.value")


def percentiles(rows: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95), weight: Column | None = None) -> DataFrame:
    """Percentiles between neighbours, exact: p50, p90 ... Nulls count for nothing; no rows give nulls. ``weight``: how often a row
    counts. Equal values are counted first, so that one task sees different values alone."""
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    return counts.agg(*(F.round(F.percentile("v", F.lit(p), F.col("n")), 6).alias(f"p{int(100 * p)}") for p in shares))


def percentiles_at(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """Percentiles that are values of the rows: the one at place (n - 1) p, rounded half to even, in ascending order. By radix selection
    (see ``at_ranks``), so that no group's values meet. Nulls and NaN count for nothing."""
    ranks = {f"p{int(round(100 * p))}": F.bround((F.col("n") - 1) * p) for p in shares}
    kind = rows.schema[value].dataType
    return at_ranks(rows, by, value, ranks).select(*by, *(F.col(k).cast(kind).alias(k) for k in ranks))


def histogram(rows: DataFrame, value: str, bins: int, clip_max: float | None = None, drop_zero: bool = False) -> DataFrame:
    """(bin, n) of equal bins between the least and the largest value, the last with its upper edge; bin counts from 0, empty
    bins don't come. ``clip_max`` bounds values, ``drop_zero`` leaves out those at or below 0. One value alone: all in bin 0.
    Nulls and NaN count for nothing."""
    v = F.col(value).cast("double")
    kept = rows.where(v.isNotNull() & ~F.isnan(v)).select((F.least(v, F.lit(clip_max)) if clip_max else v).alias("v"))
    kept = kept.where("v > 0") if drop_zero else kept
    edge = F.broadcast(kept.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return kept.crossJoin(edge).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coord_keys(points: DataFrame) -> DataFrame:
    """Different positions as whole numbers of 1e-5 degree, half to even."""
    from .light import to_units

    return to_units(points).select("x", "y").distinct()


def without_keys(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done; a null key is never done. Keys of ``done`` may repeat."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def chunk_plan(tasks: DataFrame, order: list[str], max_tasks: int, max_points: int, by: list[str] | None = None, block: int = scans.BLOCK) -> DataFrame:
    """tasks with chunk: taken in order, a new chunk begins where one more task would pass ``max_tasks`` or, with ``max_points``
    above 0, its points would pass that; a task of more points stands alone. Chunks are numbered from 0 within ``by``. See
    ``greedy_chunks``: no group folds in one task."""
    return scans.greedy_chunks(tasks, order, max_tasks, max_points, "point_count", by, block)


def spatial_shards(files_: DataFrame, n: int, bin_deg: float = 2.0) -> DataFrame:
    """(file, lon, lat, more) with shard: bins of ``bin_deg`` in order of latitude, then longitude, filled one shard after the other
    to an equal number of files; files without a position go by turns."""
    key = lambda c: F.floor(F.col(c) / bin_deg)
    there = files_.where("lon is not null and lat is not null")
    size = F.broadcast(there.agg(F.ceil(F.count(F.lit(1)) / n).alias("_quota")))  # one row
    placed = scans.ranked(there, [key("lat"), key("lon"), "file"]).crossJoin(size).withColumn("shard", F.floor(F.col("rank") / F.col("_quota")).cast("int")).drop("rank", "_quota")
    lost = scans.ranked(files_.where("lon is null or lat is null"), ["file"]).withColumn("shard", F.pmod("rank", F.lit(n)).cast("int")).drop("rank")
    return placed.unionByName(lost)


def halves(rows: DataFrame, by: list[str], largest: Column, least: int = 1) -> DataFrame:
    """rows (by, part, lon, lat, row_index) with each part for which ``largest`` holds, a condition on its count n, cut in two at the
    middle of its longer axis: the first n // 2 rows by that axis, the other one and row_index get part * 2, the others
    part * 2 + 1. Parts whose halves would have fewer than ``least`` rows stay. Rows are ranked by range, so that no part
    meets in one task."""
    keys = [*by, "part"]
    spread = lambda c: F.max(c) - F.min(c)
    parts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (spread("lon") >= spread("lat")).alias("_east"))
    cut = parts.where(largest & (F.col("n") >= 2) & (F.floor(F.col("n") / 2) >= least))
    moved = rows.join(cut, keys)
    along, across = F.when(F.col("_east"), F.col("lon")).otherwise(F.col("lat")), F.when(F.col("_east"), F.col("lat")).otherwise(F.col("lon"))
    order = scans.ranked(moved.withColumns({"_v": along, "_w": across}), [*keys, "_v", "_w", "row_index"])
    begin = order.groupBy(*keys).agg(F.min("rank").alias("_begin"))
    second = (F.col("rank") - F.col("_begin") >= F.floor(F.col("n") / 2)).cast("long")
    done = order.join(begin, keys).withColumn("part", F.col("part") * 2 + second).select(rows.columns)
    return rows.join(cut.select(*keys), keys, "left_anti").select(rows.columns).unionByName(done)


def spatial_split(points: DataFrame, by: str, most: int, levels: int = 12, least: int = 1) -> DataFrame:
    """points (row_index, lon, lat, more) with part (long, from 1) and over: each ``by`` is cut in halves (see ``halves``) until a part
    has ``most`` points or fewer, ``levels`` times at most; over tells the points of parts that still have more, since the
    levels are used up or their halves would have fewer than ``least`` points."""
    out = points.withColumn("part", F.lit(1).cast("long"))
    for _ in range(levels):
        if out.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > most) & (F.floor(F.col("n") / 2) >= least)).isEmpty():
            break
        out = rest(halves(out, [by], F.col("n") > most, least))
    size = out.groupBy(F.col(by).alias("_by"), F.col("part").alias("_part")).agg((F.count(F.lit(1)) > most).alias("over"))
    return out.join(size, F.col(by).eqNullSafe(F.col("_by")) & (F.col("part") == F.col("_part"))).drop("_by", "_part")
