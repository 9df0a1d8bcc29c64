"""Operators on stays, minutes, cells and trajectories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, mercator_cell
from ..functions.text import utc
from .daylight import lit_count


def expand_stays(stays: DataFrame, step: int = 60) -> DataFrame:
    """A row for each instant of a stay, end exclusive, one at least: an end that is null or before the start is the start."""
    length = F.greatest(F.coalesce(F.col("end_time"), F.col("start_time")) - F.col("start_time"), F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(length / step)).cast("long")
    return stays.where("start_time is not null").withColumn("timestamp", F.explode(F.sequence(F.col("start_time"), F.col("start_time") + (n - 1) * step, F.lit(step).cast("long"))))


#: What identifies a task while it is counted; its text keys are made after that.
KEYS = ["minute_ts", "cell_x", "cell_y"]
CELL_M = 250


def with_cell(rows: DataFrame, cell_m: int = CELL_M) -> DataFrame:
    """rows with the square cell of lon, lat: cell_x, cell_y (null where the position is)."""
    x, y = mercator_cell(F.col("lon"), F.col("lat"), float(cell_m))
    return rows.withColumn("cell_x", x).withColumn("cell_y", y)


def cell_key(cell_m: int = CELL_M) -> Column:
    return F.concat_ws(":", F.lit("square"), F.lit(cell_m), F.col("cell_x").cast("string"), F.col("cell_y").cast("string"))


def task_points(stays: DataFrame, step: int = 60) -> DataFrame:
    """A row for each instant of each stay (see ``expand_stays``) with minute_ts and the stay's cell: the cell is worked out
    once a stay. Stays without a position have a null cell."""
    return expand_stays(with_cell(stays), step).withColumn("minute_ts", F.floor(F.col("timestamp") / 60) * 60)


def with_task(points: DataFrame) -> DataFrame:
    """points (timestamp, lon, lat) with minute_ts, cell_key and task_id as text."""
    return named(with_cell(points).withColumn("minute_ts", F.floor(F.col("timestamp") / 60) * 60))


def named(rows: DataFrame) -> DataFrame:
    """rows with KEYS as cell_key and task_id in place of the cell's numbers."""
    keyed = rows.withColumn("cell_key", cell_key()).drop("cell_x", "cell_y")
    return keyed.withColumn("task_id", F.concat_ws("|", F.col("minute_ts").cast("string"), "cell_key"))


def cells(points: DataFrame) -> DataFrame:
    """Per minute and cell (KEYS): points, different files and bounds. A null file counts for no file."""
    return points.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("point_count"), F.countDistinct("file_relpath").alias("file_count"),
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
    )


def task_stats(points: DataFrame) -> DataFrame:
    """Tasks: ``cells`` of points (see ``task_points``) with their text keys. No points give no tasks."""
    return named(cells(points))


def memberships(points: DataFrame) -> DataFrame:
    """(task_id, file_relpath, point_count) of points; a null file is a file of its own."""
    return named(points.groupBy(*KEYS, "file_relpath").agg(F.count(F.lit(1)).alias("point_count"))).select("task_id", "file_relpath", "point_count")


def hourly(tasks: DataFrame) -> DataFrame:
    """Per UTC date and hour: tasks, points, files, means, the most files of a task, and tasks at night (is_night; null: day)."""
    at = utc(F.col("minute_ts"))
    night = F.coalesce(F.col("is_night"), F.lit(0)) == 1 if "is_night" in tasks.columns else F.lit(False)
    return tasks.groupBy(F.date_format(at, "yyyy-MM-dd").alias("minute_date"), F.hour(at).cast("long").alias("minute_hour")).agg(
        F.count(F.lit(1)).alias("task_count"), F.sum("point_count").alias("point_count"), F.sum("file_count").alias("file_count"), F.round(F.avg("point_count"), 9).alias("avg_points_per_task"),
        F.round(F.avg("file_count"), 9).alias("avg_files_per_task"), F.max("file_count").alias("max_files"), F.count_if(night).alias("night_task_count"),
    )


def top_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """The ``n`` tasks of most points; ties by task_id."""
    return tasks.orderBy(F.desc("point_count"), "task_id").limit(n)


def durations(points: DataFrame, by: str, order: list[str]) -> DataFrame:
    """duration_s: seconds to the next row, clamped to 1..300; 60 where there is none or it isn't later."""
    gap = F.lead("timestamp").over(Window.partitionBy(by).orderBy(*order)) - F.col("timestamp")
    return points.withColumn("duration_s", F.when(gap.isNull() | (gap <= 0), 60).otherwise(F.least(gap, F.lit(300))).cast("long"))


def speed_jumps(points: DataFrame, by: str, order: list[str], max_gap: int = 600, max_kmh: float = 200.0) -> DataFrame:
    """speed_kmh to the row before and jump: faster than ``max_kmh`` within ``max_gap`` seconds; the later row is the jump."""
    w = Window.partitionBy(by).orderBy(*order)
    dt = F.col("timestamp") - F.lag("timestamp").over(w)
    metres = haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    speed = F.when((dt > 0) & (dt <= max_gap), metres / dt * 3.6)
    return points.withColumn("speed_kmh", speed).withColumn("jump", F.coalesce(F.col("speed_kmh") > max_kmh, F.lit(False)))


def gap_segments(points: DataFrame, by: str, order: list[str], max_gap: int = 600) -> DataFrame:
    """segment: number of the run of rows whose steps are later by ``max_gap`` seconds at most; from 1 within ``by``."""
    w = Window.partitionBy(by).orderBy(*order)
    dt = F.col("timestamp") - F.lag("timestamp").over(w)
    breaks = F.when(dt.isNull() | (dt <= 0) | (dt > max_gap), 1).otherwise(0)
    return points.withColumn("_break", breaks).withColumn("segment", F.sum("_break").over(w).cast("long")).drop("_break")


def lit_spans(stays: DataFrame, lit: Callable[[str], Column], step: int = 60) -> DataFrame:
    """Closed spans of consecutive lit instants of each stay (row_index once): ad_id, row_index, cell_x, cell_y, start_ts, end_ts,
    n. ``lit`` tells from an SQL expression of an instant whether it is lit there (lon, lat are at hand). Only the ends of spans
    are shuffled: an instant begins one if it is lit and the one before isn't, or isn't of the stay. Stays with no lit instant
    give none."""
    one = expand_stays(with_cell(stays), step)
    last = F.col("start_time") + F.greatest(F.lit(0), F.ceil(F.greatest(F.coalesce("end_time", "start_time") - F.col("start_time"), F.lit(0)) / step) - 1) * step
    before = (F.col("timestamp") == F.col("start_time")) | ~lit(f"(timestamp - {step})")
    after = (F.col("timestamp") == last) | ~lit(f"(timestamp + {step})")
    ends = one.where(lit("timestamp")).where(before | after)
    ends = ends.select("ad_id", "row_index", "cell_x", "cell_y", F.when(before, F.col("timestamp")).alias("a"), F.when(after, F.col("timestamp")).alias("b"))
    sides = ends.groupBy("row_index").agg(*(F.first(c).alias(c) for c in ("ad_id", "cell_x", "cell_y")), F.array_sort(F.collect_list("a")).alias("a"), F.array_sort(F.collect_list("b")).alias("b"))
    span = sides.select("ad_id", "row_index", "cell_x", "cell_y", F.explode(F.arrays_zip("a", "b")).alias("s"))
    return span.select("ad_id", "row_index", "cell_x", "cell_y", F.col("s.a").alias("start_ts"), F.col("s.b").alias("end_ts"), ((F.col("s.b") - F.col("s.a")) / step + 1).cast("long").alias("n"))


def file_runs(stays: DataFrame) -> DataFrame:
    """Tasks by file as runs of minutes: (cell_x, cell_y, hour, from_min, to_min, file_relpath, point_count, west .. north), of stays
    whose instants are a minute apart. Within from_min..to_min (numbers of minutes, the last not included) the same stays are in the
    cell, so that each of its minutes has this row's counts and bounds.

    A stay is cut by hours, not minutes. The starts and ends within an hour of a cell, sixty at most, are gathered by
    aggregation, and each piece takes the stretches between them that it spans: what meets in a cell and hour is summed
    before it is counted, and a crowded cell is spread over its hours. Stays without a start give none; a null cell is one."""
    first = F.floor(F.col("start_time") / 60)
    length = F.greatest(F.coalesce(F.col("end_time"), F.col("start_time")) - F.col("start_time"), F.lit(0))
    s = with_cell(stays.where("start_time is not null")).select("cell_x", "cell_y", "file_relpath", "lon", "lat", first.alias("_a"), (first + F.greatest(F.lit(1), F.ceil(length / 60))).alias("_b"))
    s = s.withColumn("hour", F.explode(F.sequence(F.floor(F.col("_a") / 60), F.floor((F.col("_b") - 1) / 60))))
    s = s.withColumn("_a", F.greatest("_a", F.col("hour") * 60)).withColumn("_b", F.least("_b", F.col("hour") * 60 + 60))
    s = s.withColumn("_cell", F.xxhash64(F.col("cell_x").isNull(), "cell_x", "cell_y", "hour"))  # one key that is never null
    keys = ["_cell", "cell_x", "cell_y", "hour"]
    marks = s.groupBy(*keys).agg(F.array_sort(F.array_union(F.collect_set("_a"), F.collect_set("_b"))).alias("_marks"))
    runs = F.transform(F.slice("_marks", 1, F.size("_marks") - 1), lambda m, i: F.struct(m.alias("a"), F.get("_marks", i + 1).alias("b")))
    marks = marks.select("_cell", *(F.col(c).alias(f"_k{c}") for c in keys[1:]), runs.alias("_runs"))
    same = F.col("_cell") == F.col("_k_cell")
    for c in keys[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    met = s.join(marks.withColumnRenamed("_cell", "_k_cell").hint("merge"), same).select(*keys, "file_relpath", "lon", "lat", F.explode(F.filter("_runs", lambda r: (r.a >= F.col("_a")) & (r.b <= F.col("_b")))).alias("r"))
    return met.groupBy(*keys, F.col("r.a").alias("from_min"), F.col("r.b").alias("to_min"), "file_relpath").agg(
        F.count(F.lit(1)).alias("point_count"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north")
    )


def task_runs(stays: DataFrame) -> DataFrame:
    """Tasks as runs of minutes: ``file_runs`` over all files, with file_count; a null file counts for no file."""
    return file_runs(stays).groupBy("_cell", "cell_x", "cell_y", "hour", "from_min", "to_min").agg(
        F.sum("point_count").alias("point_count"), F.count("file_relpath").alias("file_count"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north")
    ).drop("_cell")


def minutes_of_runs(runs: DataFrame) -> DataFrame:
    """A row for each minute of each run: minute_ts in place of hour, from_min and to_min."""
    return runs.withColumn("minute_ts", F.explode(F.sequence(F.col("from_min") * 60, (F.col("to_min") - 1) * 60, F.lit(60).cast("long")))).drop("_cell", "hour", "from_min", "to_min")


def hourly_runs(runs: DataFrame) -> DataFrame:
    """``hourly`` of tasks as runs: a minute of a task is at night if the sun is down at the middle of its bounds, or these are unknown."""
    n = F.col("to_min") - F.col("from_min")
    lit = lit_count(runs.withColumn("_n", n), F.col("from_min") * 60, n, (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2)
    sums = lit.groupBy("hour").agg(
        F.sum("_n").alias("task_count"), F.sum(F.col("_n") * F.col("point_count")).alias("point_count"), F.sum(F.col("_n") * F.col("file_count")).alias("file_count"),
        F.max("file_count").alias("max_files"), F.sum(F.col("_n") - F.col("lit")).alias("night_task_count"),
    )
    at = utc(F.col("hour") * 3600)
    mean = lambda c: F.round(F.col(c) / F.col("task_count"), 9)
    return sums.select(
        F.date_format(at, "yyyy-MM-dd").alias("minute_date"), F.hour(at).cast("long").alias("minute_hour"), "task_count", "point_count", "file_count", mean("point_count").alias("avg_points_per_task"),
        mean("file_count").alias("avg_files_per_task"), "max_files", "night_task_count",
    )


def span_minutes(spans: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """Spans (cell_x, cell_y, start_ts, end_ts, more) with the runs (see ``task_runs``) of their cell that they share minutes with: first_min,
    last_min of these and ``more`` columns of the run, by an equi-join on the cell and the hours that a span touches. Null cells meet
    nothing. Neither side is sent whole to every executor."""
    first, last = F.ceil(F.col("start_ts") / 60), F.floor(F.col("end_ts") / 60)
    s = spans.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("hour", F.explode(F.sequence(F.floor(F.col("_first") / 60), F.floor(F.col("_last") / 60))))
    met = s.join(runs.select("cell_x", "cell_y", "hour", "from_min", "to_min", *more).hint("merge"), ["cell_x", "cell_y", "hour"])
    met = met.withColumns({"first_min": F.greatest("_first", "from_min"), "last_min": F.least(F.col("_last"), F.col("to_min") - 1)})
    return met.where("first_min <= last_min").drop("_first", "_last", "hour", "from_min", "to_min")


def stay_tasks(stays: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each instant of each stay (as ``task_points``) whose task is among the runs (see ``task_runs``): row_index, minute_ts,
    point_count. A stay meets the runs of its cell hour by hour, and the minutes become rows after that."""
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.coalesce(F.col("end_time"), F.col("start_time")) - F.col("start_time"), F.lit(0)) / 60))
    first = F.floor(F.col("start_time") / 60) * 60
    spans = with_cell(stays.where("start_time is not null")).select("row_index", "cell_x", "cell_y", first.alias("start_ts"), (first + (n - 1) * 60).alias("end_ts"))
    met = span_minutes(spans, runs, "point_count")
    return met.withColumn("minute_ts", F.explode(F.sequence(F.col("first_min") * 60, F.col("last_min") * 60, F.lit(60).cast("long")))).select("row_index", "minute_ts", "point_count")


def partition_grid(spark, west: float, south: float, east: float, north: float, cells: int) -> DataFrame:
    """(partition_id, min_lon, min_lat, max_lon, max_lat): cells x cells rectangles over the box."""
    axis = spark.range(cells)
    dx, dy = (east - west) / cells, (north - south) / cells
    grid = axis.select(F.col("id").alias("i")).crossJoin(axis.select(F.col("id").alias("j")))
    return grid.select(
        F.concat_ws("_", F.lit("p"), F.col("i").cast("string"), F.col("j").cast("string")).alias("partition_id"),
        (F.lit(west) + F.col("i") * dx).alias("min_lon"), (F.lit(south) + F.col("j") * dy).alias("min_lat"),
        (F.lit(west) + (F.col("i") + 1) * dx).alias("max_lon"), (F.lit(south) + (F.col("j") + 1) * dy).alias("max_lat"),
    )


def quality_flags(stays: DataFrame) -> DataFrame:
    """One row: stays, and those without id, with an end before the start, outside the globe, and over an hour. What is null
    breaks none of the last three rules; no stays give zeros."""
    return stays.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ad_id").isNull()).alias("no_id"), F.count_if(F.col("end_time") < F.col("start_time")).alias("reversed"),
        F.count_if(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)).alias("outside"), F.count_if(F.col("end_time") - F.col("start_time") > 3600).alias("over_hour"),
    )
