"""Queries that apply the mobility operators to the views, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import solar
from ..operators import daylight
from ..operators import graph as gr
from ..operators import mobility as m
from ..operators.boxes import box_join
from ..sources.views import STAYS_SQL, stays

_X = "CAST(floor(radians(lon) * 6378137.0E0 / 250.0E0) AS BIGINT)"
_Y = "CAST(floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0E0 / 250.0E0) AS BIGINT)"
_POINTS = (
    STAYS_SQL
    + ", points AS (SELECT *, CAST(floor(timestamp / 60) * 60 AS BIGINT) AS minute_ts, concat('square:250:', " + _X + ", ':', " + _Y + ") AS cell_key"
    + " FROM (SELECT *, unnest(range(start_time, end_time, 60)) AS timestamp FROM stays)), keyed AS (SELECT *, concat(minute_ts, '|', cell_key) AS task_id FROM points)"
    + ", tasks AS (SELECT task_id, minute_ts, cell_key, count(*) AS point_count, count(DISTINCT file_relpath) AS file_count, min(lon) AS west, min(lat) AS south,"
    + " max(lon) AS east, max(lat) AS north FROM keyed GROUP BY ALL)"
)
_TRACK = STAYS_SQL + ", track AS (SELECT *, start_time AS timestamp FROM stays)"
_W = "OVER (PARTITION BY ad_id ORDER BY timestamp, row_index)"


def _points(spark, d):
    return m.task_points(stays(spark, d))


def _runs(spark, d):
    return m.task_runs(stays(spark, d))


def tasks_of(runs):
    """Tasks by minute, with their text keys, of runs of minutes."""
    return m.named(m.minutes_of_runs(runs))


def _tasks(spark, d):
    return tasks_of(_runs(spark, d))


def _track(spark, d):
    return stays(spark, d).withColumn("timestamp", F.col("start_time"))


_ORDER = ("ad_id", ["timestamp", "row_index"])
_BOX = (-74.01, 40.69, -73.95, 40.73)


def _lit_spans(spark, d):
    return daylight.lit_spans(m.with_cell(stays(spark, d)).select("row_index", "cell_x", "cell_y", "start_time", "end_time", "lon", "lat"))


def partitions(spark):
    return m.partition_grid(spark, *_BOX, 12)


def _partitioned(spark, d):
    return tasks_of(box_join(_runs(spark, d), partitions(spark)))


QUERIES = {
    "gen_expand_stay": lambda s, d: m.expand_stays(stays(s, d)).select("row_index", "ad_id", "timestamp"),
    "gen_daylight_filter": lambda s, d: _lit_spans(s, d).groupBy("row_index").agg(F.sum("n").alias("n"), F.min("start_ts").alias("first")),
    "agg_task_stats": _tasks,
    "agg_membership_count": lambda s, d: tasks_of(m.file_runs(stays(s, d))).select("task_id", "file_relpath", "point_count"),
    "agg_hourly": lambda s, d: m.hourly_runs(_runs(s, d)),
    "agg_files": lambda s, d: gr.run_files(m.file_runs(stays(s, d))),
    "agg_global_metrics": lambda s, d: gr.run_metrics(_runs(s, d)),
    "map_meta_kv": lambda s, d: gr.meta_pairs(gr.run_metrics(_runs(s, d)).withColumn("source", F.lit('a "shard"'))),
    "agg_percentile": lambda s, d: gr.percentiles(_runs(s, d), "point_count", weight=F.col("to_min") - F.col("from_min")),
    "srt_topk_tasks": lambda s, d: m.top_tasks(_tasks(s, d), 50).select("task_id", "point_count"),
    "win_duration": lambda s, d: m.durations(_track(s, d), *_ORDER).select("row_index", "duration_s"),
    "win_speed_jump": lambda s, d: m.speed_jumps(_track(s, d), *_ORDER, max_gap=86400, max_kmh=0.5).select("row_index", F.round("speed_kmh", 6).alias("speed_kmh"), "jump"),
    "win_gap_segments": lambda s, d: m.gap_segments(_track(s, d), *_ORDER, max_gap=86400).select("row_index", "segment"),
    "win_span_rle": lambda s, d: _lit_spans(s, d).select("row_index", "start_ts", "end_ts", "n"),
    "join_span_task": lambda s, d: m.span_minutes(_lit_spans(s, d), _runs(s, d)).groupBy("row_index").agg(F.sum(F.col("last_min") - F.col("first_min") + 1).alias("n_tasks"), (F.min("first_min") * 60).alias("first_minute")),
    "join_task_partition": lambda s, d: tasks_of(box_join(gr.padded(_runs(s, d), 100.0), partitions(s))).select("task_id", "partition_id", "minute_ts", "cell_key", "point_count", "file_count", "min_lon", "min_lat", "max_lon", "max_lat"),
    "agg_partition_fanout": lambda s, d: gr.partition_fanout(_partitioned(s, d)).withColumn("avg_points_per_task", F.round("avg_points_per_task", 9)),
    "agg_task_fanout": lambda s, d: gr.task_fanout(_partitioned(s, d)),
    "flt_quality_flags": lambda s, d: m.quality_flags(stays(s, d)),
    "set_coord_dedupe": lambda s, d: gr.coord_keys(stays(s, d)),
    "join_existing_keys": lambda s, d: gr.without_keys(stays(s, d), stays(s, d).where("row_index % 3 = 0"), ["row_index"]).select("row_index", "ad_id"),
}

_SPANS = f"""{_POINTS}, lit AS (SELECT row_index, cell_key, timestamp, timestamp - 60 * row_number() OVER (PARTITION BY row_index ORDER BY timestamp) AS run
  FROM keyed WHERE {solar.altitude()} > 0),
spans AS (SELECT row_index, cell_key, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n FROM lit GROUP BY row_index, cell_key, run)"""
_GRID = """grid AS (SELECT concat('p_', i, '_', j) AS partition_id, -74.01E0 + i * ((-73.95E0 + 74.01E0) / 12) AS min_lon, 40.69E0 + j * ((40.73E0 - 40.69E0) / 12) AS min_lat,
  -74.01E0 + (i + 1) * ((-73.95E0 + 74.01E0) / 12) AS max_lon, 40.69E0 + (j + 1) * ((40.73E0 - 40.69E0) / 12) AS max_lat FROM range(12) a(i), range(12) b(j)),
edges AS (SELECT task_id, partition_id FROM tasks JOIN grid ON west <= max_lon AND east >= min_lon AND south <= max_lat AND north >= min_lat)"""
_DURATION = f"track2 AS (SELECT *, CASE WHEN gap IS NULL OR gap <= 0 THEN 60 ELSE least(gap, 300) END AS duration_s FROM (SELECT *, lead(timestamp) {_W} - timestamp AS gap FROM track))"
_SPEED = "2 * 6371000.0E0 * asin(sqrt(least(1.0E0, pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) / dt * 3.6E0"


SQL = {
    "gen_expand_stay": f"WITH {_POINTS} SELECT row_index, ad_id, timestamp FROM keyed",
    "agg_task_stats": f"WITH {_POINTS} SELECT * FROM tasks",
    "agg_membership_count": f"WITH {_POINTS} SELECT task_id, file_relpath, count(*) AS point_count FROM keyed GROUP BY ALL",
    "gen_daylight_filter": f"WITH {_POINTS} SELECT row_index, count(*) AS n, min(timestamp) AS first FROM points WHERE {solar.altitude()} > 0 GROUP BY 1",
    "agg_hourly": f"""WITH {_POINTS}, n AS (SELECT *, (west + east) / 2 AS lon, (south + north) / 2 AS lat FROM tasks) SELECT strftime(to_timestamp(minute_ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS minute_date, hour(to_timestamp(minute_ts) AT TIME ZONE 'UTC') AS minute_hour,
      count(*) AS task_count, CAST(sum(point_count) AS BIGINT) AS point_count, CAST(sum(file_count) AS BIGINT) AS file_count, round(avg(point_count), 9) AS avg_points_per_task, round(avg(file_count), 9) AS avg_files_per_task,
      max(file_count) AS max_files, count(*) FILTER (NOT {solar.altitude('minute_ts')} > 0) AS night_task_count FROM n GROUP BY ALL""",
    "agg_files": f"WITH {_POINTS} SELECT file_relpath, count(DISTINCT task_id) AS tasks, count(*) AS points FROM keyed GROUP BY ALL",
    "agg_global_metrics": f"""WITH {_POINTS} SELECT count(*) AS tasks, count(DISTINCT cell_key) AS cells, count(DISTINCT minute_ts) AS minutes, CAST(sum(point_count) AS BIGINT) AS points, max(point_count) AS largest,
      round(avg(point_count), 9) AS avg_points, round(avg(file_count), 9) AS avg_files, max(file_count) AS max_files FROM tasks""",
    "map_meta_kv": f"""WITH {_POINTS}, m AS (SELECT count(*) AS tasks, count(DISTINCT cell_key) AS cells, count(DISTINCT minute_ts) AS minutes, CAST(sum(point_count) AS BIGINT) AS points, max(point_count) AS largest,
      round(avg(point_count), 9) AS avg_points, round(avg(file_count), 9) AS avg_files, max(file_count) AS max_files, 'a "shard"' AS source FROM tasks)
      SELECT unnest(['tasks', 'cells', 'minutes', 'points', 'largest', 'avg_points', 'avg_files', 'max_files', 'source']) AS key,
      unnest([to_json(tasks), to_json(cells), to_json(minutes), to_json(points), to_json(largest), to_json(avg_points), to_json(avg_files), to_json(max_files), to_json(source)])::VARCHAR AS value FROM m""",
    "agg_percentile": f"WITH {_POINTS} SELECT " + ", ".join(f"round(quantile_cont(CAST(point_count AS DOUBLE), {p}), 6) AS p{int(100 * p)}" for p in (0.5, 0.9, 0.95)) + " FROM tasks",
    "srt_topk_tasks": f"WITH {_POINTS} SELECT task_id, point_count FROM tasks ORDER BY point_count DESC, task_id LIMIT 50",
    "win_duration": f"WITH {_TRACK}, {_DURATION} SELECT row_index, duration_s FROM track2",
    "win_speed_jump": f"""WITH {_TRACK}, l AS (SELECT *, timestamp - lag(timestamp) {_W} AS dt, lag(lon) {_W} AS lo, lag(lat) {_W} AS la FROM track),
      v AS (SELECT row_index, CASE WHEN dt > 0 AND dt <= 86400 THEN {_SPEED} END AS v FROM l) SELECT row_index, round(v, 6) AS speed_kmh, coalesce(v > 0.5, false) AS jump FROM v""",
    "win_gap_segments": f"""WITH {_TRACK}, l AS (SELECT *, timestamp - lag(timestamp) {_W} AS dt FROM track)
      SELECT row_index, CAST(sum(CASE WHEN dt IS NULL OR dt <= 0 OR dt > 86400 THEN 1 ELSE 0 END) {_W} AS BIGINT) AS segment FROM l""",
    "win_span_rle": f"WITH {_SPANS} SELECT row_index, start_ts, end_ts, n FROM spans",
    "join_span_task": f"""WITH {_SPANS} SELECT row_index, count(*) AS n_tasks, min(minute_ts) AS first_minute FROM spans JOIN tasks
      ON spans.cell_key = tasks.cell_key AND minute_ts BETWEEN start_ts AND end_ts GROUP BY row_index""",
    "join_task_partition": f"""WITH {_POINTS}, {_GRID}, p AS (SELECT *, 100.0E0 / 111320 AS a, CASE WHEN abs(cos(radians((south + north) / 2))) < 1e-6 THEN 180.0 ELSE 100.0E0 / 111320 / abs(cos(radians((south + north) / 2))) END AS o FROM tasks)
      SELECT task_id, partition_id, minute_ts, cell_key, point_count, file_count, min_lon, min_lat, max_lon, max_lat FROM p JOIN grid ON west - o <= max_lon AND east + o >= min_lon AND south - a <= max_lat AND north + a >= min_lat""",
    "agg_partition_fanout": f"WITH {_POINTS}, {_GRID} SELECT partition_id, count(*) AS task_count, CAST(sum(point_count) AS BIGINT) AS point_count, round(avg(point_count), 9) AS avg_points_per_task FROM edges JOIN tasks USING (task_id) GROUP BY ALL",
    "agg_task_fanout": f"WITH {_POINTS}, {_GRID} SELECT task_id, min(minute_ts) AS minute_ts, min(cell_key) AS cell_key, max(point_count) AS point_count, max(file_count) AS file_count, count(*) AS partition_count FROM edges JOIN tasks USING (task_id) GROUP BY ALL",
    "flt_quality_flags": f"""WITH {STAYS_SQL} SELECT count(*) AS n, count(*) FILTER (ad_id IS NULL) AS no_id, count(*) FILTER (end_time < start_time) AS reversed,
      count(*) FILTER (NOT lat BETWEEN -90 AND 90 OR NOT lon BETWEEN -180 AND 180) AS outside, count(*) FILTER (end_time - start_time > 3600) AS over_hour FROM stays""",
    "set_coord_dedupe": f"WITH {STAYS_SQL} SELECT DISTINCT CAST(round_even(lon * 1e5, 0) AS BIGINT) AS x, CAST(round_even(lat * 1e5, 0) AS BIGINT) AS y FROM stays",
    "join_existing_keys": f"WITH {STAYS_SQL} SELECT row_index, ad_id FROM stays WHERE row_index % 3 <> 0",
}
