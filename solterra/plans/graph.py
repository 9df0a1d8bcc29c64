"""Queries on the task graph, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import mobility as m
from ..operators.boxes import box_join
from ..sources.views import STAYS_SQL, stays, view, view_sql
from .mobility import _GRID, _POINTS, _points, _runs, _tasks, partitions, tasks_of

QUERIES, SQL = {}, {}
_EDGES = f"{_POINTS}, {_GRID}"


def _edges(s, d):
    return tasks_of(box_join(_runs(s, d), partitions(s)))


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


add("join_task_tile", lambda s, d: tasks_of(box_join(gr.padded(_runs(s, d), 500.0), partitions(s))).select("task_id", F.col("partition_id").alias("tile_id")),
    f"""WITH {_EDGES}, p AS (SELECT *, 500.0E0 / 111320 AS a, CASE WHEN abs(cos(radians((south + north) / 2))) < 1e-6 THEN 180.0 ELSE 500.0E0 / 111320 / abs(cos(radians((south + north) / 2))) END AS o FROM tasks)
      SELECT task_id, partition_id AS tile_id FROM p JOIN grid ON west - o <= max_lon AND east + o >= min_lon AND south - a <= max_lat AND north + a >= min_lat""")
add("join_available_edges", lambda s, d: gr.with_all_partitions(_edges(s, d), partitions(s).where("length(partition_id) % 2 = 1")),
    f"WITH {_EDGES} SELECT task_id, count(*) AS partitions FROM edges GROUP BY 1 HAVING count(*) = count(*) FILTER (length(partition_id) % 2 = 1)")
add("join_task_eligible", lambda s, d: gr.eligible(_tasks(s, d).select("task_id", "point_count"), gr.with_all_partitions(_edges(s, d), partitions(s).where("length(partition_id) % 2 = 1"))),
    f"WITH {_EDGES}, ok AS (SELECT task_id, count(*) AS partitions FROM edges GROUP BY 1 HAVING count(*) = count(*) FILTER (length(partition_id) % 2 = 1)) SELECT task_id, point_count, partitions FROM tasks JOIN ok USING (task_id)")
add("join_task_files", lambda s, d: gr.files_of(m.memberships(_points(s, d)), m.top_tasks(_tasks(s, d), 5)), f"WITH {_POINTS} SELECT DISTINCT file_relpath FROM keyed WHERE task_id IN (SELECT task_id FROM tasks ORDER BY point_count DESC, task_id LIMIT 5)")
add("join_point_task", lambda s, d: m.stay_tasks(stays(s, d), _runs(s, d).where("point_count > 1")).select("row_index", "minute_ts", "point_count"),
    f"WITH {_POINTS} SELECT row_index, minute_ts, point_count FROM (SELECT row_index, task_id FROM keyed) JOIN tasks USING (task_id) WHERE point_count > 1")
add("join_interval_minutes", lambda s, d: gr.minutes_of(stays(s, d).withColumn("cell", F.col("ad_id") % 10), stays(s, d).where("row_index % 5 = 0").select((F.col("ad_id") % 10).alias("cell"), (F.floor(F.col("start_time") / 60) * 60).alias("minute_ts"))),
    f"""WITH {STAYS_SQL}, q AS (SELECT DISTINCT ad_id % 10 AS cell, CAST(floor(start_time / 60) * 60 AS BIGINT) AS minute_ts FROM stays WHERE row_index % 5 = 0)
      SELECT row_index, minute_ts FROM stays JOIN q ON ad_id % 10 = cell AND minute_ts >= floor(start_time / 60) * 60 AND (minute_ts < end_time OR minute_ts = floor(start_time / 60) * 60)""")
_parts = lambda s, d: m.task_stats(_points(s, d).where("row_index % 2 = 0")).unionByName(m.task_stats(_points(s, d).where("row_index % 2 = 1")))
_BOTH = "parts AS (" + " UNION ALL ".join(f"SELECT task_id, minute_ts, cell_key, count(*) AS point_count, count(DISTINCT file_relpath) AS file_count, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM keyed WHERE row_index % 2 = {k} GROUP BY ALL" for k in (0, 1)) + ")"
add("agg_task_merge", lambda s, d: gr.merge_tasks(_parts(s, d)), f"WITH {_POINTS}, {_BOTH} SELECT task_id, minute_ts, cell_key, CAST(sum(point_count) AS BIGINT) AS point_count, CAST(sum(file_count) AS BIGINT) AS file_count, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north FROM parts GROUP BY ALL")
_SPANLIKE = "SELECT file_relpath, ad_id, CAST(floor(start_time / 3600) AS BIGINT) AS hour, lon, lat, 1 AS n FROM stays"
add("agg_span_merge", lambda s, d: gr.merge_spans(stays(s, d).select("file_relpath", "ad_id", F.floor(F.col("start_time") / 3600).alias("hour"), "lon", "lat", F.lit(1).alias("n"))), f"WITH {STAYS_SQL} SELECT file_relpath, ad_id, hour, lon, lat, CAST(sum(n) AS BIGINT) AS n FROM ({_SPANLIKE}) GROUP BY ALL")
add("agg_edge_metrics", lambda s, d: gr.edge_metrics(_edges(s, d)).select("*", *()).withColumns({c: F.round(c, 9) for c in ("avg_partitions_per_task", "avg_tasks_per_partition", "multi_partition_task_fraction")}),
    f"""WITH {_EDGES}, t AS (SELECT task_id, count(*) AS n FROM edges GROUP BY 1), p AS (SELECT partition_id, count(*) AS n FROM edges GROUP BY 1),
      a AS (SELECT count(*) AS matched_task_count, CAST(sum(n) AS BIGINT) AS edge_count, round(avg(n), 9) AS avg_partitions_per_task, max(n) AS max_partitions_per_task, count(*) FILTER (n > 1) AS multi_partition_task_count FROM t),
      b AS (SELECT count(*) AS matched_partition_count, round(avg(n), 9) AS avg_tasks_per_partition, max(n) AS max_tasks_per_partition FROM p)
      SELECT *, round(multi_partition_task_count / matched_task_count, 9) AS multi_partition_task_fraction FROM a, b""")
add("agg_profile", lambda s, d: gr.profile(stays(s, d).withColumn("end_time", F.when(F.col("row_index") % 9 == 0, None).when(F.col("row_index") % 7 == 0, F.col("start_time") - 5).otherwise(F.col("end_time")))),
    f"""WITH {STAYS_SQL}, e AS (SELECT *, CASE WHEN row_index % 9 = 0 OR row_index % 7 = 0 THEN start_time ELSE end_time END AS e FROM stays) SELECT count(*) AS raw_rows, count(DISTINCT ad_id) AS unique_users, CAST(sum(e - start_time) AS BIGINT) AS total_seconds,
      CAST(sum(greatest(1, ceil((e - start_time) / 60))) AS BIGINT) AS expanded_points, min(start_time) AS min_start, max(e) AS max_end FROM e""")
add("srt_chunk_plan", lambda s, d: gr.chunk_plan(stays(s, d).groupBy("ad_id", F.floor(F.col("start_time") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("point_count")), ["hour"], 5, 8, by=["ad_id"]),
    f"""WITH RECURSIVE {STAYS_SQL}, h AS (SELECT ad_id, CAST(floor(start_time / 3600) AS BIGINT) AS hour, count(*) AS point_count FROM stays GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY ad_id ORDER BY hour) AS k FROM h),
      r AS (SELECT ad_id, hour, point_count, k, 0::BIGINT AS chunk, 1::BIGINT AS n, point_count AS p FROM o WHERE k = 1
        UNION ALL SELECT o.ad_id, o.hour, o.point_count, o.k, r.chunk + CASE WHEN r.n >= 5 OR r.p + o.point_count > 8 THEN 1 ELSE 0 END, CASE WHEN r.n >= 5 OR r.p + o.point_count > 8 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 5 OR r.p + o.point_count > 8 THEN o.point_count ELSE r.p + o.point_count END
        FROM r JOIN o ON o.ad_id = r.ad_id AND o.k = r.k + 1) SELECT ad_id, hour, point_count, chunk FROM r""")
_FILES = "files AS (SELECT file_relpath AS file, CASE WHEN min(row_index) % 6 = 0 THEN NULL ELSE min(row_index) % 300 - 150.0E0 END AS lon, min(row_index) % 120 - 60.0E0 AS lat FROM raw_rows GROUP BY 1)"
add("srt_spatial_shards", lambda s, d: gr.spatial_shards(view(s, d, "raw_rows").groupBy(F.col("file_relpath").alias("file")).agg(F.min("row_index").alias("k")).select("file", F.when(F.col("k") % 6 > 0, F.col("k") % 300 - 150.0).alias("lon"), (F.col("k") % 120 - 60.0).alias("lat")), 4),
    f"""WITH {view_sql('raw_rows')}, {_FILES}, there AS (SELECT *, row_number() OVER (ORDER BY floor(lat / 2), floor(lon / 2), file) - 1 AS k, ceil(count(*) OVER () / 4) AS quota FROM files WHERE lon IS NOT NULL)
      SELECT file, lon, lat, CAST(floor(k / quota) AS INTEGER) AS shard FROM there UNION ALL SELECT file, lon, lat, CAST((row_number() OVER (ORDER BY file) - 1) % 4 AS INTEGER) FROM files WHERE lon IS NULL""")
_SPLIT = "l{k} AS (SELECT row_index, ad_id, lon, lat, CASE WHEN n > 200 THEN part * 2 + CASE WHEN row_number() OVER (PARTITION BY ad_id, part ORDER BY v, w, row_index) > n // 2 THEN 1 ELSE 0 END ELSE part END AS part FROM (SELECT *, CASE WHEN east THEN lon ELSE lat END AS v, CASE WHEN east THEN lat ELSE lon END AS w FROM (SELECT *, count(*) OVER w AS n, max(lon) OVER w - min(lon) OVER w >= max(lat) OVER w - min(lat) OVER w AS east FROM l{j} WINDOW w AS (PARTITION BY ad_id, part))))"
add("srt_spatial_split", lambda s, d: gr.spatial_split(stays(s, d).select("row_index", (F.col("ad_id") % 3).alias("ad_id"), "lon", "lat"), "ad_id", 200, 5),
    f"WITH {STAYS_SQL}, l0 AS (SELECT row_index, ad_id % 3 AS ad_id, lon, lat, 1::BIGINT AS part FROM stays), " + ", ".join(_SPLIT.format(k=k, j=k - 1) for k in range(1, 6)) + " SELECT *, count(*) OVER (PARTITION BY ad_id, part) > 200 AS over FROM l5")
