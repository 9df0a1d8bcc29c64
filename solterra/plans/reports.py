"""Queries for reports, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import graph as gr
from ..operators import reports as p
from ..sources.views import STAYS_SQL, view, view_sql, weather
from .light import _WEATHER
from .rows import _ZONE

QUERIES, SQL = {}, {}


def add(name: str, source: str, columns, sql: str) -> None:
    """A query: what ``columns`` makes of a view; sql reads the view by its name."""
    QUERIES[name] = lambda s, d: columns(view(s, d, source))
    SQL[name] = f"WITH {view_sql(source)} {sql}"


_VALUES = ["tracked_min", "tracked_min_daylight", "sunlight_min_cloud_daylight", "sunlight_min_geom_daylight", "sunlight_ratio_cloud_daylight"]
_MM = ", ".join(f"round(avg({c}) FILTER (id <> ''), 9) AS {c}_mean, round(median({c}) FILTER (id <> ''), 9) AS {c}_median" for c in _VALUES)
add("agg_report_weighted", "daily", lambda v: p.by_person_day(v, _VALUES), f"SELECT count(DISTINCT nullif(id, '')) AS people, count(*) AS person_days, {_MM} FROM daily")
add("agg_report_person", "daily", lambda v: p.by_person(v, _VALUES),
    "SELECT " + ", ".join(f"round(avg({c}), 9) AS {c}_mean_person" for c in _VALUES) + " FROM (SELECT id, " + ", ".join(f"avg({c}) AS {c}" for c in _VALUES) + " FROM daily WHERE id <> '' GROUP BY id)")
_HOURS = f"hour({_ZONE}) BETWEEN 9 AND 16"
_hours = lambda: F.hour(t.local(F.col("timestamp"), "America/New_York")).isin(t.hour_list("9-16"))
_BY_FILE = f"f AS (SELECT file_relpath, count(*) AS rows, count(*) FILTER ({_HOURS}) AS rows_in_hours, count(*) FILTER ({_HOURS} AND irradiance > 0) AS irr_nonzero, count(*) FILTER ({_HOURS} AND source = 'night') AS source_night, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM light_rows GROUP BY 1)"
_SUSPECT = "rows_in_hours >= 5 AND (irr_nonzero / greatest(rows_in_hours, 1) < 0.97 OR source_night / greatest(rows_in_hours, 1) > 0.22) AS suspect"
_suspects = lambda v: p.suspects(p.daylight_by_file(v, _hours()), 5, 0.97, 0.22)
add("agg_qc_daylight", "light_rows", _suspects, f", {_BY_FILE} SELECT *, {_SUSPECT} FROM f")
add("agg_qc_district", "light_rows", lambda v: p.by_district(_suspects(v), t.district(F.col("file_relpath")), "suspect"), f", {_BY_FILE}, s AS (SELECT *, {_SUSPECT} FROM f) SELECT split_part(file_relpath, '/', 1) AS district, count(*) AS files, count(*) FILTER (suspect) AS flagged FROM s GROUP BY 1")
_LINES = "lines AS (SELECT user_id % 20 AS file, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS line_no, CASE WHEN event_id % 17 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN 'a,b' ELSE 'a,b,c' END AS text FROM events)"


def _lines(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 20 as file", "event_id", "CASE WHEN event_id % 17 = 0 THEN ' ' WHEN event_id % 13 = 0 THEN 'a,b' ELSE 'a,b,c' END as text")
    return rows.selectExpr("file", "row_number() over (partition by file order by event_id) as line_no", "text")


QUERIES["agg_validate_struct"] = lambda s, d: p.width_by_file(_lines(s, d), F.size(F.split("text", ","))).select("file", "rows", "bad_rows", F.col("first_bad").cast("long"))
SQL["agg_validate_struct"] = f"""WITH {_LINES}, w AS (SELECT *, len(string_split(text, ',')) AS w FROM lines WHERE trim(text) <> ''), h AS (SELECT file, w AS head FROM w WHERE line_no = 1)
  SELECT file, count(*) AS rows, count(*) FILTER (head IS NULL OR w <> head) AS bad_rows, min(line_no) FILTER (head IS NULL OR w <> head) AS first_bad FROM w LEFT JOIN h USING (file) WHERE line_no > 1 GROUP BY file"""
_CLAMP = "greatest(0.0, least(cloud, 1.0))"
_KNOWN = "source <> 'night' AND sunlit IS NOT NULL AND cloud IS NOT NULL AND duration_s IS NOT NULL"
_FACTOR = f"CASE WHEN {_KNOWN} THEN greatest({{m}}, 1 - {_CLAMP} * 0.85E0) END"
_NEW = f"n AS (SELECT *, {_FACTOR.format(m='0.15E0')} AS factor, {_FACTOR.format(m='0.3E0')} AS old_factor FROM light_rows)"
add("fn_recompute_factor", "light_rows", lambda v: p.recomputed(v).select("row_index", *(t.plain_number(F.col(c)).alias(c) for c in ("factor", "sunlit_effective")), *(F.round(c, 6).alias(c) for c in ("shadow_effective", "sunlight_s", "shadow_s"))),
    f", {_NEW}, f AS (SELECT row_index, rtrim(rtrim(format('{{:.6f}}', factor), '0'), '.') AS factor, rtrim(rtrim(format('{{:.6f}}', sunlit * factor), '0'), '.') AS sunlit_effective, round(100 - sunlit * factor * 100, 6) AS shadow_effective, round(sunlit * factor * duration_s, 6) AS sunlight_s, round((100 - sunlit * factor * 100) / 100 * duration_s, 6) AS shadow_s FROM n) SELECT * FROM f")
add("agg_recompute_delta", "light_rows", lambda v: p.recompute_delta(v, 0.85, 0.15, 0.3).select("rows", "rows_weather", "rows_impacted", *(F.round(c, 6).alias(c) for c in ("old_s", "new_s", "pct"))),
    f", {_NEW}, d AS (SELECT count(*) AS rows, count(factor) AS rows_weather, count(*) FILTER (abs(sunlit * factor * duration_s - sunlit * old_factor * duration_s) > 1e-9) AS rows_impacted, sum(sunlit * old_factor * duration_s) AS o, sum(sunlit * factor * duration_s) AS n FROM n)"
    " SELECT rows, rows_weather, rows_impacted, round(o, 6) AS old_s, round(n, 6) AS new_s, round((n - o) / o * 100, 6) AS pct FROM d")
add("fn_mask_indoor", "light_rows", lambda v: p.without_indoor(v).select("row_index", "sunlit", "shadow_percent", "irradiance", "source"),
    "SELECT row_index, CASE WHEN indoor THEN 0 ELSE sunlit END AS sunlit, CASE WHEN indoor THEN 100.0 ELSE shadow_percent END AS shadow_percent, CASE WHEN indoor THEN 0.0 ELSE irradiance END AS irradiance, CASE WHEN indoor THEN 'indoor' ELSE source END AS source FROM light_rows")
add("fn_canopy_loss", "light_rows", lambda v: p.canopy_loss(v.withColumn("nc", F.col("shadow_percent") + F.col("row_index") % 5 - 2), {"loss": ("nc", "shadow_percent"), "lost_light": ("sunlit", "cloud")}).select("row_index", "loss", F.round("lost_light", 9).alias("lost_light")),
    "SELECT row_index, greatest(0.0, shadow_percent + row_index % 5 - 2 - shadow_percent) AS loss, CASE WHEN sunlit IS NOT NULL AND cloud IS NOT NULL THEN round(greatest(0.0, sunlit - cloud), 9) END AS lost_light FROM light_rows")
add("join_positional", "light_rows", lambda v: p.positional(v.select("row_index", "sunlit"), v.where("row_index % 4 > 0").select("row_index", "sunlit", "cloud"), ["sunlit", "cloud"], "_nc"),
    "SELECT row_index, sunlit, CASE WHEN row_index % 4 > 0 THEN sunlit END AS sunlit_nc, CASE WHEN row_index % 4 > 0 THEN cloud END AS cloud_nc FROM light_rows")
add("join_by_source_row", "light_rows", lambda v: v.select("row_index", "ad_id").join(v.where("sunlit = 1").select(F.col("row_index"), "duration_s"), "row_index", "left"), "SELECT row_index, ad_id, CASE WHEN sunlit = 1 THEN duration_s END AS duration_s FROM light_rows")
add("agg_track_totals", "tracks", lambda v: p.track_totals(v, ["user_id"]), "SELECT user_id, count(*) AS tracks, sum(distance_m) AS distance_m, CAST(sum(duration_min) AS BIGINT) AS duration_min, round(avg(comfort), 9) AS comfort FROM tracks GROUP BY 1")
add("agg_track_activity", "tracks", p.track_activity, "SELECT activity, count(*) AS tracks, sum(distance_m) AS distance_m FROM tracks GROUP BY 1")
add("agg_track_monthly", "tracks", p.track_monthly, "SELECT CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month, count(*) AS tracks, sum(distance_m) AS distance_m FROM tracks GROUP BY 1, 2 ORDER BY 1 DESC, 2 DESC LIMIT 12")
add("agg_building_types", "known_buildings", p.building_types, "SELECT kind, count(*) AS n FROM known_buildings GROUP BY 1 ORDER BY n DESC, kind NULLS LAST LIMIT 10")
add("agg_building_stats", "known_buildings", p.building_stats, "SELECT count(*) AS buildings, count(DISTINCT concat(coalesce(region, '-'), '/', tile_id)) AS tiles, count(*) * 2000 AS bytes, min(created) AS oldest, max(created) AS newest FROM known_buildings")
add("join_using_tile", "known_buildings", lambda v: v.select("building_id", "tile_id").join(v.where("region = 'us'").select("tile_id").distinct(), "tile_id"), "SELECT building_id, tile_id FROM known_buildings JOIN (SELECT DISTINCT tile_id FROM known_buildings WHERE region = 'us') USING (tile_id)")
add("agg_point_stats", "light_rows", p.point_stats,
    "SELECT round(avg(p), 9) AS mean, min(p) AS least, max(p) AS largest, round(stddev_pop(p), 9) AS deviation, count(*) FILTER (p < 10) AS no_shadow, count(*) FILTER (p >= 10 AND p < 30) AS light, count(*) FILTER (p >= 30 AND p < 60) AS moderate, count(*) FILTER (p >= 60 AND p < 80) AS heavy, count(*) FILTER (p >= 80) AS extreme FROM (SELECT shadow_percent AS p FROM light_rows)")
add("agg_trace_intensity", "light_rows", lambda v: p.trace_intensity(v.withColumn("speed_kmh", F.when(F.col("row_index") % 4 > 0, F.col("speed_kmh"))), "ad_id"),
    "SELECT ad_id, round(greatest(0.25, least(avg(coalesce(CASE WHEN row_index % 4 > 0 THEN speed_kmh END, 18.0)) / 45 * 0.7E0 + least(CASE WHEN max(timestamp) > min(timestamp) THEN count(*) / (max(timestamp) - min(timestamp)) ELSE count(*) END / 4, 1.0) * 0.3E0, 1.0)), 9) AS intensity FROM light_rows GROUP BY 1")
add("agg_bbox_global", "light_rows", lambda v: p.bounds(v.select(F.when(F.col("row_index") % 6 > 0, F.col("speed_kmh")).alias("lon"), F.col("cloud").alias("lat"))),
    "SELECT count(*) AS rows, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS skipped, min(lon) FILTER (ok) AS west, min(lat) FILTER (ok) AS south, max(lon) FILTER (ok) AS east, max(lat) FILTER (ok) AS north FROM (SELECT CASE WHEN row_index % 6 > 0 THEN speed_kmh END AS lon, cloud AS lat, lon IS NOT NULL AND lat IS NOT NULL AS ok FROM light_rows)")
add("agg_percentile_nearest", "light_rows", lambda v: gr.percentiles_at(v, ["source"], "shadow_percent"),
    "SELECT source, " + ", ".join(f"list_sort(list(shadow_percent))[1 + CAST(round_even((count(*) - 1) * {q}E0, 0) AS BIGINT)] AS p{int(100 * q)}" for q in (0.9, 0.95, 0.99)) + " FROM light_rows GROUP BY 1")
add("agg_histogram", "light_rows", lambda v: gr.histogram(v, "irradiance", 30, clip_max=700.0, drop_zero=True),
    ", k AS (SELECT least(irradiance, 700.0) AS v FROM light_rows WHERE irradiance > 0), e AS (SELECT min(v) AS lo, max(v) AS hi FROM k) SELECT CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n FROM k, e GROUP BY 1")
QUERIES["win_ssrd_mode"] = lambda s, d: p.ssrd_mode(weather(s, d).withColumn("ssrd", F.when(F.col("grid") == 3, F.col("timestamp") * 7919 % 5000).otherwise(F.col("ssrd"))), "grid")
SQL["win_ssrd_mode"] = f"""WITH {STAYS_SQL}, {_WEATHER}, r AS (SELECT grid, timestamp, CASE WHEN grid = 3 THEN timestamp * 7919 % 5000 ELSE ssrd END AS s FROM weather),
  l AS (SELECT grid, s - lag(s) OVER (PARTITION BY grid ORDER BY timestamp) AS d FROM r) SELECT grid, CASE WHEN count(*) >= 10 AND count(*) FILTER (d < -1e-3) / (count(*) - 1) > 0.2 THEN 'incremental' ELSE 'cumulative' END AS mode FROM l GROUP BY 1"""
add("agg_summary_merge", "light_rows", lambda v: gr.merge_summaries(v, ["duration_s", "sunlit"], ["shadow_percent"], ["cloud"], ["source"]), "SELECT source, CAST(sum(duration_s) AS BIGINT) AS duration_s, CAST(coalesce(sum(sunlit), 0) AS BIGINT) AS sunlit, max(shadow_percent) AS shadow_percent, min(cloud) AS cloud FROM light_rows GROUP BY 1")
add("join_missing_outputs", "raw_rows", lambda v: gr.without_keys(v.select(t.derived_relpath(F.col("file_relpath")).alias("path")).distinct(), v.where("row_index % 97 = 0").select(t.derived_relpath(F.col("file_relpath")).alias("path")), ["path"]),
    "SELECT DISTINCT concat(split_part(file_relpath, '/', 2), '.csv') AS path FROM raw_rows EXCEPT SELECT concat(split_part(file_relpath, '/', 2), '.csv') FROM raw_rows WHERE row_index % 97 = 0")
add("set_difference_keys", "light_rows", lambda v: gr.without_keys(v.select("ad_id", "source").distinct(), v.where("row_index % 50 = 1"), ["ad_id", "source"]), "SELECT DISTINCT ad_id, source FROM light_rows EXCEPT SELECT ad_id, source FROM light_rows WHERE row_index % 50 = 1")
add("set_distinct", "known_buildings", lambda v: v.select("tile_id", "region").distinct(), "SELECT DISTINCT tile_id, region FROM known_buildings")
add("set_union_all", "light_rows", lambda v: v.where("row_index % 2 = 0").select("row_index", F.lit("even").alias("part")).unionByName(v.where("row_index % 3 = 0").select(F.lit("third").alias("part"), "row_index")), "SELECT row_index, 'even' AS part FROM light_rows WHERE row_index % 2 = 0 UNION ALL SELECT row_index, 'third' FROM light_rows WHERE row_index % 3 = 0")
add("set_union_obstacles", "known_buildings", lambda v: v.select("building_id", t.number(F.col("height")).alias("height"), F.lit("building").alias("what")).unionByName(v.where("building_id % 5 = 0").select("building_id", F.lit(9.0).alias("height"), F.lit("canopy").alias("what"), "levels"), allowMissingColumns=True).select("building_id", "height", "what", "levels"),
    "SELECT building_id, CASE WHEN regexp_matches(height, '^-?[0-9]+$') THEN CAST(TRY_CAST(height AS DOUBLE) AS DOUBLE) END AS height, 'building' AS what, NULL::BIGINT AS levels FROM known_buildings UNION ALL SELECT building_id, 9.0, 'canopy', levels FROM known_buildings WHERE building_id % 5 = 0")
add("set_union_regions", "known_buildings", lambda v: v.where("region = 'us'").select("tile_id").unionByName(v.where("region = 'ca'").select("tile_id")).dropDuplicates(["tile_id"]), "SELECT tile_id FROM known_buildings WHERE region = 'us' UNION SELECT tile_id FROM known_buildings WHERE region = 'ca'")
add("srt_multi", "light_rows", lambda v: v.groupBy("source", "sunlit").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("source"), F.desc_nulls_last("sunlit")), "SELECT source, sunlit, count(*) AS n FROM light_rows GROUP BY 1, 2")
add("src_allowlist", "raw_rows", lambda v: v.select("row_index", "ad_id").join(v.where("row_index % 10 = 0").select(F.trim("ad_id").alias("ad_id")).where("ad_id <> ''").distinct(), "ad_id", "left_semi"),
    "SELECT row_index, ad_id FROM raw_rows WHERE ad_id IN (SELECT trim(ad_id) FROM raw_rows WHERE row_index % 10 = 0 AND trim(ad_id) <> '')")
