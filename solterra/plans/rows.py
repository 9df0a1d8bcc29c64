"""Queries on rows as files hold them: text, time, keys, positions, heights, merges; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import rows as r
from ..sources.views import view, view_sql

QUERIES, SQL = {}, {}
_NUM = "CASE WHEN regexp_matches(trim({c}), '" + t.NUMBER + "') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
_ISO = (
    "CASE WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN epoch(TRY_CAST(concat(trim({c}), 'T00:00:00Z') AS TIMESTAMPTZ))"
    " WHEN regexp_matches(trim({c}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') THEN epoch(TRY_CAST(trim({c}) AS TIMESTAMPTZ)) END"
)
_UTC = "(to_timestamp({s}) AT TIME ZONE 'UTC')"
_ZONE = "(to_timestamp(timestamp) AT TIME ZONE 'America/New_York')"


def num(column: str) -> str:
    return _NUM.format(c=column)


def iso(column: str) -> str:
    return _ISO.format(c=column)


def add(name: str, source: str, columns, sql: str) -> None:
    """A query: what ``columns`` makes of a view; sql reads the view by its name."""
    QUERIES[name] = lambda s, d: columns(view(s, d, source))
    SQL[name] = f"WITH {view_sql(source)} {sql}"


add("fn_minute_floor", "light_rows", lambda v: v.select("row_index", t.minute_iso(F.col("timestamp")).alias("minute_iso")),
    f"SELECT row_index, strftime({_UTC.format(s='floor(timestamp / 60) * 60')}, '%Y-%m-%dT%H:%M:00.000Z') AS minute_iso FROM light_rows")
add("fn_bucket_n_min", "light_rows", lambda v: v.withColumn("w", F.col("row_index") % 1600 - 20).select("row_index", t.bucket(F.col("timestamp"), F.col("w"))[0].alias("start"), t.bucket(F.col("timestamp"), F.col("w"))[1].alias("end")),
    "SELECT row_index, CAST(floor(timestamp / w) * w AS BIGINT) AS start, CAST(floor(timestamp / w) * w + w AS BIGINT) AS end FROM (SELECT *, greatest(1, least(row_index % 1600 - 20, 1440)) * 60 AS w FROM light_rows)")
add("fn_bucket_key_norm", "raw_rows", lambda v: v.select("row_index", t.bucket_key(F.col("time")).alias("key")),
    "SELECT row_index, CASE WHEN suffix(trim(time), 'Z') AND NOT contains(time, '.') THEN concat(left(trim(time), length(trim(time)) - 1), '.000Z') ELSE trim(time) END AS key FROM raw_rows")
add("fn_parse_ts_flexible", "raw_rows", lambda v: v.select("row_index", t.parse_seconds(F.col("timestamp"), F.col("time"), bucket_start=F.col("bucketStart")).alias("seconds")),
    f"SELECT row_index, coalesce(CASE WHEN {num('timestamp')} > 0 THEN {num('timestamp')} END, {iso('timestamp')}, CASE WHEN {num('time')} > 0 THEN {num('time')} END, {iso('time')}, {iso('bucketStart')}) AS seconds FROM raw_rows")
add("fn_parse_ts_ms", "raw_rows", lambda v: v.select("row_index", t.parse_epoch(F.col("timestamp")).alias("seconds")),
    f"SELECT row_index, coalesce(CASE WHEN {num('timestamp')} > 1e12 THEN {num('timestamp')} / 1000 ELSE {num('timestamp')} END, {iso('timestamp')}) AS seconds FROM raw_rows")
add("fn_iso_ts_cast", "raw_rows", lambda v: v.select("row_index", F.date_format(F.col("time").try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("at")),
    "SELECT row_index, strftime(TRY_CAST(CASE WHEN length(time) = 10 THEN concat(time, 'T00:00:00Z') ELSE time END AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM raw_rows")
add("fn_local_night", "light_rows", lambda v: v.select("row_index", t.is_local_night(F.col("timestamp"), "America/New_York").alias("night")),
    f"SELECT row_index, hour({_ZONE}) >= 22 OR hour({_ZONE}) < 6 AS night FROM light_rows")
add("fn_local_dates", "light_rows", lambda v: v.select("ad_id", F.date_format(t.local(F.col("timestamp"), "America/New_York"), "yyyy-MM-dd").alias("date")).distinct(),
    f"SELECT DISTINCT ad_id, strftime({_ZONE}, '%Y-%m-%d') AS date FROM light_rows")
add("fn_hours_expand", "light_rows", lambda v: v.select(F.to_date(t.utc(F.col("timestamp"))).alias("d")).distinct().select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.explode(F.array(*map(F.lit, t.hour_list("6-8,12,22-1")))).alias("hour"), "d")
    .select("date", "hour", t.local_hour_seconds(F.col("d"), F.col("hour"), "America/New_York").alias("at")),
    f"SELECT strftime(d, '%Y-%m-%d') AS date, hour, CAST(epoch((d + to_hours(hour)) AT TIME ZONE 'America/New_York') AS BIGINT) AS at FROM (SELECT DISTINCT CAST({_UTC.format(s='timestamp')} AS DATE) AS d FROM light_rows), unnest([0, 1, 6, 7, 8, 12, 22, 23]) h(hour)")
add("fn_month_label", "light_rows", lambda v: v.groupBy(t.month(F.col("timestamp")).alias("month")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT strftime({_UTC.format(s='timestamp')}, '%Y-%m') AS month, count(*) AS n FROM light_rows GROUP BY 1")
_BOX = lambda: [(F.lit(-74.0) + F.col("building_id") % 40 * 0.25).alias("west"), (F.lit(-5.0) + F.col("building_id") % 70 * 0.25).alias("south")]
_H = "concat(CASE WHEN {v} >= 0 THEN '{p}' ELSE '{n}' END, lpad(CAST(CAST(round_even(abs({v}) * 100, 0) AS BIGINT) AS VARCHAR), 5, '0'))"
add("fn_partition_id", "known_buildings", lambda v: v.select("building_id", *_BOX()).select("building_id", t.partition_id("p", F.lit(0.25), F.col("west"), F.col("south"), F.col("west") + 0.25, F.col("south") + 0.25).alias("partition_id")),
    f"SELECT building_id, concat_ws('_', 'p', 'd025', {_H.format(v='west', p='e', n='w')}, {_H.format(v='south', p='n', n='s')}, {_H.format(v='(west + 0.25)', p='e', n='w')}, {_H.format(v='(south + 0.25)', p='n', n='s')}) AS partition_id"
    " FROM (SELECT building_id, -74.0 + building_id % 40 * 0.25 AS west, -5.0 + building_id % 70 * 0.25 AS south FROM known_buildings)")
_TILE = lambda k: f"regexp_extract(tile_id, '{t._TILE}', {k})"
_PARSED = "(SELECT *, " + ", ".join(f"(CASE WHEN {_TILE(k)} = '{m}' THEN -1 ELSE 1 END) * TRY_CAST({_TILE(k + 1)} AS INTEGER) AS {a}" for k, m, a in ((1, "w", "xa"), (3, "s", "ya"), (5, "w", "xb"), (7, "s", "yb"))) + f" FROM known_buildings WHERE regexp_matches(tile_id, '{t._TILE}'))"
add("fn_tile_id_parse", "known_buildings", lambda v: v.withColumn("box", t.tile_bounds(F.col("tile_id"))).where("box is not null").select("building_id", "box.*"),
    f"SELECT building_id, least(xa, xb) AS west, least(ya, yb) AS south, greatest(xa, xb) AS east, greatest(ya, yb) AS north FROM {_PARSED}")
add("join_cross_lateral", "known_buildings", lambda v: v.withColumn("box", t.tile_bounds(F.col("tile_id"))).where("box is not null").where(r.boxes_touch(tuple(F.col(f"box.{c}") for c in ("west", "south", "east", "north")), tuple(map(F.lit, (-20, 0, -10, 30))))).select("tile_id").distinct(),
    f"SELECT DISTINCT tile_id FROM {_PARSED} WHERE least(xa, xb) <= -10 AND greatest(xa, xb) >= -20 AND least(ya, yb) <= 30 AND greatest(ya, yb) >= 0")
add("fn_district", "raw_rows", lambda v: v.groupBy(t.district(F.col("file_relpath")).alias("district")).agg(F.countDistinct("file_relpath").alias("files")),
    "SELECT split_part(file_relpath, '/', 1) AS district, count(DISTINCT file_relpath) AS files FROM raw_rows GROUP BY 1")
add("fn_derived_relpath", "raw_rows", lambda v: v.select(t.derived_relpath(F.col("file_relpath")).alias("path")).distinct(), "SELECT DISTINCT concat(split_part(file_relpath, '/', 2), '.csv') AS path FROM raw_rows")
add("fn_source_prefix", "raw_rows", lambda v: v.where(t.has_prefix(F.col("source"), ["fallback", "error:"])).select(t.minute_iso(t.iso_seconds(F.col("bucketStart"))).alias("minute_iso")).distinct(),
    f"SELECT DISTINCT strftime({_UTC.format(s='floor(' + iso('bucketStart') + ' / 60) * 60')}, '%Y-%m-%dT%H:%M:00.000Z') AS minute_iso FROM raw_rows WHERE source LIKE 'fallback%' OR source LIKE 'error:%'")
add("fn_sanitize_text", "raw_rows", lambda v: v.select("row_index", t.one_line(F.col("detail")).alias("detail")), "SELECT row_index, left(translate(detail, concat(chr(13), chr(10)), '  '), 200) AS detail FROM raw_rows")
add("fn_digest", "light_rows", lambda v: v.groupBy("ad_id").agg(t.ids_digest(F.array_sort(F.collect_list(F.col("row_index").cast("string")))).alias("digest")),
    "SELECT ad_id, sha256(string_agg(concat(row_index, chr(10)), '' ORDER BY CAST(row_index AS VARCHAR))) AS digest FROM light_rows GROUP BY 1")
add("prj_split_cell_key", "raw_rows", lambda v: v.select("row_index", *(c.alias(n) for n, c in t.split_cell_key(F.col("cell_key")).items())),
    "SELECT row_index, split_part(cell_key, ':', 1) AS cell_provider, TRY_CAST(split_part(cell_key, ':', 2) AS INTEGER) AS cell_resolution, split_part(cell_key, ':', 3) AS cell_token,"
    " CASE WHEN split_part(cell_key, ':', 1) = 'square' THEN TRY_CAST(nullif(split_part(cell_key, ':', 4), '') AS BIGINT) END AS square_y FROM raw_rows")
_STAY = f"(coalesce({num('stay_status')} >= 1, false) OR coalesce(lower(trim(stay_status)) IN ('true', 'yes', 'y'), false))"
add("prj_stay_flag", "raw_rows", lambda v: v.select("row_index", r.is_stay(F.col("stay_status")).alias("stay")), f"SELECT row_index, {_STAY} AS stay FROM raw_rows")


def _picked(priority: list[str], numeric: bool) -> str:
    cases = []
    for s in priority:
        lon, lat = r.COORDINATES[s]
        if s not in ("gpx", "air", "lonlat"):  # the view has no such columns
            ok = " AND ".join(f"abs({num(c)}) < 'inf'::DOUBLE" if numeric else f"coalesce(trim({c}), '') <> ''" for c in (lon, lat))
            stay = f" AND {_STAY}" if s == "stay_point" else ""
            cases.append(f"WHEN {ok}{stay} THEN struct_pack(lon := trim({lon}), lat := trim({lat}), source := '{s}')")
    return "CASE " + " ".join(cases) + " END"


for _name, _order, _numeric in (("prj_pick_coord", r.PRIORITY, False), ("prj_pick_coord_indoor", r.INDOOR_PRIORITY, False), ("prj_pick_coord_clean", r.INDOOR_PRIORITY, True)):
    add(_name, "raw_rows", lambda v, o=_order, n=_numeric: r.pick_coordinates(v, o, n).select("row_index", "picked.*"), f"SELECT row_index, p.lon AS lon, p.lat AS lat, p.source AS source FROM (SELECT row_index, {_picked(_order, _numeric)} AS p FROM raw_rows)")
add("prj_optional_columns", "raw_rows", lambda v: r.with_columns(v, row_index="long", cloud_cover="double", is_night="int").select("row_index", "cloud_cover", "is_night"), "SELECT row_index, CAST(NULL AS DOUBLE) AS cloud_cover, CAST(NULL AS INTEGER) AS is_night FROM raw_rows")
add("prj_height_resolve", "known_buildings", lambda v: v.select("building_id", r.resolve_height(v).alias("height"), r.resolve_height(v.drop("height")).alias("by_levels")),
    f"SELECT building_id, greatest(coalesce({num('height')}, 12.0), 0.0) AS height, greatest(coalesce(levels * 3.5E0, 12.0), 0.0) AS by_levels FROM known_buildings")
_HT = f"coalesce({num('height')}, 0.0)"
_WFS = f"CASE WHEN {_HT} > 0 THEN {_HT} WHEN area > 0 THEN greatest(least(sqrt(area) * 0.12E0, 60.0), 5.0) ELSE 12.0 END"
add("prj_height_estimate_wfs", "known_buildings", lambda v: v.withColumn("h", r.height_by_area(t.number(F.col("height")), F.col("area"))).select("building_id", F.round("h", 6).alias("h"), r.levels_of(F.col("h")).alias("levels")),
    f"SELECT building_id, round(h, 6) AS h, CAST(greatest(1, floor(h / 3 + 0.5)) AS BIGINT) AS levels FROM (SELECT building_id, {_WFS} AS h FROM known_buildings)")
_KINDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in r.TYPE_HEIGHTS.items())
add("prj_height_estimate_type", "known_buildings", lambda v: v.select("building_id", r.height_by_type(t.number(F.col("height")), F.col("levels"), F.col("kind")).alias("h")),
    f"SELECT building_id, CAST(CASE WHEN {_HT} <> 0 THEN greatest(3, least({_HT}, 300)) WHEN levels <> 0 THEN greatest(3, least(levels * 3.5E0, 300)) ELSE CASE kind {_KINDS} ELSE 8.0 END END AS DOUBLE) AS h FROM known_buildings")
add("flt_valid_row", "raw_rows", lambda v: v.groupBy(r.validity(v, "ad_id", "fnl_lon", "gps_lat", "timestamp").alias("why")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT CASE WHEN coalesce(trim(ad_id), '') = '' THEN 'no_id' WHEN {num('fnl_lon')} IS NULL OR {num('gps_lat')} IS NULL THEN 'no_position' WHEN {num('timestamp')} IS NULL THEN 'no_start' ELSE 'ok' END AS why, count(*) AS n FROM raw_rows GROUP BY 1")
add("flt_valid_latlon", "known_buildings", lambda v: v.select("building_id", (F.col("building_id") % 500 - 250).cast("double").alias("w"), (F.col("building_id") % 190 - 95).cast("double").alias("s")).where(r.valid_box(F.col("w"), F.col("s"), F.col("w") + F.col("building_id") % 9 - 2, F.col("s") + 2)).select("building_id"),
    "SELECT building_id FROM (SELECT building_id, building_id % 500 - 250 AS w, building_id % 190 - 95 AS s, w + building_id % 9 - 2 AS e, s + 2 AS n FROM known_buildings) WHERE w BETWEEN -180 AND 180 AND e BETWEEN -180 AND 180 AND s BETWEEN -90 AND 90 AND n BETWEEN -90 AND 90 AND w < e AND s < n")
add("flt_region", "known_buildings", lambda v: v.where(F.col("region").isin("us", "ca") & F.col("height").isNotNull()).select("building_id", "region"), "SELECT building_id, region FROM known_buildings WHERE region IN ('us', 'ca') AND height IS NOT NULL")
add("flt_local_hours", "light_rows", lambda v: r.in_hours(v, "timestamp", "America/New_York", "22-3, 7").select("row_index"), f"SELECT row_index FROM light_rows WHERE hour({_ZONE}) IN (22, 23, 0, 1, 2, 3, 7)")
_SHA = "CAST(concat('0x', left(sha1(CAST(ad_id AS VARCHAR)), {n})) AS UBIGINT)"
add("flt_hash_sample", "light_rows", lambda v: r.sample_ids(v, "ad_id", 0.3).select("row_index"), f"SELECT row_index FROM light_rows WHERE {_SHA.format(n=16)} / 18446744073709551616.0E0 < 0.3")
add("srt_hash_shard", "light_rows", lambda v: v.select("row_index", r.hash_shard(F.col("ad_id"), 7).alias("shard")), f"SELECT row_index, CAST({_SHA.format(n=8)} % 7 AS INTEGER) AS shard FROM light_rows")
add("agg_shard_stats", "light_rows", lambda v: r.shard_stats(v, "ad_id", 7), f"SELECT CAST({_SHA.format(n=8)} % 7 AS INTEGER) AS shard, count(*) AS n, count(DISTINCT ad_id) AS ids FROM light_rows GROUP BY 1")
add("flt_bucket_list", "light_rows", lambda v: r.merge_rows(v.select("row_index", "sunlit", "cloud"), v.where("row_index % 10 = 3").select("row_index", F.lit(5).alias("sunlit"), F.lit(None).cast("double").alias("cloud")), ["row_index"]),
    "SELECT row_index, CASE WHEN row_index % 10 = 3 THEN 5 ELSE sunlit END AS sunlit, CASE WHEN row_index % 10 = 3 THEN NULL ELSE cloud END AS cloud FROM light_rows")
add("win_first_seen", "light_rows", lambda v: r.first_valid(v.select("file_relpath", "timestamp", F.when(F.col("row_index") % 3 > 0, F.col("row_index") % 90).cast("double").alias("lon"), (F.col("row_index") % 45).cast("double").alias("lat")), "file_relpath", ["timestamp"]),
    "SELECT file_relpath, lon, lat FROM (SELECT file_relpath, timestamp, CAST(row_index % 90 AS DOUBLE) AS lon, CAST(row_index % 45 AS DOUBLE) AS lat FROM light_rows WHERE row_index % 3 > 0) QUALIFY row_number() OVER (PARTITION BY file_relpath ORDER BY timestamp, lon, lat) = 1")
add("srt_round_robin", "raw_rows", lambda v: r.round_robin(v.select("file_relpath").distinct(), ["file_relpath"], 4), "SELECT file_relpath, CAST((row_number() OVER (ORDER BY file_relpath) - 1) % 4 AS INTEGER) AS shard FROM (SELECT DISTINCT file_relpath FROM raw_rows)")
add("srt_cursor_page", "tracks", lambda v: (lambda p: p[0].select("track_id", p[1]))(r.page(v.where("user_id = 7"), (F.col("created_at") < "1998-01-01") , [F.desc("created_at"), F.desc("track_id")], 20)),
    "SELECT track_id, count(*) OVER () > 20 AS has_more FROM (SELECT * FROM tracks WHERE user_id = 7 AND created_at < '1998-01-01' ORDER BY created_at DESC, track_id DESC LIMIT 21) ORDER BY created_at DESC, track_id DESC LIMIT 20")
