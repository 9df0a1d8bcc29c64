"""Queries that write files and read them back, and that run streams over them; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import fresh
from ..operators import light
from ..sources import files as f
from ..sources import versions
from ..sources.views import STAYS_SQL, WEATHER_SQL, stays, view, view_sql, weather
from ..streaming import windows as w
from .light import _BUILDINGS, _buildings
from .rows import iso, num

QUERIES, SQL = {}, {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def _csv(s, d):
    path = fresh(s, "csv")
    f.write_csv(view(s, d, "light_rows").select("row_index", "ad_id", "sunlit", "cloud", "source"), path)
    return path


_L, _RAW = view_sql("light_rows"), view_sql("raw_rows")
add("src_csv_auto", lambda s, d: f.csv_typed(s, [_csv(s, d)]).select(F.col("row_index").cast("long"), F.col("ad_id").cast("long"), "sunlit", F.round("cloud", 6).alias("cloud"), "source"), f"WITH {_L} SELECT row_index, ad_id, sunlit, round(cloud, 6) AS cloud, source FROM light_rows")
add("src_csv_dir", lambda s, d: f.csv_rows(s, _csv(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n")), f"WITH {_L} SELECT source, count(*) AS n FROM light_rows GROUP BY 1")
add("src_csv_rows", lambda s, d: f.csv_rows(s, _csv(s, d)).select(F.col("row_index"), "ad_id", "sunlit", "source"), f"WITH {_L} SELECT CAST(row_index AS VARCHAR) AS row_index, CAST(ad_id AS VARCHAR) AS ad_id, coalesce(CAST(sunlit AS VARCHAR), '') AS sunlit, source FROM light_rows")


def _rectangles(s, d):
    path = fresh(s, "catalog")
    rows = s.read.parquet(f"{d}/part.parquet").select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("t"), "p_partkey")).alias("tileId"), F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("id"),
        (F.col("p_partkey") % 90).cast("double").alias("minLon"), F.lit(1.5).alias("minLat"), (F.col("p_partkey") % 90 + 2).cast("double").alias("maxLon"), F.lit(2.5).alias("maxLat"), F.lit("us").alias("region"),
    )
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).write.text(path)  # a catalog is one document
    return f.json_catalog(s, path)


add("src_json_catalog", lambda s, d: _rectangles(s, d).select("tile_id", "west", "south", "east", "north", "region", "description"),
    "SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('t', p_partkey) ELSE concat('i', p_partkey) END AS tile_id, CAST(p_partkey % 90 AS DOUBLE) AS west, 1.5::DOUBLE AS south, CAST(p_partkey % 90 + 2 AS DOUBLE) AS east, 2.5::DOUBLE AS north, 'us' AS region, NULL::VARCHAR AS description FROM part")


def _boxes(s, d):
    return _buildings(s, d).select("building_id", "height", *light.ring_bounds("ring"), (F.col("building_id") % 8).alias("partition_id"))


_BOXES = f"{_BUILDINGS}, boxes AS (SELECT id AS building_id, height, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m GROUP BY 1, 2)"
_IN = "x0 <= -7398000 AND x1 >= -7399000 AND y0 <= 4071500 AND y1 >= 4070500"
BOX = (-7399000, 4070500, -7398000, 4071500)


def _partitioned(s, d, path):
    return f.write_partitions(_boxes(s, d), "partition_id", path)


def boxed(s, d):
    path = fresh(s, "boxes")
    f.write_hilbert(_boxes(s, d), path, 8, row_group_bytes=1 << 14)
    return f.boxed_parquet(s, path, *BOX)


def _union(s, d):
    """The box over stored partitions, one of which lacks the columns of bounds and is read whole, with its footprints' own."""
    top = fresh(s, "parts")
    rows = _boxes(s, d)
    for k in range(3):
        f.write_hilbert(rows.where(F.col("partition_id") % 3 == k), f"{top}/{k}", 2)
    rows.where("partition_id % 3 = 1").drop("x0", "x1", "y0", "y1").write.parquet(f"{top}/old")
    shape = rows.schema
    return f.boxed_partitions(s, [f"{top}/0", f"{top}/2"], *BOX, shape).select("building_id", "x0").unionByName(f.boxed_partitions(s, [f"{top}/old"], *BOX).select("building_id", F.lit(None).cast("long").alias("x0")))


add("src_geoparquet_bbox", lambda s, d: boxed(s, d).select("building_id", "x0", "y0"), f"WITH {_BOXES} SELECT building_id, x0, y0 FROM boxes WHERE {_IN}")
add("src_geoparquet_union", _union, f"WITH {_BOXES} SELECT building_id, x0 FROM boxes WHERE {_IN} AND building_id % 8 % 3 <> 1 UNION ALL SELECT building_id, NULL FROM boxes WHERE building_id % 8 % 3 = 1")
add("src_vector_file_bbox", lambda s, d: boxed(s, d).orderBy("building_id").limit(10).select("building_id"), f"WITH {_BOXES} SELECT building_id FROM boxes WHERE {_IN} ORDER BY building_id LIMIT 10")
add("sink_parquet_copy", lambda s, d: (lambda p: (f.write_parquet(_boxes(s, d), p), s.read.parquet(p))[1])(fresh(s, "copy")).select("building_id", "height"), f"WITH {_BOXES} SELECT building_id, height FROM boxes")
add("sink_csv_copy", lambda s, d: f.csv_rows(s, _csv(s, d)).select("row_index", "cloud"),
    f"WITH {_L} SELECT CAST(row_index AS VARCHAR) AS row_index, CASE WHEN cloud IS NULL THEN '' WHEN cloud = floor(cloud) THEN CAST(CAST(cloud AS BIGINT) AS VARCHAR) ELSE CAST(cloud AS VARCHAR) END AS cloud FROM light_rows")


def _replaced(s, d):
    """A table put in the place of an older one."""
    path, rows = fresh(s, "table"), view(s, d, "light_rows").select("row_index", "cloud", "source")
    f.replace_csv(rows.where("row_index % 2 = 0"), path)
    f.replace_csv(rows, path)
    return f.csv_rows(s, path).select("row_index", "cloud", "source")


add("sink_csv_atomic", _replaced,
    f"WITH {_L} SELECT CAST(row_index AS VARCHAR) AS row_index, CASE WHEN cloud IS NULL THEN '' WHEN cloud = floor(cloud) THEN CAST(CAST(cloud AS BIGINT) AS VARCHAR) ELSE CAST(cloud AS VARCHAR) END AS cloud, source FROM light_rows")
add("sink_geoparquet_partition", lambda s, d: _partitioned(s, d, fresh(s, "parts")).select(F.col("partition_id").cast("long"), "rows"), f"WITH {_BOXES} SELECT building_id % 8 AS partition_id, count(*) AS rows FROM boxes GROUP BY 1")


def _from_manifest(s, d):
    path, listed = fresh(s, "parts"), fresh(s, "manifest")
    _partitioned(s, d, path)
    written = _boxes(s, d).select("partition_id").distinct()  # a manifest names what was written
    written.select("partition_id", F.concat(F.lit(f"{path}/partition_id="), F.col("partition_id").cast("string")).alias("path")).write.option("header", True).csv(listed)
    return f.partition_files(s, listed, s.range(3).withColumnRenamed("id", "partition_id"), _boxes(s, d).drop("partition_id").schema).select("building_id", "height")


add("src_manifest_parquet", _from_manifest, f"WITH {_BOXES} SELECT building_id, height FROM boxes WHERE building_id % 8 < 3")


def _target_manifest(s, d):
    root = fresh(s, "files")
    f.write_partitions(view(s, d, "light_rows").select("row_index", (F.col("ad_id") % 5).alias("k")), "k", root)
    lines = ["# files", "", "k=1", "k=3", "k=1", "k=99"]
    s.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{root}-list")
    return f.parquet_at(s, f.manifest(s, f"{root}-list", root, skip_missing=True), "row_index long, k long", root).select("row_index")


add("src_target_manifest", _target_manifest, f"WITH {_L} SELECT row_index FROM light_rows WHERE ad_id % 5 IN (1, 3)")


def _users(s, d):
    path = fresh(s, "users")
    f.write_user_files(view(s, d, "light_rows").select("ad_id", "row_index"), "ad_id", path)
    return s.read.option("header", True).option("basePath", path).schema("ad_id long, row_index long, prefix string, user string").csv(path)


add("sink_per_user_files", lambda s, d: _users(s, d).groupBy("prefix", "user").agg(F.count(F.lit(1)).alias("n")), f"WITH {_L} SELECT left(CAST(ad_id AS VARCHAR), 2) AS prefix, CAST(ad_id AS VARCHAR) AS user, count(*) AS n FROM light_rows GROUP BY ALL")


def _chunked(s, d):
    path = fresh(s, "chunks")
    rows = view(s, d, "light_rows").select((F.col("row_index") % 6).alias("chunk"), F.col("row_index").alias("task_id"), "duration_s")
    work = lambda todo: todo.withColumn("double_s", F.col("duration_s") * 2)
    f.write_chunks(rows.where("chunk < 3"), work, path)  # a run that got as far as that
    f.write_chunks(rows, work, path)
    return f.parquet_at(s, [f"{path}/rows"], work(rows).schema, f"{path}/rows").select(F.col("chunk").cast("long"), "task_id", "double_s")


add("sink_checkpoint", _chunked, f"WITH {_L} SELECT row_index % 6 AS chunk, row_index AS task_id, duration_s * 2 AS double_s FROM light_rows")
_trace = lambda s, d: view(s, d, "raw_rows").select(F.col("row_index").alias("source_row"), F.col("ad_id").alias("User_Id"), F.col("time").alias("Timestamp"), F.col("fnl_lon").alias("Longitude"), F.col("gps_lat").alias("lat"), F.lit("12.5").alias("speed"))
_ON = f"coalesce({num('fnl_lon')} BETWEEN -180 AND 180 AND {num('gps_lat')} BETWEEN -90 AND 90, false)"
_WHY = f"CASE WHEN coalesce(trim(ad_id), '') = '' THEN 'id' WHEN {iso('time')} IS NULL THEN 'time' WHEN NOT {_ON} THEN 'position' END"
add("src_mobility_csv", lambda s, d: f.trace_rows(_trace(s, d))[0], f"WITH {_RAW} SELECT row_index AS source_row, trim(ad_id) AS id, {iso('time')} AS timestamp, {num('fnl_lon')} AS lng, {num('gps_lat')} AS lat, 12.5::DOUBLE AS speed_kmh FROM raw_rows WHERE {_WHY} IS NULL")
add("src_mobility_csv_rejects", lambda s, d: f.trace_rows(_trace(s, d))[1], f"WITH {_RAW} SELECT row_index AS source_row, {_WHY} AS why FROM raw_rows WHERE {_WHY} IS NOT NULL")
_nodes = lambda s, d: stays(s, d).select(F.col("row_index").alias("node_id"), F.when(F.col("row_index") % 17 == 0, 500.0).otherwise(F.col("lon")).alias("lon"), "lat")
_ways = lambda s, d: s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("way_id"), F.transform(F.sequence(F.lit(0), (F.col("p_partkey") % 5).cast("int")), lambda k: F.col("p_partkey") * 4 + k).alias("nodes"))
add("src_osm_convert", lambda s, d: f.ways_to_rings(_ways(s, d), _nodes(s, d)).select("way_id", F.size("ring").cast("long").alias("n"), F.round(F.element_at("ring", 1).x, 9).alias("x"), F.round(F.element_at("ring", -1).y, 9).alias("y")),
    f"""WITH {STAYS_SQL}, v AS (SELECT p_partkey AS way_id, k, lon, lat FROM part, range(5) r(k), stays WHERE k <= p_partkey % 5 AND row_index = p_partkey * 4 + k AND row_index % 17 <> 0)
      SELECT way_id, count(*) + 1 AS n, round(arg_min(lon, k), 9) AS x, round(arg_min(lat, k), 9) AS y FROM v GROUP BY 1 HAVING count(*) >= 3""")


def _monthly(s, d):
    top = fresh(s, "cube")
    cube = weather(s, d).withColumn("year", F.year(F.timestamp_seconds("timestamp"))).withColumn("month", F.month(F.timestamp_seconds("timestamp")))
    f.write_partitions(cube.withColumn("ym", F.col("year") * 100 + F.col("month")).drop("year", "month"), "ym", top)
    return f.monthly(s, f"{top}/ym=%Y%m", ["1999-01", "2024-01"], schema=weather(s, d).schema).select("grid", "timestamp", "tcc")


add("src_era5", _monthly, f"WITH {STAYS_SQL}, {WEATHER_SQL} SELECT grid, timestamp, tcc FROM weather WHERE strftime(to_timestamp(timestamp) AT TIME ZONE 'UTC', '%Y-%m') IN ('1999-01', '2024-01')")
_cube = lambda s, d, k: stays(s, d).select(F.col("row_index").alias("timestamp"), "lat", "lon", (F.col("row_index") % k).cast("double").alias("value"))
add("src_era5_zip_merge", lambda s, d: f.merged_cube({"tcc": _cube(s, d, 7), "ssrd": _cube(s, d, 11)}), f"WITH {STAYS_SQL} SELECT row_index AS timestamp, lat, lon, CAST(row_index % 7 AS DOUBLE) AS tcc, CAST(row_index % 11 AS DOUBLE) AS ssrd FROM stays")
_LINES = "SELECT event_id AS line_no, concat(CASE WHEN event_id % 7 = 0 THEN '\"x,\"\"y\"' ELSE 'a' END, ',', event_id, CASE WHEN event_id % 3 = 0 THEN ',x,y,z,end' WHEN event_id % 3 = 1 THEN ',x,end' ELSE '' END) AS text FROM events"
add("fn_csv_repair", lambda s, d: f.repaired(s.read.parquet(f"{d}/events.parquet").selectExpr("'f' as file", "event_id as line_no", "concat(CASE WHEN event_id % 7 = 0 THEN '\"x,\"\"y\"' ELSE 'a' END, ',', event_id, CASE WHEN event_id % 3 = 0 THEN ',x,y,z,end' WHEN event_id % 3 = 1 THEN ',x,end' ELSE '' END) as text"), 4, 3).select("line_no", F.array_join("fields", "|").alias("fields")),
    f"SELECT line_no, concat(CASE WHEN line_no % 7 = 0 THEN '\"x,\"\"y\"' ELSE 'a' END, '|', line_no, CASE line_no % 3 WHEN 0 THEN '|x y z|end' WHEN 1 THEN '|x|end' ELSE '||' END) AS fields FROM ({_LINES})")


def _stream(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = fresh(s, "stream")
    rows.write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(s, stream, **more):
    path = fresh(s, "answer")
    w.to_table(stream, path, fresh(s, "offsets"), **more).awaitTermination()
    return s.read.parquet(path)


_seconds = lambda c: F.unix_timestamp(c)
add("stm_minute_tumbling", lambda s, d: _run(s, w.minute_counts(_stream(s, d), ["user_id"])).select("user_id", _seconds("minute").alias("minute"), "n", F.round("total", 6).alias("total")),
    "SELECT user_id, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS minute, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
add("stm_session_gap", lambda s, d: _run(s, w.sessions(_stream(s, d), "user_id", 7200, late=None)).select("user_id", _seconds("start").alias("start"), _seconds("last").alias("last"), "n"),
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 7200 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
      SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts))) AS BIGINT) AS last, count(*) AS n FROM s GROUP BY user_id, k""")


def _late(s, d):
    path = fresh(s, "late")
    rows = _stream(s, d).select("user_id", "event_id", F.round("value", 6).alias("value"))
    w.merge_late(rows, path, ["user_id"], "event_id", fresh(s, "offsets"), buckets=8).awaitTermination()
    return versions.read_version(s, path, rows.schema)


add("stm_late_rows", _late, "SELECT user_id, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1")
add("stm_resume_exactly_once", lambda s, d: _resumed(s, d), "SELECT user_id, count(*) AS n FROM events GROUP BY 1")


def _resumed(s, d):
    """The same stream started twice from one set of offsets: the second start finds nothing new and adds nothing."""
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id")
    source, path, offsets = fresh(s, "stream"), fresh(s, "answer"), fresh(s, "offsets")
    rows.write.parquet(source)
    for _ in range(2):
        w.to_table(s.readStream.schema(rows.schema).parquet(source), path, offsets, mode="append").awaitTermination()
    return s.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
