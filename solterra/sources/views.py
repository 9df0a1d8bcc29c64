"""Mobility views over the relational tables: integer arithmetic only, so that any engine derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAY = [
    "user_id AS ad_id", "event_id AS row_index", "{epoch} AS start_time", "{epoch} + 600 + (event_id * 37) % 7200 AS end_time",
    "-74.0E0 + (user_id % 40) * 0.001E0 + (event_id % 7) * 0.00013E0 + 0.00005E0 AS lon",
    "40.7E0 + (user_id % 25) * 0.001E0 + (event_id % 11) * 0.00011E0 + 0.00005E0 AS lat",
    "concat('shard_', CAST(user_id % 4 AS VARCHAR(4))) AS file_relpath",
]

STAYS_SQL = "stays AS (SELECT " + ", ".join(_STAY).format(epoch="CAST(floor(epoch(ts)) AS BIGINT)") + " FROM events)"


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ad_id, row_index, start_time, end_time, lon, lat, file_relpath) of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    return events.selectExpr(*(c.format(epoch="epoch").replace("VARCHAR(4)", "STRING") for c in _STAY))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(building_id, height, lon0, lat0 .. lon3, lat3): a straight or turned quadrangle for every part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    height = F.when(F.col("p_partkey") % 17 == 0, 12.0).otherwise(F.col("p_size").cast("double"))
    lon, lat = F.lit(-74.0) + (F.col("p_partkey") * 13 % 400) * 0.0001, F.lit(40.7) + (F.col("p_partkey") * 7 % 250) * 0.0001
    turned = F.col("p_partkey") % 2 == 1
    straight = [(0.0001, 0.00006), (-0.0001, 0.00006), (-0.0001, -0.00006), (0.0001, -0.00006)]
    diamond = [(0.00012, 0.0), (0.0, 0.00008), (-0.00012, 0.0), (0.0, -0.00008)]
    corners = [c for i, ((sx, sy), (tx, ty)) in enumerate(zip(straight, diamond)) for c in ((lon + F.when(turned, tx).otherwise(sx)).alias(f"lon{i}"), (lat + F.when(turned, ty).otherwise(sy)).alias(f"lat{i}"))]
    return part.select(F.col("p_partkey").alias("building_id"), height.alias("height"), *corners)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, timestamp, tcc, ssrd): a reading for each hour and grid cell that holds a stay's start; ssrd is a running sum that starts
    anew each day."""
    at = stays(spark, sf_dir).select(F.floor((F.col("lon") + 74.0) * 100).alias("g"), F.floor(F.col("start_time") / 3600).alias("h")).distinct()
    return at.select(
        F.col("g").alias("grid"), (F.col("h") * 3600 + (F.col("h") * 7 % 5) * 60).alias("timestamp"),
        ((F.col("h") * 7 + F.col("g") * 3) % 100 / 100.0).alias("tcc"), ((F.col("h") % 24) * (F.lit(1000.0) + F.col("g")) * 3600).alias("ssrd"),
    )


WEATHER_SQL = """weather AS (SELECT g AS grid, h * 3600 + (h * 7 % 5) * 60 AS timestamp, ((h * 7 + g * 3) % 100) / 100.0E0 AS tcc, (h % 24) * (1000.0E0 + g) * 3600 AS ssrd
  FROM (SELECT DISTINCT CAST(floor((lon + 74.0E0) * 100) AS BIGINT) AS g, CAST(floor(start_time / 3600) AS BIGINT) AS h FROM stays))"""


#: Views as (base table, expressions that Spark and other engines both take). {epoch}: epoch second of ts; {iso}: its ISO text.
_LON, _LAT = "concat('-73.9', lpad(CAST((user_id * 37 + event_id * 7) % 9000 AS STRING), 4, '0'))", "concat('40.7', lpad(CAST((user_id * 53 + event_id * 11) % 9000 AS STRING), 4, '0'))"
VIEWS = {
    # rows as files hold them: text in every column, much of it missing or broken
    "raw_rows": ("events", [
        "event_id AS row_index", "concat('d', CAST(user_id % 3 AS STRING), '/u', CAST(user_id AS STRING), '/part.csv') AS file_relpath",
        "CASE WHEN event_id % 29 = 0 THEN ' ' WHEN event_id % 31 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING)) END AS ad_id",
        "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN concat(CAST({epoch} AS STRING), '.5') WHEN 3 THEN {iso} WHEN 4 THEN concat(' ', CAST({epoch} AS STRING), '000 ') WHEN 5 THEN '-5' ELSE CAST({epoch} AS STRING) END AS timestamp",
        "CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN substr({iso}, 1, 10) ELSE {iso} END AS time", "{iso} AS bucketStart",
        f"CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'n/a' ELSE {_LON} END AS fnl_lon", f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE {_LAT} END AS fnl_lat",
        f"CASE WHEN event_id % 2 = 0 THEN concat(' ', {_LON}) ELSE '' END AS gps_lon", f"CASE WHEN event_id % 11 = 0 THEN 'inf' ELSE {_LAT} END AS gps_lat",
        "'-73.95' AS stay_point_x", "CASE WHEN event_id % 6 = 0 THEN '' ELSE '40.75' END AS stay_point_y", f"{_LON} AS lng", f"CASE WHEN event_id % 17 = 0 THEN '' ELSE {_LAT} END AS lat",
        "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN 'yes' WHEN 4 THEN '2.5' WHEN 5 THEN 'No' WHEN 6 THEN NULL ELSE ' TRUE ' END AS stay_status",
        "concat('square:250:', CAST(user_id AS STRING), CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(':', CAST(event_id % 50 AS STRING)) END) AS cell_key",
        "CASE event_id % 5 WHEN 0 THEN 'night' WHEN 1 THEN 'fallback_error' WHEN 2 THEN 'error:weather' ELSE 'engine' END AS source",
        "concat('line', chr(13), chr(10), event_type, chr(10), repeat('x', CAST(event_id % 300 AS INT))) AS detail",
    ]),
    # light by row, as numbers
    "light_rows": ("events", [
        "event_id AS row_index", "concat('d', CAST(user_id % 3 AS STRING), '/u', CAST(user_id AS STRING), '.csv') AS file_relpath", "user_id AS ad_id", "{epoch} AS timestamp",
        "CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS sunlit", "CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id % 130) * 0.01E0 - 0.1E0 END AS cloud",
        "CASE WHEN event_id % 37 = 0 THEN NULL ELSE (event_id % 900) * 1.0E0 END AS irradiance", "1 + (event_id * 7) % 300 AS duration_s", "event_id % 41 = 0 AS indoor",
        "CASE WHEN event_id % 5 = 0 THEN 'night' WHEN event_id % 7 = 0 THEN 'indoor' ELSE 'engine' END AS source", "(event_id * 13) % 101 * 1.0E0 AS shadow_percent", "(event_id % 90) * 0.5E0 AS speed_kmh",
    ]),
    # footprints with what is known of them, much of it missing
    "known_buildings": ("part", [
        "p_partkey AS building_id", "concat('b', CAST(p_partkey AS STRING)) AS name", "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN 'tall' WHEN p_partkey % 21 = 0 THEN '-3' WHEN p_partkey % 25 = 0 THEN '900' ELSE CAST(p_size AS STRING) END AS height",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 30 END AS levels", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 31 % 9000) * 1.0E0 END AS area",
        "CASE p_partkey % 8 WHEN 0 THEN 'house' WHEN 1 THEN 'office' WHEN 2 THEN 'tower' WHEN 3 THEN 'school' WHEN 4 THEN 'shed' WHEN 5 THEN 'garage' WHEN 6 THEN 'retail' ELSE NULL END AS kind",
        "CASE p_partkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'ca' WHEN 2 THEN 'mx' ELSE NULL END AS region",
        "concat(CASE WHEN p_partkey % 2 = 0 THEN 'w' ELSE 'e' END, lpad(CAST(5 + p_partkey % 7 * 5 AS STRING), 3, '0'), '_n', lpad(CAST(5 + p_partkey % 9 * 5 AS STRING), 2, '0'), '_', CASE WHEN p_partkey % 2 = 0 THEN 'w' ELSE 'e' END, lpad(CAST(p_partkey % 7 * 5 AS STRING), 3, '0'), '_n', lpad(CAST(p_partkey % 9 * 5 AS STRING), 2, '0'), CASE WHEN p_partkey % 31 = 0 THEN 'x' ELSE '' END) AS tile_id",
        "p_retailprice AS created", "p_partkey % 256 AS r", "p_partkey * 7 % 256 AS g", "p_partkey * 11 % 256 AS b",
    ]),
    # a report row for each order: a person, a day, minutes
    "daily": ("orders", [
        "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS id", "o_orderkey % 1440 * 1.0E0 AS tracked_min", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 720 * 1.0E0 END AS tracked_min_daylight",
        "o_orderkey * 7 % 300 * 0.5E0 AS sunlight_min_cloud_daylight", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey * 3 % 400 * 0.5E0 END AS sunlight_min_geom_daylight", "o_orderkey % 101 * 1.0E0 AS sunlight_ratio_cloud_daylight",
    ]),
    # tracks of people: an order is a track
    "tracks": ("orders", [
        "o_orderkey AS track_id", "o_custkey % 40 AS user_id", "o_orderpriority AS activity", "o_orderkey % 5000 * 2.5E0 AS distance_m", "o_orderkey % 90 AS duration_min", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 100 * 1.0E0 END AS comfort",
        "o_orderdate AS created_at",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS."""
    table, columns = VIEWS[name]
    epoch, iso = "unix_timestamp(CAST(ts AS TIMESTAMP))", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(c.replace("{epoch}", epoch).replace("{iso}", iso) for c in columns))


def view_sql(name: str) -> str:
    """The view as a named part of a WITH clause."""
    table, columns = VIEWS[name]
    epoch, iso = "CAST(floor(epoch(ts)) AS BIGINT)", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
    return f"{name} AS (SELECT " + ", ".join(columns).replace("{epoch}", epoch).replace("{iso}", iso) + f" FROM {table})"
