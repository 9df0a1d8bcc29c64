"""Queries on buildings, light, weather and tracks, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import solar
from ..operators import light, tracks
from ..sources.views import STAYS_SQL, WEATHER_SQL, buildings, stays, weather

_ORDER = ("ad_id", ["timestamp", "row_index"])
_TRACK = STAYS_SQL + ", track AS (SELECT *, start_time AS timestamp FROM stays)"
_W = "OVER (PARTITION BY ad_id ORDER BY timestamp, row_index)"
_UNITS = "CAST(round_even(lon * 100000, 0) AS BIGINT) AS x, CAST(round_even(lat * 100000, 0) AS BIGINT) AS y"


def _track(spark, d):
    return stays(spark, d).withColumn("timestamp", F.col("start_time"))


def _points(spark, d):
    return light.to_units(_track(spark, d)).select("row_index", "timestamp", "lon", "lat", "x", "y")


def _buildings(spark, d):
    b = buildings(spark, d)
    whole = lambda c: F.rint(F.col(c) * light.UNITS).cast("long")
    return b.select("building_id", "height", F.array(*(F.struct(whole(f"lon{i}").alias("x"), whole(f"lat{i}").alias("y")) for i in range(4))).alias("ring"))


def _weathered(spark, d):
    p = _track(spark, d).withColumn("grid", F.floor((F.col("lon") + 74.0) * 100)).select("row_index", "timestamp", "grid")
    return light.nearest_in_time(p, weather(spark, d), "grid", "tcc")


def _spread(spark, d):
    """Points and buildings in six scenes, eight degrees of latitude apart, from 24 to 65 degrees north."""
    move = lambda k: (F.col(k) % 6 * 8 - 16.0)
    points = light.to_units(_track(spark, d).withColumn("lat", F.col("lat") + move("ad_id"))).select("row_index", "timestamp", "lon", "lat", "x", "y")
    up = (F.col("building_id") % 6 * 8 - 16) * light.UNITS
    return points, _buildings(spark, d).withColumn("ring", F.transform("ring", lambda p: F.struct(p.x.alias("x"), (p.y + up).alias("y"))))


QUERIES = {
    "join_point_shadow_latitudes": lambda s, d: light.shadowed(*_spread(s, d), max_height=60.0, plane=False),
    "fn_sun_position": lambda s, d: _track(s, d).select("row_index", F.round(F.expr(solar.altitude()), 6).alias("altitude"), F.round(F.expr(solar.azimuth()), 6).alias("azimuth")),
    "join_indoor": lambda s, d: light.indoor(_points(s, d), _buildings(s, d)),
    "join_point_shadow": lambda s, d: light.shadowed(_points(s, d), _buildings(s, d), max_height=60.0, plane=False),
    "join_weather_nearest": lambda s, d: _weathered(s, d),
    "fn_irradiance": lambda s, d: light.irradiance(weather(s, d).withColumn("ssrd", F.when(F.col("grid") == 3, F.col("timestamp") * 7919 % 5000).otherwise(F.col("ssrd"))), "grid").select("grid", "timestamp", F.round("watts", 6).alias("watts")),
    "win_segment_length": lambda s, d: tracks.long_segments(_track(s, d), *_ORDER, max_gap=21600, least_s=400).select("row_index", "segment", "segment_s"),
    "agg_clean_reasons": lambda s, d: tracks.clean(_track(s, d), *_ORDER, max_gap=86400, max_kmh=0.5, least_s=400).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    "win_stay_groups": lambda s, d: tracks.stay_groups(_track(s, d).withColumn("place", F.col("row_index") % 2), "ad_id", "place", ["timestamp", "row_index"]),
    "win_cumulative_distance": lambda s, d: tracks.with_distance(_track(s, d), *_ORDER).select("row_index", F.round("total_m", 4).alias("total_m")),
    "win_position_at_time": lambda s, d: tracks.position_at(_track(s, d), stays(s, d).select("ad_id", (F.col("end_time") + 3600).alias("at")), "ad_id"),
}

_PREV = f"lag(lon) {_W} AS lo, lag(lat) {_W} AS la"
_METRE = "2 * 6371000.0E0 * asin(sqrt(least(1.0E0 + 0 * (lat - la), pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2))))"
_STEPS = f"{_TRACK}, l AS (SELECT *, {_PREV} FROM track), steps AS (SELECT *, coalesce({_METRE}, 0.0E0) AS step_m FROM l)"
_BUILDINGS = """b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 12.0E0 ELSE CAST(p_size AS DOUBLE) END AS height,
  -74.0E0 + (p_partkey * 13 % 400) * 0.0001E0 AS lon, 40.7E0 + (p_partkey * 7 % 250) * 0.0001E0 AS lat, p_partkey % 2 AS turned FROM part),
corners AS (SELECT id, height, i, lon + CASE WHEN turned = 1 THEN [0.00012E0, 0E0, -0.00012E0, 0E0][i + 1] ELSE [0.0001E0, -0.0001E0, -0.0001E0, 0.0001E0][i + 1] END AS lon,
  lat + CASE WHEN turned = 1 THEN [0E0, 0.00008E0, 0E0, -0.00008E0][i + 1] ELSE [0.00006E0, 0.00006E0, -0.00006E0, -0.00006E0][i + 1] END AS lat FROM b, range(4) r(i)),
m AS (SELECT id, height, i, """ + _UNITS + """ FROM corners),
edges AS (SELECT p.id, p.height, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, c.x AS cx, c.y AS cy
  FROM m p JOIN m q ON p.id = q.id AND q.i = (p.i + 1) % 4 JOIN m c ON c.id = p.id AND c.i = 0)"""  # fmt: skip
_POINTS = f"{_TRACK}, points AS (SELECT row_index, timestamp, lon, lat, {_UNITS} FROM track)"
_TURN = "((x - ax) * (by_ - ay) - (bx - ax) * (y - ay))"
_CROSS = f"CASE WHEN (ay > y) <> (by_ > y) AND CASE WHEN by_ > ay THEN {_TURN} < 0 ELSE {_TURN} > 0 END THEN 1 ELSE 0 END"
_ON = f"{_TURN} = 0 AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, by_) AND greatest(ay, by_)"
_INDOOR = f"inside AS (SELECT row_index, id FROM points JOIN edges ON abs(x - cx) < 60 AND abs(y - cy) < 60 GROUP BY row_index, id HAVING sum({_CROSS}) % 2 = 1 OR bool_or({_ON}))"
_ALT = f"({solar.altitude()})"
_REACH = "abs(x - ax) < 40 + height * abs(ux) AND abs(y - ay) < 40 + height * abs(uy)"
mx = lambda y: f"(111320.0E0 * cos(radians((floor(({y}) / 5000.0E0) + 0.5E0) * 0.05E0)) / 100000)"
_MX, _MY = mx("y"), "(111320.0E0 / 100000)"
_WEATHER = WEATHER_SQL
_SEG = f"""sl AS (SELECT *, timestamp - lag(timestamp) {_W} AS dt FROM {{src}}),
s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt <= 0 OR dt > {{gap}} THEN 1 ELSE 0 END) {_W} AS seg FROM sl),
t AS (SELECT *, lead(timestamp) OVER (PARTITION BY ad_id, seg ORDER BY timestamp, row_index) - timestamp AS nxt FROM s),
u AS (SELECT *, sum(CASE WHEN nxt IS NULL THEN 60 ELSE greatest(1, least(nxt, 300)) END) OVER (PARTITION BY ad_id, seg) AS segment_s FROM t)"""
_SHADOW = f"""{_POINTS}, {_BUILDINGS}, {_INDOOR}, sun AS MATERIALIZED (SELECT *, {_ALT} AS alt, {solar.azimuth()} AS az FROM points),
      up AS MATERIALIZED (SELECT *, sin(az) / tan(alt) / {_MX} AS ux, cos(az) / tan(alt) / {_MY} AS uy FROM sun WHERE alt > radians(5)),
      near AS (SELECT *, (bx - ax) * height * uy - (by_ - ay) * height * ux AS det FROM up JOIN edges ON {_REACH}),
      hit AS (SELECT DISTINCT row_index FROM near WHERE det <> 0 AND ((x - ax) * height * uy - (y - ay) * height * ux) / det BETWEEN 0 AND 1
        AND ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / det BETWEEN 0 AND 1),
      shadow AS MATERIALIZED (SELECT row_index, alt > radians(5) AS lit, alt > radians(5) AND (row_index IN (FROM hit) OR row_index IN (SELECT row_index FROM inside)) AS in_shadow FROM sun)"""

_FAR_POINTS = f"{_TRACK}, points AS (SELECT row_index, timestamp, lon, lat, {_UNITS} FROM (SELECT * REPLACE (lat + (ad_id % 6 * 8 - 16.0E0) AS lat) FROM track))"
_FAR_EDGES = "edges AS (SELECT id, height, ax, ay + up AS ay, bx, by_ + up AS by_, cx, cy + up AS cy FROM (SELECT *, (id % 6 * 8 - 16) * 100000 AS up FROM edges_here))"
_FAR = _SHADOW.replace(_POINTS, _FAR_POINTS, 1).replace("edges AS (SELECT p.id", "edges_here AS (SELECT p.id", 1).replace(f", {_INDOOR}", f", {_FAR_EDGES}, {_INDOOR}", 1)

SQL = {
    "join_point_shadow_latitudes": f"WITH {_FAR} SELECT row_index, lit, in_shadow FROM shadow",
    "fn_sun_position": f"WITH {_TRACK} SELECT row_index, round({solar.altitude()}, 6) AS altitude, round({solar.azimuth()}, 6) AS azimuth FROM track",
    "join_indoor": f"WITH {_POINTS}, {_BUILDINGS}, {_INDOOR} SELECT row_index, id AS building_id FROM inside",
    "join_point_shadow": f"WITH {_SHADOW} SELECT row_index, lit, in_shadow FROM shadow",
    "join_weather_nearest": f"""WITH {_TRACK}, {_WEATHER}, p AS (SELECT row_index, timestamp, CAST(floor((lon + 74.0E0) * 100) AS BIGINT) AS grid FROM track)
      SELECT p.row_index, p.timestamp, p.grid, w.tcc FROM p LEFT JOIN weather w ON p.grid = w.grid AND abs(w.timestamp - p.timestamp) <= 86400
      QUALIFY row_number() OVER (PARTITION BY p.row_index ORDER BY abs(w.timestamp - p.timestamp), w.timestamp) = 1""",
    "fn_irradiance": f"""WITH {STAYS_SQL}, {_WEATHER}, r AS (SELECT * REPLACE (CASE WHEN grid = 3 THEN timestamp * 7919 % 5000 ELSE ssrd END AS ssrd) FROM weather),
      l AS (SELECT *, ssrd - lag(ssrd) OVER w AS step, timestamp - lag(timestamp) OVER w AS dt FROM r WINDOW w AS (PARTITION BY grid ORDER BY timestamp)),
      modes AS (SELECT grid, count(*) >= 10 AND count(*) FILTER (step < -1e-3) / (count(*) - 1) > 0.2 AS own FROM l GROUP BY grid)
      SELECT grid, timestamp, CASE WHEN dt IS NOT NULL THEN round(greatest(0.0E0, CASE WHEN own OR step < 0 THEN ssrd ELSE step END / dt), 6) END AS watts FROM l JOIN modes USING (grid)""",
    "win_segment_length": f"""WITH {_TRACK}, {_SEG.format(src="track", gap=21600)}
      SELECT row_index, dense_rank() OVER (PARTITION BY ad_id ORDER BY seg) AS segment, CAST(segment_s AS BIGINT) AS segment_s FROM u WHERE segment_s >= 400""",
    "agg_clean_reasons": f"""WITH {_STEPS}, sp AS (SELECT *, timestamp - lag(timestamp) {_W} AS gap FROM steps),
      j AS (SELECT *, coalesce(CASE WHEN gap > 0 AND gap <= 86400 THEN step_m / gap * 3.6E0 END > 0.5, false) AS jump FROM sp),
      calm AS (SELECT ad_id, row_index, timestamp FROM j WHERE NOT jump), {_SEG.format(src="calm", gap=86400)},
      r AS (SELECT CASE WHEN jump THEN 'jump_speed' WHEN row_index IN (SELECT row_index FROM u WHERE segment_s >= 400) THEN 'kept' ELSE 'short_segment' END AS reason FROM j)
      SELECT reason, count(*) AS n FROM r GROUP BY ALL""",
    "win_stay_groups": f"""WITH {_TRACK}, k AS (SELECT *, row_index % 2 AS place FROM track), f AS (SELECT *, CASE WHEN lag(place) {_W} = place THEN 0 ELSE 1 END AS new FROM k),
      g AS (SELECT *, CAST(sum(new) {_W} AS BIGINT) AS grp FROM f) SELECT ad_id, place, grp, min(timestamp) AS start_ts, max(timestamp) AS end_ts, count(*) AS n FROM g GROUP BY ad_id, place, grp""",
    "win_cumulative_distance": f"WITH {_STEPS} SELECT row_index, round(sum(step_m) {_W}, 4) AS total_m FROM steps",
    "win_position_at_time": f"""WITH {_TRACK}, q AS (SELECT DISTINCT ad_id, end_time + 3600 AS at FROM stays),
      ahead AS (SELECT q.ad_id, q.at, row_index FROM q JOIN track t ON t.ad_id = q.ad_id AND t.timestamp >= q.at QUALIFY row_number() OVER (PARTITION BY q.ad_id, q.at ORDER BY timestamp, row_index) = 1),
      final AS (SELECT ad_id, row_index FROM track QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY timestamp DESC, row_index DESC) = 1)
      SELECT q.ad_id, q.at, coalesce(a.row_index, f.row_index) AS row_index FROM q LEFT JOIN ahead a ON a.ad_id = q.ad_id AND a.at = q.at JOIN final f ON f.ad_id = q.ad_id""",
}
