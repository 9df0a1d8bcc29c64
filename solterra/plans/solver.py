"""Queries of the solver: reach, partitions, coverage, profiles and whole chains; and SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..checkpoints import fresh
from ..functions import solar
from ..operators import exposure as x
from ..operators import areas, daylight, light, tracks
from ..operators import graph as gr
from ..operators import mobility as m
from ..operators import solver as solving
from ..sources.views import stays, weather
from .exposure import _EXPOSED, exposed
from .files import BOX, boxed
from .light import _BUILDINGS, _CROSS, _MX, _MY, _ON, _POINTS, _SEG, _SHADOW, _STEPS, _W, _WEATHER, _buildings, _points, mx
from .mobility import _DURATION, _ORDER, _TRACK, _track
from .mobility import _POINTS as _KEYED

QUERIES, SQL = {}, {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


_BOX = "box AS (SELECT id, height, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m GROUP BY 1, 2)"
_INSIDE = _SHADOW.split(", sun AS MATERIALIZED", 1)[0]
_GRIDDED = lambda s, d: _track(s, d).withColumn("grid", F.floor((F.col("lon") + 74.0) * 100)).select("row_index", "timestamp", "grid")
add("join_weather_hour_bucket", lambda s, d: light.nearest_by_hour(_GRIDDED(s, d), weather(s, d), "grid", "tcc").select("row_index", "tcc"),
    f"""WITH {_TRACK}, {_WEATHER}, p AS (SELECT row_index, CAST(floor(timestamp / 3600) * 3600 AS BIGINT) AS h, CAST(floor((lon + 74.0E0) * 100) AS BIGINT) AS grid FROM track)
      SELECT row_index, w.tcc FROM p LEFT JOIN weather w ON p.grid = w.grid AND abs(w.timestamp - h) <= 86400 QUALIFY row_number() OVER (PARTITION BY row_index ORDER BY abs(w.timestamp - h), w.timestamp) = 1""")
_targets = lambda s, d: light.with_sun(_points(s, d)).select(F.col("row_index").alias("task_id"), F.col("x").alias("x0"), (F.col("x") + 20).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 20).alias("y1"), F.col("alt").alias("elevation"))
_flat = lambda s, d: _buildings(s, d).select("building_id", "height", *light.ring_bounds("ring"))
add("join_reach", lambda s, d: light.within_reach(_targets(s, d), _flat(s, d), 30.0),
    f"""WITH {_POINTS}, {_BUILDINGS}, {_BOX}, t AS MATERIALIZED (SELECT row_index AS task_id, x, y, {mx('y + 10')} AS mx, {solar.altitude()} AS e FROM points) SELECT task_id, id AS building_id FROM t JOIN box ON e > 0
      AND sqrt(pow(greatest(0.0E0, greatest(x0 - (x + 20), x - x1) * mx), 2) + pow(greatest(0.0E0, greatest(y0 - (y + 20), y - y1) * {_MY}), 2)) <= height / tan(e) + 30.0""")


def _by_partition(s, d):
    path, cell = fresh(s, "cells"), 500
    b = _buildings(s, d).select("building_id", "height", "ring", *light.ring_bounds("ring"))
    over = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(z) / cell)))
    b.withColumn("px", over("x0", "x1")).withColumn("py", over("y0", "y1")).select("building_id", "ring", "px", "py").write.partitionBy("px", "py").parquet(path)
    stored = s.read.schema("building_id long, ring array<struct<x:long,y:long>>, px long, py long").parquet(path)
    return light.indoor_by_partition(_points(s, d), stored, cell)


add("join_indoor_partition_file", _by_partition, f"WITH {_INSIDE} SELECT row_index, id AS building_id FROM inside")
add("fn_point_in_ring", lambda s, d: light.indoor_counts(_points(s, d), _buildings(s, d), 250.0), f"WITH {_INSIDE} SELECT row_index, count(*) AS rings, min(id) AS first FROM inside GROUP BY 1")


def _holed(s, d):
    b = _buildings(s, d)
    mid = lambda c: F.floor((F.array_min(F.transform("ring", lambda p: p[c])) + F.array_max(F.transform("ring", lambda p: p[c]))) / 2)
    b = b.withColumn("cx", mid("x")).withColumn("cy", mid("y"))
    hole = F.array(*(F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y")) for i, j in ((-3, -3), (3, -3), (3, 3), (-3, 3))))
    return b.select("building_id", light.polygon_edges(F.array("ring", hole)).alias("edges"), *light.ring_bounds("ring"))


def _in_holed(s, d):
    return light.within_shapes(_points(s, d), _holed(s, d))


add("join_point_shadow_ring", _in_holed,
    f"""WITH {_POINTS}, {_BUILDINGS}, {_BOX}, c AS (SELECT id, CAST(floor((x0 + x1) / 2) AS BIGINT) AS mx, CAST(floor((y0 + y1) / 2) AS BIGINT) AS my FROM box),
      hole AS (SELECT id, mx + ax AS ax, my + ay AS ay, mx + bx AS bx, my + by_ AS by_ FROM c, (VALUES (-3, -3, 3, -3), (3, -3, 3, 3), (3, 3, -3, 3), (-3, 3, -3, -3)) v(ax, ay, bx, by_)),
      every AS (SELECT id, ax, ay, bx, by_ FROM edges UNION ALL SELECT * FROM hole), near AS (SELECT row_index, x, y, c.id FROM points JOIN c ON abs(x - mx) < 60 AND abs(y - my) < 60)
      SELECT row_index, id AS building_id FROM near JOIN every USING (id) GROUP BY row_index, id HAVING sum({_CROSS}) % 2 = 1 OR bool_or({_ON})""")
_POLY = [(-7399500, 4071000), (-7398300, 4070200), (-7397500, 4071200), (-7398600, 4071900)]
_S = lambda ax, ay, bx, by, x_, y_: f"(({x_} - {ax}) * ({by} - {ay}) - ({bx} - {ax}) * ({y_} - {ay}))"
_E, _P = ("ax", "ay", "bx", "by_"), ("px", "py", "qx", "qy")
_C2 = lambda e, x_, y_: f"CASE WHEN ({e[1]} > {y_}) <> ({e[3]} > {y_}) AND CASE WHEN {e[3]} > {e[1]} THEN {_S(*e, x_, y_)} < 0 ELSE {_S(*e, x_, y_)} > 0 END THEN 1 ELSE 0 END"
_O2 = lambda e, x_, y_: f"({_S(*e, x_, y_)} = 0 AND {x_} BETWEEN least({e[0]}, {e[2]}) AND greatest({e[0]}, {e[2]}) AND {y_} BETWEEN least({e[1]}, {e[3]}) AND greatest({e[1]}, {e[3]}))"


def _touching(polygon):
    """SQL for the buildings that share a point with the polygon."""
    sides = ", ".join(f"({a[0]}::BIGINT, {a[1]}::BIGINT, {b[0]}::BIGINT, {b[1]}::BIGINT)" for a, b in zip(polygon, polygon[1:] + polygon[:1]))
    return f"""WITH {_BUILDINGS}, pe AS (SELECT * FROM (VALUES {sides}) v(px, py, qx, qy)), vin AS (SELECT id FROM edges, pe GROUP BY id, ax, ay HAVING sum({_C2(_P, 'ax', 'ay')}) % 2 = 1 OR bool_or({_O2(_P, 'ax', 'ay')})),
      cin AS (SELECT id FROM edges, pe GROUP BY id, px, py HAVING sum({_C2(_E, 'px', 'py')}) % 2 = 1 OR bool_or({_O2(_E, 'px', 'py')})),
      cr AS (SELECT id FROM edges, pe WHERE {_S(*_E, 'px', 'py')} * {_S(*_E, 'qx', 'qy')} < 0 AND {_S(*_P, 'ax', 'ay')} * {_S(*_P, 'bx', 'by_')} < 0) SELECT id AS building_id FROM vin UNION SELECT id FROM cin UNION SELECT id FROM cr"""


add("flt_geometry_intersects", lambda s, d: light.touches_polygon(_buildings(s, d), _POLY).select("building_id"), _touching(_POLY))
_WEST, _SOUTH, _EAST, _NORTH = BOX
_CORNERS = [(_WEST, _SOUTH), (_EAST, _SOUTH), (_EAST, _NORTH), (_WEST, _NORTH)]
add("flt_bbox_geom", lambda s, d: light.touches_polygon(boxed(s, d).select("building_id").join(_buildings(s, d).select("building_id", "ring"), "building_id"), _CORNERS).select("building_id"), _touching(_CORNERS))
# Four spots around each building, at four instants of a day.
_spots = lambda s, d: (
    _flat(s, d).select(F.col("building_id").alias("place"), "x0", "y0", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    .select((F.col("place") * 16 + F.col("k")).alias("row_index"), "place", F.floor(F.col("k") / 4).alias("spot"), (F.lit(1718971200) + F.col("k") % 4 * 7200).alias("timestamp"),
            (F.col("x0") - 12 + F.floor(F.col("k") / 4) % 2 * 44).alias("x"), (F.col("y0") - 12 + F.floor(F.col("k") / 8) * 36).alias("y"))
    .withColumn("lon", F.col("x") / 100000).withColumn("lat", F.col("y") / 100000)
)
_SPOTS = f"""{_BUILDINGS}, {_BOX}, spots AS (SELECT id * 16 + k AS row_index, id AS place, CAST(floor(k / 4) AS BIGINT) AS spot, 1718971200 + k % 4 * 7200 AS timestamp,
    x0 - 12 + CAST(floor(k / 4) AS BIGINT) % 2 * 44 AS x, y0 - 12 + CAST(floor(k / 8) AS BIGINT) * 36 AS y FROM box, range(16) t(k)), points AS (SELECT *, x / 100000.0E0 AS lon, y / 100000.0E0 AS lat FROM spots)"""
_AFTER = _SHADOW.split(_BUILDINGS + ", ", 1)[1]
_lit = lambda s, d: light.with_shadow(_spots(s, d), _buildings(s, d), max_height=60.0, plane=False)
BLOCK, TILE = 500, 100


def _covered(s, d):
    """How much of each block of ground where a building begins lies in shadow or under roofs, at four instants."""
    b = light.tallest(_buildings(s, d)).select("building_id", "height", "ring", F.explode(F.array(*(F.lit(1718971200 + k * 7200) for k in range(4)))).alias("timestamp"))
    at = F.col("ring")[0]
    b = b.withColumns({"lon": at.x / 100000, "lat": at.y / 100000}).withColumns({"alt": F.expr(solar.altitude()), "az": F.expr(solar.azimuth()), "east": light.east_metres(light.frame_of(at.y))})
    length = F.col("height") / F.tan("alt")
    rings = b.where(F.col("alt") > F.radians(F.lit(5))).select("timestamp", F.explode(areas.shadow_rings(F.col("ring"), length * F.sin("az") / F.col("east"), length * F.cos("az") / light.NORTH_M)).alias("ring"))
    block = lambda c: F.floor(F.col(c) / (BLOCK / TILE))
    covered = areas.union_area(rings, ["timestamp"], TILE).groupBy("timestamp", block("tx").alias("block_x"), block("ty").alias("block_y")).agg(F.sum("area").alias("area"))
    blocks = b.select("timestamp", F.floor(at.x / BLOCK).alias("block_x"), F.floor(at.y / BLOCK).alias("block_y")).distinct()
    metres = light.east_metres(light.frame_of((F.col("block_y") + 0.5) * BLOCK)) * light.NORTH_M
    share = F.coalesce("area", F.lit(0.0))
    return blocks.join(covered, ["timestamp", "block_x", "block_y"], "left").select("timestamp", "block_x", "block_y", F.round(share * metres, 2).alias("covered_m2"), F.round(share / BLOCK**2 * 100, 6).alias("coverage"))


_MBLOCK = mx("(by_ + 0.5E0) * 500")
add("agg_coverage", _covered,
    f"""WITH {_BUILDINGS}, begun AS (SELECT id, height, cx, cy, 1718971200 + k * 7200 AS timestamp FROM (SELECT DISTINCT id, height, cx, cy FROM edges), range(4) r(k)),
      sun AS MATERIALIZED (SELECT *, {solar.altitude(lon="(cx / 100000.0E0)", lat="(cy / 100000.0E0)")} AS alt, {solar.azimuth(lon="(cx / 100000.0E0)", lat="(cy / 100000.0E0)")} AS az FROM begun),
      moved AS (SELECT *, height / tan(alt) * sin(az) / {mx("cy")} AS dx, height / tan(alt) * cos(az) / {_MY} AS dy FROM sun WHERE alt > radians(5)),
      w AS (SELECT timestamp, e.id, row_number() OVER (PARTITION BY timestamp, e.id ORDER BY ax, ay) AS k, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, by_::DOUBLE AS by_, dx, dy FROM edges e JOIN moved USING (id)),
      sides AS (SELECT timestamp, id, 0 AS k, ax, ay, bx, by_ FROM w UNION ALL SELECT timestamp, id, k, ax, ay, bx, by_ FROM w UNION ALL SELECT timestamp, id, k, bx, by_, bx + dx, by_ + dy FROM w
        UNION ALL SELECT timestamp, id, k, bx + dx, by_ + dy, ax + dx, ay + dy FROM w UNION ALL SELECT timestamp, id, k, ax + dx, ay + dy, ax, ay FROM w),
      poly AS (SELECT timestamp, id, k, min(least(ax, bx)) AS x0, max(greatest(ax, bx)) AS x1, min(least(ay, by_)) AS y0, max(greatest(ay, by_)) AS y1 FROM sides GROUP BY ALL),
      tiled AS (SELECT timestamp, id, k, tx, unnest(range(CAST(floor(y0 / 100) AS BIGINT), CAST(floor(y1 / 100) AS BIGINT) + 1)) AS ty FROM (SELECT *, unnest(range(CAST(floor(x0 / 100) AS BIGINT), CAST(floor(x1 / 100) AS BIGINT) + 1)) AS tx FROM poly)),
      e AS MATERIALIZED (SELECT timestamp, tx, ty, id, k, CASE WHEN ax < bx THEN ax ELSE bx END - tx * 100 AS ax, CASE WHEN ax < bx THEN ay ELSE by_ END - ty * 100 AS ay, CASE WHEN ax < bx THEN bx ELSE ax END - tx * 100 AS bx, CASE WHEN ax < bx THEN by_ ELSE ay END - ty * 100 AS by_
        FROM tiled JOIN sides USING (timestamp, id, k) WHERE ax <> bx AND least(ax, bx) <= tx * 100 + 100 AND greatest(ax, bx) >= tx * 100),
      s AS MATERIALIZED (SELECT *, (by_ - ay) / (bx - ax) AS m FROM e), u AS MATERIALIZED (SELECT DISTINCT timestamp, tx, ty, ax, ay, bx, by_, m FROM s),
      cuts AS (SELECT timestamp, tx, ty, ax AS x FROM u UNION SELECT timestamp, tx, ty, bx FROM u UNION SELECT timestamp, tx, ty, 0.0 FROM u UNION SELECT timestamp, tx, ty, 100.0 FROM u
        UNION SELECT timestamp, tx, ty, ax + (y - ay) / m FROM u, (VALUES (0.0E0), (100.0E0)) v(y) WHERE m <> 0
        UNION SELECT timestamp, tx, ty, (q.ay - q.m * q.ax - p.ay + p.m * p.ax) / (p.m - q.m) FROM u p JOIN u q USING (timestamp, tx, ty) WHERE p.m > q.m AND p.ax < q.bx AND q.ax < p.bx),
      slabs AS (SELECT timestamp, tx, ty, x, lead(x) OVER (PARTITION BY timestamp, tx, ty ORDER BY x) AS x2 FROM cuts WHERE x BETWEEN 0 AND 100),
      runs AS (SELECT timestamp, tx, ty, x, x2, id, k, greatest(0.0, min(ay + m * ((x + x2) / 2 - ax))) AS lo, least(100.0, max(ay + m * ((x + x2) / 2 - ax))) AS hi FROM slabs JOIN s USING (timestamp, tx, ty) WHERE x2 > x AND (x + x2) / 2 BETWEEN ax AND bx GROUP BY ALL),
      r2 AS (SELECT *, max(hi) OVER (PARTITION BY timestamp, tx, ty, x ORDER BY lo, hi, id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM runs WHERE hi > lo),
      area AS (SELECT timestamp, CAST(floor(tx / 5) AS BIGINT) AS bx, CAST(floor(ty / 5) AS BIGINT) AS by_, sum((x2 - x) * greatest(0.0, hi - greatest(lo, coalesce(upto, lo)))) AS area FROM r2 GROUP BY ALL),
      blocks AS (SELECT DISTINCT timestamp, CAST(floor(cx / 500) AS BIGINT) AS bx, CAST(floor(cy / 500) AS BIGINT) AS by_ FROM begun)
      SELECT timestamp, bx AS block_x, by_ AS block_y, round(coalesce(area, 0.0) * {_MBLOCK} * {_MY}, 2) AS covered_m2, round(coalesce(area, 0.0) / 250000 * 100, 6) AS coverage FROM blocks LEFT JOIN area USING (timestamp, bx, by_)""")
add("agg_sun_profile", lambda s, d: light.sun_profile(_lit(s, d), ["place", "spot"], 7200), f"WITH {_SPOTS}, {_AFTER} SELECT place, spot, count(*) FILTER (lit AND NOT in_shadow) * 7200 / 60 AS sun_min FROM points JOIN shadow USING (row_index) GROUP BY 1, 2")
add("fn_shadow_wall", lambda s, d: _lit(s, d).select("row_index", "lit", "in_shadow"), f"WITH {_SPOTS}, {_AFTER} SELECT row_index, lit, in_shadow FROM shadow")
add("pipe_sunlight_cell_minute", lambda s, d: m.named(m.with_cell(exposed(s, d)).withColumn("minute_ts", F.floor(F.col("timestamp") / 60) * 60)).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.sum("sunlit").alias("sunlit"), F.round(F.sum("sunlight_s"), 6).alias("sunlight_s"), F.round(F.sum("irradiance_j"), 4).alias("irradiance_j")),
    f"""WITH {_EXPOSED}, c AS (SELECT e.*, concat(CAST(floor(e.timestamp / 60) * 60 AS BIGINT), '|square:250:', CAST(floor(radians(lon) * 6378137.0E0 / 250.0E0) AS BIGINT), ':', CAST(floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0E0 / 250.0E0) AS BIGINT)) AS task_id FROM exposed e JOIN points USING (row_index))
      SELECT task_id, count(*) AS n, CAST(sum(sunlit) AS BIGINT) AS sunlit, round(sum(sunlit_effective * duration_s), 6) AS sunlight_s, round(sum(greatest(coalesce(irradiance_effective, 0.0), 0.0) * duration_s), 4) AS irradiance_j FROM c GROUP BY 1""")
def _lit_points(s, d):
    """The lit instants of stays with their cell: spans first, then their minutes."""
    spans = daylight.lit_spans(m.with_cell(stays(s, d)).select("file_relpath", "cell_x", "cell_y", "start_time", "end_time", "lon", "lat"))
    at = spans.withColumn("timestamp", F.explode(F.sequence(F.col("start_ts"), F.col("end_ts"), F.lit(60).cast("long"))))
    return at.withColumn("minute_ts", F.floor(F.col("timestamp") / 60) * 60)


add("pipe_task_graph_stays", lambda s, d: m.task_stats(_lit_points(s, d)), f"WITH {_KEYED}, day AS (SELECT * FROM keyed WHERE {solar.altitude()} > 0) SELECT task_id, minute_ts, cell_key, count(*) AS point_count, count(DISTINCT file_relpath) AS file_count, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM day GROUP BY ALL")


def _row_tasks(s, d):
    inside = light.covered_spots(_points(s, d), _buildings(s, d))
    out = x.daylight(light.to_units(_track(s, d)).join(inside, ["x", "y"], "left_anti"))
    return m.task_stats(m.with_cell(out).withColumn("minute_ts", F.floor(F.col("timestamp") / 60) * 60)).select("task_id", "point_count", "file_count")


_CELLKEY = "concat(CAST(floor(timestamp / 60) * 60 AS BIGINT), '|square:250:', CAST(floor(radians(lon) * 6378137.0E0 / 250.0E0) AS BIGINT), ':', CAST(floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0E0 / 250.0E0) AS BIGINT))"
add("pipe_task_graph_rows", _row_tasks, f"WITH {_INSIDE}, o AS (SELECT *, {_CELLKEY} AS task_id FROM track WHERE row_index NOT IN (SELECT row_index FROM inside) AND {solar.altitude()} > 0) SELECT task_id, count(*) AS point_count, count(DISTINCT file_relpath) AS file_count FROM o GROUP BY 1")


def _cache(s, d):
    """The points of every task, those indoors left out."""
    points = m.with_cell(light.to_units(_track(s, d))).withColumn("minute_ts", F.floor(F.col("timestamp") / 60) * 60)
    chosen = m.named(m.cells(points).withColumns({f"k{c}": F.col(c) for c in ("cell_x", "cell_y")})).select("task_id", "minute_ts", F.col("kcell_x").alias("cell_x"), F.col("kcell_y").alias("cell_y"))
    inside = light.covered_spots(_points(s, d), _buildings(s, d))
    return gr.points_of(points, chosen, m.KEYS).join(inside, ["x", "y"], "left_anti")


_CACHE = f"keyed AS (SELECT *, {_CELLKEY} AS task_id FROM track), cache AS (SELECT keyed.* FROM keyed WHERE row_index NOT IN (SELECT row_index FROM inside))"
add("pipe_point_cache", lambda s, d: _cache(s, d).select("task_id", "row_index"), f"WITH {_INSIDE}, {_CACHE} SELECT task_id, row_index FROM cache")


def _solved(s, d):
    """Every task's points, the tasks cut into units of forty points and sixty obstacles at most where that can be."""
    points = _cache(s, d).select("task_id", "row_index", "timestamp", "lon", "lat", "x", "y")
    houses = light.tallest(_buildings(s, d))  # what a lower one on the same ground can shade the highest shades
    parts, _, pairs = solving.execution_units(points, houses, most_points=40, most_obstacles=60, least=1, levels=6)
    return solving.solve(parts, pairs, houses, math.radians(5))


add("pipe_exact_solver", _solved, f"WITH {_SHADOW}, {_CACHE} SELECT task_id, row_index, CAST(lit AND NOT in_shadow AS INTEGER) AS sunlit FROM cache JOIN shadow USING (row_index)")
_clean = lambda s, d: tracks.cleaned(_track(s, d), *_ORDER, max_gap=86400, max_kmh=0.5, least_s=400)
_CLEAN = f"""{_STEPS}, sp AS (SELECT *, timestamp - lag(timestamp) {_W} AS gap FROM steps), j AS (SELECT *, coalesce(CASE WHEN gap > 0 AND gap <= 86400 THEN step_m / gap * 3.6E0 END > 0.5, false) AS jump FROM sp),
  calm AS (SELECT ad_id, row_index, timestamp FROM j WHERE NOT jump), {_SEG.format(src="calm", gap=86400)}, k AS (SELECT row_index, dense_rank() OVER (PARTITION BY ad_id ORDER BY seg) AS segment FROM u WHERE segment_s >= 400), {_DURATION},
  r AS (SELECT j.ad_id, j.row_index, CASE WHEN jump THEN 'jump_speed' WHEN k.segment IS NOT NULL THEN 'kept' ELSE 'short_segment' END AS reason, k.segment, duration_s FROM j LEFT JOIN k USING (row_index) JOIN track2 USING (row_index))"""
add("pipe_clean", lambda s, d: _clean(s, d).select("row_index", "reason", "segment"), f"WITH {_CLEAN} SELECT row_index, reason, segment FROM r")
add("agg_clean_seconds", lambda s, d: _clean(s, d).agg(F.sum(F.when(F.col("reason") == "kept", F.col("duration_s"))).alias("kept_s"), F.sum(F.when(F.col("reason") != "kept", F.col("duration_s"))).alias("dropped_s")),
    f"WITH {_CLEAN} SELECT CAST(sum(duration_s) FILTER (reason = 'kept') AS BIGINT) AS kept_s, CAST(sum(duration_s) FILTER (reason <> 'kept') AS BIGINT) AS dropped_s FROM r")
