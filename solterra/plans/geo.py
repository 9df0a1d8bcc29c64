"""Queries on positions, boxes, tiles, footprints, features and rasters; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions.text import number
from ..operators import light, shapes
from ..sources.views import STAYS_SQL, buildings, stays, view, view_sql
from .light import _BUILDINGS, _UNITS, _buildings
from .rows import num

QUERIES, SQL = {}, {}


def add(name: str, source: str, columns, sql: str) -> None:
    """A query: what ``columns`` makes of a view or of the stays; sql reads it by its name."""
    QUERIES[name] = lambda s, d: columns(stays(s, d) if source == "stays" else view(s, d, source))
    SQL[name] = f"WITH {STAYS_SQL if source == 'stays' else view_sql(source)} {sql}"


def rounded(names: str, columns, digits: int = 9) -> list:
    return [F.round(c, digits).alias(n) for n, c in zip(names.split(), columns)]


_C = lambda names: tuple(map(F.col, names.split()))
_NEXT = "lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2"
_W = "WINDOW w AS (PARTITION BY ad_id ORDER BY start_time, row_index)"


def _steps(v):
    w = Window.partitionBy("ad_id").orderBy("start_time", "row_index")
    return v.withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.lead("lat").over(w)).where("lon2 is not null")


_STEPS = f"steps AS (SELECT * FROM (SELECT *, {_NEXT} FROM stays {_W}) WHERE lon2 IS NOT NULL)"
_EQ = "sqrt(pow((lon2 - lon) * 111320.0E0 * cos(radians((lat + lat2) / 2)), 2) + pow((lat2 - lat) * 111320.0E0, 2))"
add("fn_equirect_distance", "stays", lambda v: _steps(v).select("row_index", *rounded("metres", [g.equirect_m(*_C("lon lat lon2 lat2"))], 6)), f", {_STEPS} SELECT row_index, round({_EQ}, 6) AS metres FROM steps")
_HAV = "2 * 6371000.0E0 * asin(sqrt(least(1.0E0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"
add("fn_haversine", "stays", lambda v: _steps(v).select("row_index", *rounded("metres", [g.haversine_m(*_C("lon lat lon2 lat2"))], 6)), f", {_STEPS} SELECT row_index, round({_HAV}, 6) AS metres FROM steps")
add("win_segments_pairwise", "stays", lambda v: _steps(v).select("ad_id", "row_index", "lon", "lat", "lon2", "lat2"), f", {_STEPS} SELECT ad_id, row_index, lon, lat, lon2, lat2 FROM steps")
add("fn_dashify", "stays", lambda v: _steps(v).select("row_index", F.posexplode(g.dashes(*_C("lon lat lon2 lat2"), 300.0, 200.0)).alias("dash", "p")).select("row_index", F.col("dash").cast("long"), *rounded("x0 y0 x1 y1", [F.col(f"p.{c}") for c in ("x0", "y0", "x1", "y1")])),
    f", {_STEPS}, m AS (SELECT *, {_EQ} AS total FROM steps), d AS (SELECT *, unnest(CASE WHEN total < 375 OR total IS NULL THEN [0] ELSE range(CAST(ceil(total / 500) AS BIGINT)) END) AS dash FROM m),"
    " t AS (SELECT *, CASE WHEN total < 375 THEN 0.0 ELSE dash * 500.0E0 / total END AS a, CASE WHEN total < 375 THEN 1.0 ELSE least(dash * 500.0E0 + 300, total) / total END AS b FROM d)"
    " SELECT row_index, CAST(dash AS BIGINT) AS dash, round(lon + (lon2 - lon) * a, 9) AS x0, round(lat + (lat2 - lat) * a, 9) AS y0, round(lon + (lon2 - lon) * b, 9) AS x1, round(lat + (lat2 - lat) * b, 9) AS y1 FROM t")
_CELL = "CAST(floor(radians(lon) * 6378137.0E0 / 250.0E0) AS BIGINT) AS cx, CAST(floor(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0E0 / 250.0E0) AS BIGINT) AS cy"
add("fn_mercator_cell", "stays", lambda v: v.select("row_index", *(c.alias(n) for c, n in zip(g.mercator_cell(*_C("lon lat"), 250.0), ("cx", "cy")))), f"SELECT row_index, {_CELL} FROM stays")
add("fn_mercator_cell_bounds", "stays", lambda v: v.select(*(c.alias(n) for c, n in zip(g.mercator_cell(*_C("lon lat"), 250.0), ("cx", "cy")))).distinct().select("cx", "cy", *rounded("west south east north", g.mercator_cell_bounds(*_C("cx cy"), 250.0))),
    f", c AS (SELECT DISTINCT {_CELL} FROM stays) SELECT cx, cy, round(degrees(cx * 250.0E0 / 6378137.0E0), 9) AS west, round(degrees(2 * atan(exp(cy * 250.0E0 / 6378137.0E0)) - pi() / 2), 9) AS south,"
    " round(degrees((cx + 1) * 250.0E0 / 6378137.0E0), 9) AS east, round(degrees(2 * atan(exp((cy + 1) * 250.0E0 / 6378137.0E0)) - pi() / 2), 9) AS north FROM c")
add("fn_cell_roundup", "known_buildings", lambda v: v.select("building_id", g.cell_roundup(F.col("building_id") % 7 + 1, F.col("building_id") % 50 - 5).alias("cell")),
    "SELECT building_id, CASE WHEN w <= 0 THEN 0.0E0 WHEN w <= b THEN CAST(b AS DOUBLE) ELSE ceil(w * 1.0E0 / b) * b END AS cell FROM (SELECT building_id, building_id % 7 + 1 AS b, building_id % 50 - 5 AS w FROM known_buildings)")
_BOX = lambda v: v.groupBy("ad_id").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
_BOXES = "boxes AS (SELECT ad_id, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM stays GROUP BY 1)"
_B = "west south east north"
add("fn_bounds_diagonal", "stays", lambda v: _BOX(v).select("ad_id", *rounded("metres", [g.bounds_diagonal_m(*_C(_B))], 6)),
    f", {_BOXES} SELECT ad_id, round(sqrt(pow((north - south) * 111000.0E0, 2) + pow((east - west) * 111000.0E0 * cos(radians((north + south) / 2)), 2)), 6) AS metres FROM boxes")
add("fn_expand_bbox", "stays", lambda v: _BOX(v).select("ad_id", *rounded(_B, g.expand_box(*_C(_B), 500.0))),
    f", {_BOXES}, d AS (SELECT *, 500.0E0 / 111000 AS a, 500.0E0 / 111000 / greatest(cos(radians((north + south) / 2)), 1e-6) AS o FROM boxes) SELECT ad_id, round(west - o, 9) AS west, round(south - a, 9) AS south, round(east + o, 9) AS east, round(north + a, 9) AS north FROM d")
add("fn_nonzero_bbox", "stays", lambda v: v.select("row_index", *rounded(_B, g.nonzero_box(F.col("lon"), F.col("lat"), F.col("lon") + F.col("row_index") % 3, F.col("lat") + F.col("row_index") % 2))),
    "SELECT row_index, round(CASE WHEN row_index % 3 = 0 THEN lon - 1e-5 ELSE lon END, 9) AS west, round(CASE WHEN row_index % 2 = 0 THEN lat - 1e-5 ELSE lat END, 9) AS south,"
    " round(CASE WHEN row_index % 3 = 0 THEN lon + 1e-5 ELSE lon + row_index % 3 END, 9) AS east, round(CASE WHEN row_index % 2 = 0 THEN lat + 1e-5 ELSE lat + row_index % 2 END, 9) AS north FROM stays")
add("fn_meters_to_deg_max", "known_buildings", lambda v: v.select("building_id", *rounded("degrees", [g.metres_to_degrees(F.col("building_id") % 700 - 350, (F.col("building_id") % 180 - 90).cast("double"))], 12)),
    "SELECT building_id, round(abs(building_id % 700 - 350) / (111000.0E0 * greatest(0.1E0, abs(cos(radians(building_id % 180 - 90.0E0))))), 12) AS degrees FROM known_buildings")
_TX = "CAST(floor((lon + 180) / 360 * pow(2.0E0, {z})) AS BIGINT)"
_TY = "CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2.0E0, {z})) AS BIGINT)"
_SINH = "((exp({v}) - exp(-({v}))) / 2)"
_NORTH = lambda y: "degrees(atan(" + _SINH.format(v=f"pi() * (1 - 2 * {y} / 65536.0E0)") + "))"
add("fn_web_tile", "stays", lambda v: v.select(*(c.alias(n) for c, n in zip(g.web_tile(*_C("lon lat"), F.lit(16)), ("x", "y")))).distinct().select("x", "y", *rounded(_B, g.web_tile_bounds(*_C("x y"), F.lit(16)))),
    f", t AS (SELECT DISTINCT {_TX.format(z=16)} AS x, {_TY.format(z=16)} AS y FROM stays) SELECT x, y, round(x / 65536.0E0 * 360 - 180, 9) AS west, round({_NORTH('(y + 1)')}, 9) AS south, round((x + 1) / 65536.0E0 * 360 - 180, 9) AS east, round({_NORTH('y')}, 9) AS north FROM t")
add("fn_tiles_in_bbox", "stays", lambda v: _BOX(v).select("ad_id", F.explode(g.web_tiles(*_C(_B), 14)).alias("t")).select("ad_id", "t.x", "t.y"),
    f", {_BOXES}, c AS (SELECT ad_id, {_TX.format(z=14).replace('lon', 'west')} AS x0, {_TX.format(z=14).replace('lon', 'east')} AS x1, {_TY.format(z=14).replace('lat', 'north')} AS y0, {_TY.format(z=14).replace('lat', 'south')} AS y1 FROM boxes),"
    " x AS (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM c), xy AS (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM x) SELECT ad_id, x, y FROM xy QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY x, y) <= 20")
add("fn_grid_key", "stays", lambda v: v.select(*(c.alias(n) for c, n in zip((*g.grid_key(*_C("lon lat"), 2.0), *g.grid_key(*_C("lon lat"), 0.5)), ("half_x", "half_y", "two_x", "two_y")))).groupBy("half_x", "half_y", "two_x", "two_y").agg(F.count(F.lit(1)).alias("n")),
    "SELECT CAST(floor(lon * 2) AS BIGINT) AS half_x, CAST(floor(lat * 2) AS BIGINT) AS half_y, CAST(floor(lon * 0.5) AS BIGINT) AS two_x, CAST(floor(lat * 0.5) AS BIGINT) AS two_y, count(*) AS n FROM stays GROUP BY ALL")
add("fn_coord_key", "stays", lambda v: light.to_units(v).select("row_index", "x", "y"), f"SELECT row_index, {_UNITS} FROM stays")
add("fn_shade_level", "light_rows", lambda v: v.select("row_index", g.shade_level(F.col("shadow_percent")).alias("level")), "SELECT row_index, CASE WHEN p < 10 THEN 'none' WHEN p < 25 THEN 'light' WHEN p < 50 THEN 'medium' WHEN p < 75 THEN 'heavy' ELSE 'full' END AS level FROM (SELECT row_index, shadow_percent AS p FROM light_rows)")
add("fn_dem_decode", "known_buildings", lambda v: v.select("building_id", *(c.alias(n) for c, n in zip(g.dem_elevation(*_C("r g b")), ("metres", "valid")))),
    "SELECT building_id, m AS metres, m BETWEEN -500 AND 9000 AND NOT (r = 0 AND g = 0 AND b = 0) AND NOT (r = 255 AND g = 255 AND b = 255) AS valid FROM (SELECT *, r * 256 + g + b / 256.0E0 - 32768 AS m FROM known_buildings)")
add("src_gfs_grid", "stays", lambda v: v.select("row_index", *(c.alias(n) for c, n in zip((*g.gfs_indices(*_C("lon lat")), *g.gfs_run(F.col("start_time"))), ("lat_index", "lon_index", "run", "forecast_hour", "time_index")))),
    "SELECT row_index, CAST(floor((90 - lat) / 0.25 + 0.5) AS BIGINT) AS lat_index, CAST(floor((lon + 360) / 0.25 + 0.5) AS BIGINT) AS lon_index, run, h AS forecast_hour, CAST(floor(h / 3 + 0.5) AS BIGINT) AS time_index"
    " FROM (SELECT *, CAST(floor((start_time - run) / 3600 + 0.5) AS BIGINT) AS h FROM (SELECT *, CAST(floor(start_time / 21600) * 21600 AS BIGINT) AS run FROM stays))")

# footprints: rings of degrees from the buildings view, open, closed or broken by the id
_RINGS = """lonlat AS (SELECT id, i, lon, lat FROM corners), rings AS (SELECT id, list(struct_pack(x := lon, y := lat) ORDER BY i) AS o FROM lonlat GROUP BY id),
closed AS (SELECT id, CASE id % 5 WHEN 0 THEN o WHEN 1 THEN o[1:2] WHEN 2 THEN list_append(o[1:3], struct_pack(x := 200.0E0, y := o[1].y)) ELSE list_append(o, o[1]) END AS ring, list_append(o, o[1]) AS whole FROM rings)"""


def _rings(s, d):
    b = buildings(s, d)
    o = F.array(*(F.struct(F.col(f"lon{i}").alias("x"), F.col(f"lat{i}").alias("y")) for i in range(4)))
    b = b.withColumn("o", o)
    broken = F.concat(F.slice("o", 1, 3), F.array(F.struct(F.lit(200.0).alias("x"), F.col("o")[0].y.alias("y"))))
    ring = F.when(F.col("building_id") % 5 == 0, F.col("o")).when(F.col("building_id") % 5 == 1, F.slice("o", 1, 2)).when(F.col("building_id") % 5 == 2, broken).otherwise(g.close_ring(F.col("o")))
    return b.select("building_id", "height", ring.alias("ring"), g.close_ring(F.col("o")).alias("whole"))


def ring(name: str, columns, sql: str) -> None:
    QUERIES[name] = lambda s, d: columns(_rings(s, d))
    SQL[name] = f"WITH {_BUILDINGS}, {_RINGS} {sql}"


_AREA = "abs(list_sum([{r}[i].x * {r}[i + 1].y - {r}[i + 1].x * {r}[i].y for i in range(1, len({r}))])) / 2"
_M2 = lambda r: f"coalesce({_AREA.format(r=r)}, 0.0) * 111000.0E0 * 111000.0E0"
ring("fn_polygon_area", lambda v: v.select("building_id", F.round(g.ring_area_m2(F.col("whole")), 2).alias("m2")), f"SELECT id AS building_id, round({_M2('whole')}, 2) AS m2 FROM closed")
ring("fn_polygon_center", lambda v: v.withColumn("c", g.ring_center(F.col("whole"))).select("building_id", *rounded("x y", [F.col("c.x"), F.col("c.y")])), "SELECT id AS building_id, round(list_avg([p.x for p in whole]), 9) AS x, round(list_avg([p.y for p in whole]), 9) AS y FROM closed")
ring("fn_polygon_validate", lambda v: v.select("building_id", F.array_join(g.ring_issues(F.col("ring")), ",").alias("issues")),
    "SELECT id AS building_id, CASE WHEN len(ring) < 4 THEN 'incomplete' ELSE concat_ws(',', CASE WHEN len([1 for p in ring if abs(p.x) > 180 OR abs(p.y) > 90]) > 0 THEN 'out_of_range' END,"
    f" CASE WHEN ring[1].x <> ring[-1].x OR ring[1].y <> ring[-1].y THEN 'open' END, CASE WHEN {_M2('ring')} < 1 OR {_M2('ring')} > 1e7 THEN 'area' END) END AS issues FROM closed")
ring("arr_close_ring", lambda v: v.select("building_id", F.size(g.close_ring(F.col("ring"))).cast("long").alias("n"), F.size(g.close_ring(F.col("whole"))).cast("long").alias("n_whole")),
    "SELECT id AS building_id, CAST(len(ring) + CASE WHEN ring[1].x <> ring[-1].x OR ring[1].y <> ring[-1].y THEN 1 ELSE 0 END AS BIGINT) AS n, len(whole) AS n_whole FROM closed")
ring("arr_ring_edges", lambda v: v.select("building_id", F.posexplode(light.ring_edges("ring")).alias("k", "e")).select("building_id", F.col("k").cast("long"), *rounded("ax ay bx by", [F.col(f"e.{c}") for c in ("ax", "ay", "bx", "by")])),
    "SELECT id AS building_id, CAST(i - 1 AS BIGINT) AS k, round(ring[i].x, 9) AS ax, round(ring[i].y, 9) AS ay, round(ring[i % len(ring) + 1].x, 9) AS bx, round(ring[i % len(ring) + 1].y, 9) AS by FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM closed)")
ring("arr_ring_bbox", lambda v: v.select("building_id", *(F.round(c, 9).alias(n) for c, n in zip(light.ring_bounds("ring"), ("x0", "x1", "y0", "y1")))),
    "SELECT id AS building_id, round(list_min([p.x for p in ring]), 9) AS x0, round(list_max([p.x for p in ring]), 9) AS x1, round(list_min([p.y for p in ring]), 9) AS y0, round(list_max([p.y for p in ring]), 9) AS y1 FROM closed")
ring("arr_explode_multipolygon", lambda v: shapes.polygons_of(v.select("building_id", F.flatten(F.transform(F.array("whole"), lambda w: F.array(F.array(w), F.slice(F.array(w), 1, 0), F.array(w, w)))).alias("geom")), "geom").select("building_id", F.col("part").cast("long"), F.size("geom").cast("long").alias("rings")),
    "SELECT id AS building_id, part, rings FROM closed, (VALUES (0::BIGINT, 1::BIGINT), (2, 2)) p(part, rings)")
ring("src_dataset_vertex_hit", lambda v: shapes.with_vertex_in(v, -73.99, 40.705, -73.98, 40.715).select("building_id"), "SELECT id AS building_id FROM closed WHERE len([1 for p in ring if p.x BETWEEN -73.99 AND -73.98 AND p.y BETWEEN 40.705 AND 40.715]) > 0")
_BOUNDS = "bounds AS (SELECT id, list_min([p.x for p in whole]) AS x0, list_max([p.x for p in whole]) AS x1, list_min([p.y for p in whole]) AS y0, list_max([p.y for p in whole]) AS y1 FROM closed)"
_bounded = lambda v: v.select("building_id", *light.ring_bounds("whole"))
_HIT = "x0 <= -73.98 AND x1 >= -73.99 AND y0 <= 40.715 AND y1 >= 40.705"
ring("flt_bbox", lambda v: shapes.in_box(_bounded(v), -73.99, 40.705, -73.98, 40.715).select("building_id"), f", {_BOUNDS} SELECT id AS building_id FROM bounds WHERE {_HIT}")
ring("src_buildings_preload", lambda v: shapes.in_box(_bounded(v), -73.99, 40.705, -73.98, 40.715).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x0"), 9).alias("west"), F.round(F.max("x1"), 9).alias("east")), f", {_BOUNDS} SELECT count(*) AS n, round(min(x0), 9) AS west, round(max(x1), 9) AS east FROM bounds WHERE {_HIT}")
ring("src_local_geojson_bbox", lambda v: shapes.in_box(_bounded(v), -73.99, 40.705, -73.98, 40.715, 25).select("building_id"), f", {_BOUNDS} SELECT id AS building_id FROM bounds WHERE {_HIT} ORDER BY id LIMIT 25")
ring("lim_features", lambda v: v.orderBy(F.desc("height"), "building_id").limit(15).select("building_id", "height"), "SELECT id AS building_id, height FROM b ORDER BY height DESC, id LIMIT 15")
ring("fn_rect_overlap_pct", lambda v: _bounded(v).select("building_id", *(c.alias(n) for c, n in zip(g.box_overlap(tuple(map(F.lit, (-73.99, 40.705, -73.9888, 40.7062))), _C("x0 y0 x1 y1")), ("share", "metres", "aligned")))).select("building_id", F.round("share", 6).alias("share"), F.round("metres", 4).alias("metres"), "aligned"),
    f", {_BOUNDS}, o AS (SELECT *, greatest(-73.99E0, x0) AS w, greatest(40.705E0, y0) AS s, least(-73.9888E0, x1) AS e, least(40.7062E0, y1) AS n, (-73.99E0 + -73.9888E0) / 2 AS lon, (40.705E0 + 40.7062E0) / 2 AS lat, (x0 + x1) / 2 AS lon2, (y0 + y1) / 2 AS lat2 FROM bounds),"
    f" q AS (SELECT *, CASE WHEN w < e AND s < n THEN (e - w) * (n - s) / ((-73.9888E0 - -73.99E0) * (40.7062E0 - 40.705E0)) * 100 ELSE 0.0 END AS share, CASE WHEN w < e AND s < n THEN 0.0 ELSE {_HAV} END AS metres FROM o)"
    " SELECT id AS building_id, round(share, 6) AS share, round(metres, 4) AS metres, w < e AND s < n AND share > 80 AND metres < 100 AS aligned FROM q")

_HTS = f"greatest(coalesce({num('height')}, 0.0), 0.0)"
_IMP = "sqrt(coalesce(area, 0.0)) * " + _HTS + " * 0.1E0 * CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in shapes.WEIGHTS.items()) + " ELSE 1.0 END * 1.5E0"


def _scored(v):
    return v.select("building_id", F.coalesce("area", F.lit(0.0)).alias("area"), F.greatest(F.coalesce(number(F.col("height")), F.lit(0.0)), F.lit(0.0)).alias("height"), "kind", "name", "region")


add("srt_rank_building", "known_buildings", lambda v: shapes.ranked(_scored(v), ["region"]).select("building_id", F.round("importance", 6).alias("importance"), F.col("rank").cast("long")),
    f"SELECT building_id, round({_IMP}, 6) AS importance, row_number() OVER (PARTITION BY region ORDER BY {_IMP} DESC, building_id) AS rank FROM known_buildings")
add("flt_quality_by_zoom", "known_buildings", lambda v: shapes.kept_at_zoom(_scored(v), 100, 50.0, 3.0, False).select("building_id"),
    f"SELECT building_id FROM (SELECT building_id, coalesce(area, 0.0) AS area, {_HTS} AS h FROM known_buildings ORDER BY {_IMP} DESC, building_id LIMIT 100) WHERE area >= 100 AND h >= 3")
add("agg_obstacle_max_height", "known_buildings", lambda v: v.groupBy("region").agg(F.max(number(F.col("height"))).alias("height")), f"SELECT region, max({num('height')}) AS height FROM known_buildings GROUP BY 1")

_TILES = "tiles AS (SELECT p_partkey AS tile_id, -80.0E0 + p_partkey % 40 AS west, 30.0E0 + p_partkey % 20 AS south, -80.0E0 + p_partkey % 40 + (p_partkey % 7 + 1) * 0.15E0 AS east, 30.0E0 + p_partkey % 20 + (p_partkey % 5 + 1) * 0.2E0 AS north FROM part)"
_CUT = """cut AS (SELECT *, round(west + i * 0.25E0, 10) AS min_lon, round(south + j * 0.25E0, 10) AS min_lat FROM (SELECT *, unnest(range(CAST(ceil((north - south - 1e-12) / 0.25E0) AS BIGINT))) AS j FROM (SELECT *, unnest(range(CAST(ceil((east - west - 1e-12) / 0.25E0) AS BIGINT))) AS i FROM tiles))),
grid AS (SELECT *, least(east, round(min_lon + 0.25E0, 10)) AS max_lon, least(north, round(min_lat + 0.25E0, 10)) AS max_lat FROM cut)"""


def _tiles(s, d):
    return s.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey as tile_id", "-80.0D + p_partkey % 40 as west", "30.0D + p_partkey % 20 as south", "-80.0D + p_partkey % 40 + (p_partkey % 7 + 1) * 0.15D as east", "30.0D + p_partkey % 20 + (p_partkey % 5 + 1) * 0.2D as north"
    )


_R9 = lambda p: [F.round(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
_S9 = ", ".join(f"round({c}, 9) AS {c}" for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
QUERIES["gen_partition_grid"] = lambda s, d: shapes.partitions_of(_tiles(s, d), 0.25).select("tile_id", *_R9(0))
SQL["gen_partition_grid"] = f"WITH {_TILES}, {_CUT} SELECT tile_id, {_S9} FROM grid"
QUERIES["gen_hotspot_subgrid"] = lambda s, d: (lambda p: shapes.refined(p, p.where("min_lon < -60"), 0.125).select(*_R9(0)).distinct())(shapes.partitions_of(_tiles(s, d), 0.25))
SQL["gen_hotspot_subgrid"] = f"""WITH {_TILES}, {_CUT}, hot AS (SELECT min_lon AS w, min_lat AS s, max_lon AS e, max_lat AS n FROM grid WHERE min_lon < -60),
  fine AS (SELECT *, round(w + i * 0.125E0, 10) AS min_lon, round(s + j * 0.125E0, 10) AS min_lat FROM (SELECT *, unnest(range(CAST(ceil((n - s - 1e-12) / 0.125E0) AS BIGINT))) AS j FROM (SELECT *, unnest(range(CAST(ceil((e - w - 1e-12) / 0.125E0) AS BIGINT))) AS i FROM hot))),
  b AS (SELECT *, least(e, round(min_lon + 0.125E0, 10)) AS max_lon, least(n, round(min_lat + 0.125E0, 10)) AS max_lat FROM fine) SELECT DISTINCT {_S9} FROM b"""
QUERIES["gen_sample_grid"] = lambda s, d: shapes.sample_grid(_tiles(s, d), 5).select("tile_id", F.col("i").cast("long"), F.col("j").cast("long"), *rounded("lon lat", _C("lon lat")))
SQL["gen_sample_grid"] = f"WITH {_TILES} SELECT tile_id, i, j, round(west + (east - west) * i / 6, 9) AS lon, round(south + (north - south) * j / 6, 9) AS lat FROM tiles, range(1, 6) a(i), range(1, 6) b(j)"
QUERIES["src_buildings_point_buffer"] = lambda s, d: shapes.near_points(_buildings(s, d).select("building_id", *light.ring_bounds("ring")), light.to_units(stays(s, d)), 20, 100.0).select("building_id")
SQL["src_buildings_point_buffer"] = f"""WITH {STAYS_SQL}, {_BUILDINGS}, box AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM m GROUP BY id),
  p AS (SELECT DISTINCT {_UNITS} FROM stays) SELECT DISTINCT id AS building_id FROM box JOIN p ON x0 <= x + 20 AND x1 >= x - 20 AND y0 <= y + 20 AND y1 >= y - 20"""
add("json_feature_parse", "known_buildings", lambda v: shapes.read_features(v.select("building_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat(F.lit('{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"height":"'), F.col("building_id").cast("string"), F.lit('"}},{"geometry":{"type":"Polygon","coordinates":[]}}')), F.lit("]}")).alias("doc")), "doc")
    .select("building_id", F.col("position").cast("long"), "geometry_type", shapes.first_property(F.col("props"), "h", "height").alias("height")),
    "SELECT building_id, p AS position, CASE p WHEN 0 THEN 'Point' ELSE 'Polygon' END AS geometry_type, CASE p WHEN 0 THEN CAST(building_id AS VARCHAR) END AS height FROM known_buildings, range(2) r(p)")
add("json_props_get", "known_buildings", lambda v: v.select("building_id", shapes.first_property(F.create_map(F.lit("kind"), F.col("kind"), F.lit("name"), F.col("name")), "function", "kind", "name").alias("what")), "SELECT building_id, coalesce(kind, name) AS what FROM known_buildings")
add("json_feature_build", "known_buildings", lambda v: shapes.build_features(v.where("region is not null").select("region", "building_id", F.lit(1.5).alias("lon"), F.lit(2.5).alias("lat")), ["region"], "building_id").select("region", F.sha2("features", 256).alias("digest")),
    """SELECT region, sha256(concat('{"type":"FeatureCollection","features":[', string_agg(concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"building_id":', building_id, '}}'), ',' ORDER BY building_id), ']}')) AS digest FROM known_buildings WHERE region IS NOT NULL GROUP BY 1""")
_PIX = "pixels AS (SELECT p_partkey % 50 AS r, CAST(floor(p_partkey / 50) AS BIGINT) AS c, (p_partkey * 7919 % 101) * 0.1E0 AS value FROM part)"


def _pixels(s, d):
    return s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey % 50 as r", "floor(p_partkey / 50) as c", "(p_partkey * 7919 % 101) * 0.1D as value")


QUERIES["ras_downsample"] = lambda s, d: shapes.downsampled(_pixels(s, d), shapes.step_for(50, 40, 300))
SQL["ras_downsample"] = f"WITH {_PIX} SELECT CAST(r / 3 AS BIGINT) AS r, CAST(c / 3 AS BIGINT) AS c, value FROM pixels WHERE r % 3 = 0 AND c % 3 = 0"
QUERIES["ras_threshold_components"] = lambda s, d: shapes.raster_components(_pixels(s, d), 3.0)
SQL["ras_threshold_components"] = f"""WITH RECURSIVE {_PIX}, kept AS (SELECT r, c, value, r * 4294967296 + c AS id FROM pixels WHERE value >= 3.0),
  reach(id, root) AS (SELECT id, id FROM kept UNION SELECT k.id, reach.root FROM reach JOIN kept m ON m.id = reach.id JOIN kept k ON abs(k.r - m.r) + abs(k.c - m.c) = 1 AND k.id > reach.root),
  least_of AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)
  SELECT r, c, value, component, max(value) OVER (PARTITION BY component) AS height FROM kept JOIN least_of USING (id)"""
