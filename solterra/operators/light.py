"""Buildings, shadows and weather: spatial joins by grid cell with an exact test, and joins to the nearest instant."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solar
from .boxes import box_join, level_of
from .reports import ssrd_mode

DEGREE_M = 111_320.0
TALL_CELL_M = 1000.0
#: Positions per degree of ``to_units``: whole numbers, in which a point on an edge is told exactly.
UNITS = 100_000


def to_units(rows: DataFrame) -> DataFrame:
    """rows with x, y: lon and lat as whole numbers of 1e-5 degree, half to even. Null positions stay null."""
    return rows.withColumn("x", F.rint(F.col("lon") * UNITS).cast("long")).withColumn("y", F.rint(F.col("lat") * UNITS).cast("long"))


#: Units of latitude that share one metric frame: within it, a unit east has the metres of its middle.
FRAME = 5_000
NORTH_M = DEGREE_M / UNITS


def frame_of(y: Column) -> Column:
    return F.floor(y / FRAME)


def east_metres(frame: Column) -> Column:
    """Metres of a unit eastward in a frame."""
    return DEGREE_M * F.cos(F.radians((frame + 0.5) * (FRAME / UNITS))) / UNITS


def _framed(rows: DataFrame, plane: bool, y0: Column, y1: Column | None = None) -> DataFrame:
    """rows with _f, the frame of y0 or each between y0 and y1, and its metres _mx, _my; of a plane in metres there is one frame."""
    if plane:
        return rows.withColumn("_f", F.lit(0).cast("long")).withColumn("_mx", F.lit(1.0)).withColumn("_my", F.lit(1.0))
    rows = rows.withColumn("_f", frame_of(y0) if y1 is None else F.explode(F.sequence(frame_of(y0), frame_of(y1))))
    return rows.withColumn("_mx", east_metres(F.col("_f"))).withColumn("_my", F.lit(NORTH_M))


def ring_edges(ring: str | Column = "ring") -> Column:
    """array<struct<ax,ay,bx,by>>: the edges of a ring (array<struct<x,y>>), last vertex to first; the edge that a closing
    vertex adds has no length and changes nothing. An empty ring has no edges, a null ring null."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p.x.alias("ax"), p.y.alias("ay"), q.x.alias("bx"), q.y.alias("by")))


def ring_bounds(ring: str = "ring") -> list[Column]:
    """x0, x1, y0, y1 of a ring; null for an empty one."""
    bound = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return [bound(F.array_min, "x").alias("x0"), bound(F.array_max, "x").alias("x1"), bound(F.array_min, "y").alias("y0"), bound(F.array_max, "y").alias("y1")]


def in_ring(x: Column, y: Column, edges: str = "edges") -> Column:
    """Even-odd rule over edges, points on an edge included. Nothing is divided: exact for whole numbers."""
    turn = lambda e: (x - e.ax) * (e.by - e.ay) - (e.bx - e.ax) * (y - e.ay)
    crosses = lambda e: ((e.ay > y) != (e.by > y)) & F.when(e.by > e.ay, turn(e) < 0).otherwise(turn(e) > 0)
    on = lambda e: (turn(e) == 0) & x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))
    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e).cast("int")) % 2 == 1
    return odd | F.exists(edges, on)


def _cells(rows: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, cell_x: float, cell_y: float) -> DataFrame:
    covered = lambda a, b, c: F.explode(F.sequence(F.floor(a / c), F.floor(b / c)))
    return rows.withColumn("_x", covered(x0, x1, cell_x)).withColumn("_y", covered(y0, y1, cell_y))


def shapes_of(buildings: DataFrame) -> DataFrame:
    """(building_id, edges, x0 .. y1) of buildings (building_id, ring)."""
    return buildings.where(F.size("ring") > 0).select("building_id", ring_edges().alias("edges"), *ring_bounds())


def _within(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """(x, y, what else shapes hold): each different position of the points with each of the shapes (edges, x0 .. y1, more) it lies in.
    However often a position is repeated, it is tested once; a position lies in one cell, so that no pair comes twice."""
    spots = points.where("x is not null and y is not null").select("x", "y").distinct()
    spots = spots.withColumn("_x", F.floor(F.col("x") / cell)).withColumn("_y", F.floor(F.col("y") / cell))
    kinds = _cells(shapes, *(F.col(c) for c in ("x0", "x1", "y0", "y1")), cell, cell).hint("merge")  # its size isn't known before
    boxed = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return spots.join(kinds, ["_x", "_y"]).where(boxed & in_ring(F.col("x"), F.col("y"))).drop("_x", "_y", "x0", "x1", "y0", "y1")


def _met(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """(x, y, edges) as ``_within``, each different shape tested once."""
    return _within(points, shapes.select("edges", "x0", "x1", "y0", "y1").distinct(), cell)


def _kinds(buildings: DataFrame) -> DataFrame:
    """(ring, edges, x0 .. y1, _n, _first): the different rings of buildings, how many have each, and the least of their ids."""
    kinds = buildings.where(F.size("ring") > 0).groupBy("ring").agg(F.count(F.lit(1)).alias("_n"), F.min("building_id").alias("_first"))
    return kinds.select("ring", ring_edges().alias("edges"), *ring_bounds(), "_n", "_first")


#: Ids of one shape that travel as one row, at most, where ids are whole numbers.
BLOCK_IDS = 1 << 16


def _paired(points: DataFrame, met: DataFrame, known: DataFrame, shape: str, at: list[str] | None = None) -> DataFrame:
    """(row_index, building_id) of points with the buildings known (building_id, ``shape``, at) whose shape met their position. Ids of a
    shape go by blocks of their own range, so that a pair becomes a row after the last shuffle only."""
    at = at or []
    whole = dict(known.dtypes)["building_id"] in ("bigint", "int")
    block = F.floor(F.col("building_id") / BLOCK_IDS) if whole else F.pmod(F.xxhash64("building_id"), F.lit(1024))
    blocks = known.groupBy(F.xxhash64(shape).alias("_h"), shape, *at, block.alias("_block")).agg(F.collect_list(F.struct("building_id")).alias("_ids"))
    told = met.withColumn("_h", F.xxhash64(shape)).join(blocks.hint("merge"), ["_h", shape, *at]).select("x", "y", "_ids")
    return points.select("row_index", "x", "y").join(told.hint("merge"), ["x", "y"]).select("row_index", F.explode("_ids").alias("_id")).select("row_index", "_id.building_id")


def within_shapes(points: DataFrame, shapes: DataFrame, cell: float = 100.0) -> DataFrame:
    """(row_index, building_id) of points (row_index, x, y) in a shape (building_id, edges, x0 .. y1), a row for each."""
    return _paired(points, _met(points, shapes, cell), shapes.select("building_id", "edges"), "edges")


def indoor(points: DataFrame, buildings: DataFrame, cell: float = 100.0) -> DataFrame:
    """(row_index, building_id) of points (row_index, x, y) in a footprint, its boundary included, both in the same unit.
    A point in several footprints gives a row for each; null positions and empty tables match nothing."""
    return _paired(points, _within(points, _kinds(buildings), cell).select("x", "y", "ring"), buildings.select("building_id", "ring"), "ring")


def indoor_counts(points: DataFrame, buildings: DataFrame, cell: float = 100.0) -> DataFrame:
    """(row_index, rings, first): how many footprints a point lies in and the least building_id of them; points in none go. Counted by
    ring and position, so that the pairs of ``indoor`` never become rows."""
    spots = _within(points, _kinds(buildings), cell).groupBy("x", "y").agg(F.sum("_n").alias("rings"), F.min("_first").alias("first"))
    return points.select("row_index", "x", "y").join(spots.hint("merge"), ["x", "y"]).select("row_index", "rings", "first")


def covered_spots(points: DataFrame, buildings: DataFrame, cell: float = 100.0) -> DataFrame:
    """(x, y): the different positions of points that lie in any footprint, for semi- and anti-joins."""
    return _within(points, _kinds(buildings), cell).select("x", "y").distinct().hint("merge")


def tallest(buildings: DataFrame) -> DataFrame:
    """buildings (building_id, height, ring), of those with equal rings the highest alone, under the least of their ids: its shadow
    holds theirs. Null heights are 0, heights below 0 stand apart; buildings without a vertex go."""
    known = buildings.where(F.size("ring") > 0).select("building_id", F.coalesce("height", F.lit(0.0)).alias("height"), "ring")
    up = known.withColumn("_down", F.col("height") < 0).withColumn("_h", F.xxhash64("ring"))
    return up.groupBy("_h", "ring", "_down").agg(F.min("building_id").alias("building_id"), F.max_by("height", F.abs("height")).alias("height")).select("building_id", "height", "ring")


def with_sun(points: DataFrame) -> DataFrame:
    """points (timestamp, lon, lat, more) with alt and az of the sun, null where time or place is. Worked out over Arrow batches: the
    formulae as generated code are methods that the JVM won't compile."""
    columns = points.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, lon, lat = (pc.fill_null(batch.column(c).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in ("timestamp", "lon", "lat"))
            told = [pa.array(v, from_pandas=True) for v in solar.position_at(t, lon, lat)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*columns, "alt", "az"])

    return points.mapInArrow(run, ", ".join([*(f"`{c}` {k}" for c, k in points.dtypes), "alt double, az double"]))


#: What tells one ray towards the sun from another.
RAY = ["timestamp", "lon", "lat", "x", "y"]
#: Rays of one frame, cell, sector of azimuth and class of shadow length are one bundle.
BUNDLE = ["_f", "_gx", "_gy", "_sector", "_length"]


def _obstacles(up: DataFrame, buildings: DataFrame, max_height: float, far: float, cell_m: float, plane: bool) -> tuple[DataFrame, DataFrame]:
    """Of rays up (BUNDLE, x, y, ux, uy): the walls (BUNDLE, height, ax .. by) of which a shadow can meet a ray of the bundle, and the
    footprints (BUNDLE, edges, ax .. by their bounds) that one can lie in. Bundles, not rays, are met with buildings: of those there
    are no more than cells and directions, however many rays."""
    c = F.col
    of = up.groupBy(*BUNDLE).agg(*(f(n).alias(f"_{n}{k}") for n in ("x", "y", "ux", "uy") for k, f in ((0, F.min), (1, F.max))))
    of = of.withColumns({"_mx": F.lit(1.0) if plane else east_metres(c("_f")), "_my": F.lit(1.0 if plane else NORTH_M)})
    mx, my, north, nothing = c("_mx"), c("_my"), 1.0 if plane else NORTH_M, F.lit(0.0)
    walls = tallest(buildings).select("height", F.explode(ring_edges()).alias("e")).select("height", "e.*")
    walls = walls.groupBy("ax", "ay", "bx", "by", (c("height") < 0).alias("_down")).agg(F.max_by("height", F.abs("height")).alias("height")).drop("_down")
    bounds = F.least("ax", "bx"), F.greatest("ax", "bx"), F.least("ay", "by"), F.greatest("ay", "by")
    side = 2 * cell_m
    keys = lambda w: w.withColumnsRenamed({k: f"w{k}" for k in ("_f", "_x", "_y")}).drop("_mx", "_my").hint("merge")
    meet = [c("_f") == c("w_f"), c("_x") == c("w_x"), c("_y") == c("w_y")]
    # where a pair counts: in the first cell that both have
    first = lambda a, b, cx, cy: (c("_x") == F.floor(F.greatest(a, bounds[0]) / cx)) & (c("_y") == F.floor(F.greatest(b, bounds[2]) / cy))

    low = _framed(walls.where(c("height") <= max_height), plane, bounds[2] - max_height * far / north, bounds[3] + max_height * far / north)
    low = keys(_cells(low, *bounds, side / mx, side / my))
    west, east = c("_x0") - max_height * F.greatest(c("_ux1"), nothing), c("_x1") - max_height * F.least(c("_ux0"), nothing)
    south, up_to = c("_y0") - max_height * F.greatest(c("_uy1"), nothing), c("_y1") - max_height * F.least(c("_uy0"), nothing)
    met = _cells(of, west, east, south, up_to, side / mx, side / my).join(low, [*meet, first(west, south, side / mx, side / my)])

    tall = walls.where(c("height") > max_height).withColumn("_r", c("height") * far)
    tall = _framed(tall, plane, bounds[2] - c("_r") / north, bounds[3] + c("_r") / north)
    tall = keys(_cells(tall, bounds[0] - c("_r") / mx, bounds[1] + c("_r") / mx, bounds[2] - c("_r") / my, bounds[3] + c("_r") / my, TALL_CELL_M / mx, TALL_CELL_M / my).drop("_r"))
    here = _cells(of, c("_x0"), c("_x1"), c("_y0"), c("_y1"), TALL_CELL_M / mx, TALL_CELL_M / my)
    met = met.unionByName(here.join(tall, meet))

    # a wall's shadow, for any direction of the bundle, keeps to these bounds, and to this belt along the bundle's own direction
    least, most = lambda u: F.least(c("height") * c(f"_{u}0"), c("height") * c(f"_{u}1"), nothing), lambda u: F.greatest(c("height") * c(f"_{u}0"), c("height") * c(f"_{u}1"), nothing)
    boxed = (bounds[0] + least("ux") <= c("_x1")) & (bounds[1] + most("ux") >= c("_x0")) & (bounds[2] + least("uy") <= c("_y1")) & (bounds[3] + most("uy") >= c("_y0"))
    dx, dy = (c("_ux0") + c("_ux1")) / 2, (c("_uy0") + c("_uy1")) / 2
    across = lambda px, py: (px - c("_x0")) * dy - (py - c("_y0")) * dx
    wide = F.abs("height") * ((c("_ux1") - c("_ux0")) / 2 * F.abs(dy) + (c("_uy1") - c("_uy0")) / 2 * F.abs(dx)) + 1e-6 * (F.abs(dx) + F.abs(dy))
    ends, corners = (across(c("ax"), c("ay")), across(c("bx"), c("by"))), [across(c(i), c(j)) for i in ("_x0", "_x1") for j in ("_y0", "_y1")]
    belt = (F.least(*ends) - wide <= F.greatest(*corners)) & (F.greatest(*ends) + wide >= F.least(*corners))
    met = met.where(boxed & belt).select(*BUNDLE, "height", "ax", "ay", "bx", "by")

    roofs = _framed(_kinds(buildings).select("edges", c("x0").alias("ax"), c("x1").alias("bx"), c("y0").alias("ay"), c("y1").alias("by")), plane, c("ay"), c("by"))
    roofs = keys(_cells(roofs, *bounds, side / mx, side / my))
    under = _cells(of, c("_x0"), c("_x1"), c("_y0"), c("_y1"), side / mx, side / my).join(roofs, [*meet, first(c("_x0"), c("_y0"), side / mx, side / my)])
    under = under.where((c("ax") <= c("_x1")) & (c("bx") >= c("_x0")) & (c("ay") <= c("_y1")) & (c("by") >= c("_y0")))
    return met, under.select(*BUNDLE, "edges", "ax", "ay", "bx", "by")


def shaded(rays: DataFrame, buildings: DataFrame, max_height: float, min_altitude: float = math.radians(5), cell_m: float = 100.0, plane: bool = True) -> DataFrame:
    """Those of rays (x, y, alt, az, more; the sun above ``min_altitude``) on which a wall throws its shadow or that begin in a footprint,
    see ``with_shadow``; those of which both is true come twice."""
    x, y, mx, my = F.col("x"), F.col("y"), F.col("_mx"), F.col("_my")
    up = _framed(rays, plane, y).withColumns({"_gx": F.floor(x / (cell_m / mx)), "_gy": F.floor(y / (cell_m / my)), "_sector": F.floor(F.col("az") / math.radians(5)), "_length": F.floor(F.log2(1 / F.tan("alt")) * 4)})
    up = up.select(*rays.columns, *BUNDLE, (F.sin("az") / F.tan("alt") / mx).alias("ux"), (F.cos("az") / F.tan("alt") / my).alias("uy"))
    met, under = _obstacles(up, buildings, max_height, 1 / math.tan(min_altitude), cell_m, plane)
    dx, dy = F.col("height") * F.col("ux"), F.col("height") * F.col("uy")
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    det = (bx - ax) * dy - (by - ay) * dx
    s, t = ((x - ax) * dy - (y - ay) * dx), ((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    between = lambda v: F.when(det > 0, (v >= 0) & (v <= det)).when(det < 0, (v <= 0) & (v >= det))
    struck, inside = (det != 0) & between(s) & between(t), x.between(ax, bx) & y.between(ay, by) & in_ring(x, y)

    def semi(w: DataFrame, hit: Column) -> DataFrame:
        """Dealt out by bundle: the work is in its pairs, however few files the points come from, and a crowded one can be split."""
        w = w.withColumnsRenamed({c: f"w{c}" for c in BUNDLE}).hint("merge")
        return up.join(w, [*(F.col(c) == F.col(f"w{c}") for c in BUNDLE), hit], "left_semi").select(*rays.columns)

    # two joins: an edge list can't be walked by generated code, and walls are many more
    return semi(met, struck).unionByName(semi(under, inside))


def with_shadow(points: DataFrame, buildings: DataFrame, max_height: float, min_altitude: float = math.radians(5), cell_m: float = 100.0, plane: bool = True) -> DataFrame:
    """points (timestamp, lon, lat, x, y, more) with lit and in_shadow. lit: the sun stands above ``min_altitude``. in_shadow: a
    wall's shadow on the ground, or a footprint, covers the point. x and y of points and rings are metres of a ``plane``, or else
    units of ``to_units``, which have the metres of the point's own frame, a belt of latitude: buildings come to each frame that their
    shadow can reach, so that any latitude is right.

    Rays towards the sun are bundled by cell and direction. A bundle meets the walls of the cells that a building of ``max_height``
    can shade it from; a taller building comes to the bundles of all cells that its own shadow can reach, of TALL_CELL_M:
    ``max_height`` parts the two ways and leaves no building out. Each ray is then tested against its bundle's walls, and travels
    once. The test solves P - A = s (B - A) + t d for each wall AB. Walls along the sun's direction throw no shadow of their own; a
    null height is 0. Null positions or times are not lit. Points of the same instant and place are one ray, and of walls on one line
    of ground the highest holds the others' shadow."""
    rays = with_sun(points.select(*RAY).dropna().distinct()).where(F.col("alt") > min_altitude)
    hits = shaded(rays, buildings, max_height, min_altitude, cell_m, plane)
    both = rays.select(*RAY, F.lit(False).alias("_hit")).unionByName(hits.select(*RAY, F.lit(True).alias("_hit")))
    told = both.groupBy(*RAY).agg(F.max("_hit").alias("_hit")).hint("merge")
    return points.join(told, RAY, "left").select(*points.columns, F.col("_hit").isNotNull().alias("lit"), F.coalesce("_hit", F.lit(False)).alias("in_shadow"))


def shadowed(points: DataFrame, buildings: DataFrame, max_height: float, min_altitude: float = math.radians(5), cell_m: float = 100.0, plane: bool = True) -> DataFrame:
    """(row_index, lit, in_shadow) of points (row_index, timestamp, lon, lat, x, y), see ``with_shadow``."""
    return with_shadow(points.select("row_index", *RAY), buildings, max_height, min_altitude, cell_m, plane).select("row_index", "lit", "in_shadow")


def nearest_in_time(points: DataFrame, readings: DataFrame, by: str, value: str | list[str], tolerance: int = 86400) -> DataFrame:
    """points with ``value``, one column or several, of the reading of the same ``by`` nearest in time (timestamp), ``tolerance`` seconds away at
    most, else null; of two as near, the earlier. Readings go to their own stretch of ``tolerance`` seconds and the two
    beside it, so that a window holds one stretch of one key, however long the history; both of its frames run over rows
    before the current one, so that each is one pass. Points without time or key get null; no readings give null."""
    stretch = F.floor(F.col("timestamp") / tolerance)
    names = [value] if isinstance(value, str) else value
    shape = "struct<at:bigint," + ",".join(f"v{k}:double" for k in range(len(names))) + ">"
    p = points.withColumn("_s", stretch).withColumn("_reading", F.lit(None).cast(shape))
    reading = F.struct(F.col("timestamp").cast("long").alias("at"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(names))).alias("_reading")
    r = readings.where(F.col("timestamp").isNotNull() & F.col(by).isNotNull()).select(by, "timestamp", F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_s"), reading)
    so_far = lambda order: Window.partitionBy(by, "_s").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = (F.last("_reading", True).over(so_far(order)) for order in (F.asc("timestamp"), F.desc("timestamp")))
    both = p.unionByName(r, allowMissingColumns=True).withColumn("_b", before).withColumn("_a", after).where("_reading is null")
    back, ahead = F.col("timestamp") - F.col("_b.at"), F.col("_a.at") - F.col("timestamp")
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    out = both.withColumn("_best", best)
    near = F.abs(F.col("timestamp") - F.col("_best.at")) <= tolerance
    return out.withColumns({c: F.when(near, F.col(f"_best.v{k}")) for k, c in enumerate(names)}).drop("_s", "_reading", "_b", "_a", "_best")


def irradiance(readings: DataFrame, by: str, incremental: Column | None = None) -> DataFrame:
    """watts of each ``by`` from ``ssrd`` (joules), over the seconds since the reading before, zero at least. Where ``incremental``
    holds, ssrd is the step's own energy; else it is a running sum: its difference counts, or the reading itself after a reset. Without
    ``incremental`` the readings of each ``by`` tell (see ``ssrd_mode``). Null for the first, for steps without time and for
    null readings."""
    if incremental is None:
        told = ssrd_mode(readings, by).select(F.col(by).alias("_by"), (F.col("mode") == "incremental").alias("_own"))
        return irradiance(readings.join(told, F.col(by).eqNullSafe(F.col("_by")), "left"), by, F.coalesce("_own", F.lit(False))).drop("_by", "_own")
    w = Window.partitionBy(by).orderBy("timestamp")
    step, dt = F.col("ssrd") - F.lag("ssrd").over(w), F.col("timestamp") - F.lag("timestamp").over(w)
    joules = F.when(incremental | (step < 0), F.col("ssrd")).otherwise(step)
    watts = joules / F.when(dt > 0, dt)
    return readings.withColumn("watts", F.when(watts > 0, watts).when(watts.isNotNull(), 0.0))


def in_polygon(x: Column, y: Column, edges: str = "edges") -> Column:
    """Even-odd rule over the edges of all rings of a polygon: holes are outside, their boundary and the outer one inside."""
    return in_ring(x, y, edges)


def polygon_edges(rings: Column) -> Column:
    """Edges of all rings (array<array<struct<x,y>>>) of a polygon."""
    return F.flatten(F.transform(rings, ring_edges))


def touches_polygon(buildings: DataFrame, polygon: list[tuple[int, int]]) -> DataFrame:
    """Buildings (ring, more) that share a point with the polygon (corners in the rings' unit, not closed): a corner of one lies in the
    other, or edges cross. Boundaries count. The polygon is a literal; bounds are tested first."""
    corner = lambda p: F.struct(F.lit(p[0]).cast("double").alias("x"), F.lit(p[1]).cast("double").alias("y"))
    shape = F.array(*map(corner, polygon))
    b = buildings.withColumn("_e", ring_edges("ring")).withColumn("_p", ring_edges(shape)).withColumn("_c", shape)
    side = lambda e, px, py: (px - e.ax) * (e.by - e.ay) - (e.bx - e.ax) * (py - e.ay)
    across = lambda e, f: (side(e, f.ax, f.ay) * side(e, f.bx, f.by) < 0) & (side(f, e.ax, e.ay) * side(f, e.bx, e.by) < 0)
    vertex_in = F.exists("ring", lambda p: in_ring(p.x, p.y, "_p"))
    corner_in = F.exists("_c", lambda p: in_ring(p.x, p.y, "_e"))
    crossing = F.exists("_e", lambda e: F.exists("_p", lambda f: across(e, f)))
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    x0, x1, y0, y1 = (F.array_min(F.transform("ring", lambda p: p.x)), F.array_max(F.transform("ring", lambda p: p.x)), F.array_min(F.transform("ring", lambda p: p.y)), F.array_max(F.transform("ring", lambda p: p.y)))
    boxed = b.where((x0 <= max(xs)) & (x1 >= min(xs)) & (y0 <= max(ys)) & (y1 >= min(ys)))
    return boxed.where(vertex_in | corner_in | crossing).drop("_e", "_p", "_c")


#: Buildings of one box and height that travel as one row: those of so long a range of ids. Parts into which targets are dealt.
REACH_IDS, DEALS = 1 << 20, 16


def within_reach(targets: DataFrame, buildings: DataFrame, margin: float, plane: bool = False) -> DataFrame:
    """(task_id, building_id): buildings (building_id, height, x0 .. y1) that can shade a target box (task_id, x0 .. y1, elevation in
    radians): those no farther from it than their own shadow and ``margin`` metres, measured in the frame of the target's middle.
    Targets with the sun down keep none, since nothing throws a shadow then; a null height is 0. Buildings are classed by powers of
    eight of their height, and a target looks for each class within that class's reach, cut to the buildings' ground, by a join of
    boxes of any size: no height or elevation is too much. Buildings of one box and height are one row, tested once, and bring their
    ids along, so that a pair becomes a row after the last shuffle only; targets of one cell are dealt out to DEALS parts."""
    up = targets.where("elevation > 0").select("task_id", *(F.col(c).alias(f"t{c}") for c in ("x0", "x1", "y0", "y1")), "elevation")
    frame = frame_of((F.col("ty0") + F.col("ty1")) / 2)
    mx, my = (F.lit(1.0), F.lit(1.0)) if plane else (east_metres(frame), F.lit(NORTH_M))
    box, whole = ["x0", "x1", "y0", "y1"], dict(buildings.dtypes)["building_id"] in ("bigint", "int")
    b = buildings.select("building_id", F.greatest(F.coalesce("height", F.lit(0.0)), F.lit(0.0)).alias("height"), *box)
    block = F.floor(F.col("building_id") / REACH_IDS) if whole else F.pmod(F.xxhash64("building_id"), F.lit(1024))
    kinds = b.groupBy(*box, "height", block.alias("_block")).agg(F.collect_list(F.struct("building_id")).alias("_ids")).drop("_block")
    kinds = kinds.withColumn("_class", F.greatest(F.lit(0), F.ceil(F.log2("height") / 3)).cast("int"))
    # as many classes as a height has powers of eight; the ground that buildings stand on, and the level of a box as wide
    ends = [f(F.col(c).cast("double")) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]
    classes, *ground, highest = kinds.agg(F.collect_set("_class"), *ends, level_of(*ends)).first()
    west, south, east, north = (F.lit(v) for v in (ground if classes else [0.0] * 4))
    t = up.withColumns({"_mx": mx, "_my": my, "_class": F.explode(F.array(*map(F.lit, classes or [0]))), "_deal": F.pmod(F.xxhash64("task_id"), F.lit(DEALS))})
    far = (F.pow(F.lit(8.0), F.col("_class")) / F.tan("elevation") + margin) * (1 + 1e-9)
    t = t.withColumns({
        "west": F.greatest(west, F.col("tx0") - far / F.col("_mx")), "east": F.least(east, F.col("tx1") + far / F.col("_mx")),
        "south": F.greatest(south, F.col("ty0") - far / F.col("_my")), "north": F.least(north, F.col("ty1") + far / F.col("_my")),
    })
    catalog = kinds.withColumns({"min_lon": F.col("x0"), "max_lon": F.col("x1"), "min_lat": F.col("y0"), "max_lat": F.col("y1")})
    catalog = catalog.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    gap = lambda a0, a1, b0, b1, m: F.greatest(F.lit(0.0), F.greatest(F.col(b0) - F.col(a1), F.col(a0) - F.col(b1)) * F.col(m))
    apart = F.hypot(gap("tx0", "tx1", "x0", "x1", "_mx"), gap("ty0", "ty1", "y0", "y1", "_my"))
    met = box_join(t, catalog, ["_class", "_deal"], globe=False, spread=True, highest=highest, parts=int(buildings.sparkSession.conf.get("spark.sql.shuffle.partitions"))).where(apart <= F.col("height") / F.tan("elevation") + margin)
    return met.select("task_id", F.explode("_ids").alias("_id")).select("task_id", "_id.building_id")


def indoor_by_partition(points: DataFrame, partitions: DataFrame, cell: int) -> DataFrame:
    """As ``indoor``, of footprints stored by the cell (px, py, whole numbers of ``cell`` units) that they touch, one row a cell: a point
    reads the partition it lies in, so that only those partitions are scanned. Different positions meet different shapes first."""
    at = lambda c: F.floor(F.col(c) / cell)
    p = points.select("row_index", "x", "y").where("x is not null and y is not null")
    b = partitions.where(F.size("ring") > 0).select("building_id", ring_edges().alias("edges"), *ring_bounds(), "px", "py")
    boxed = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    spots = p.select("x", "y").distinct().withColumn("px", at("x")).withColumn("py", at("y"))
    met = spots.join(b.drop("building_id").distinct().hint("merge"), ["px", "py"]).where(boxed & in_ring(F.col("x"), F.col("y"))).select("x", "y", "px", "py", "edges")
    return _paired(p, met, b.select("building_id", "px", "py", "edges"), "edges", ["px", "py"])


def sun_profile(points: DataFrame, by: list[str], step_s: int) -> DataFrame:
    """Per ``by`` of points (lit, in_shadow) at instants ``step_s`` apart: minutes in the sun."""
    return points.groupBy(*by).agg((F.count_if(F.col("lit") & ~F.col("in_shadow")) * step_s / 60).alias("sun_min"))


def nearest_by_hour(points: DataFrame, readings: DataFrame, by: str, value: str | list[str]) -> DataFrame:
    """points with values of the reading nearest to their hour: each (hour, ``by``) is looked up once, its points share the answer."""
    keyed = points.withColumn("_hour", F.floor(F.col("timestamp") / 3600) * 3600)
    keys = keyed.select(F.col("_hour").alias("timestamp"), by).distinct()
    told = nearest_in_time(keys, readings, by, value).withColumnRenamed("timestamp", "_hour")
    return keyed.join(told, ["_hour", by], "left").drop("_hour")
