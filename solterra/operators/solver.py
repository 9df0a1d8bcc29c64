"""The exact solver: tasks as execution units of bounded size, each with the obstacles that can shade it, and the light of its points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import rest
from .boxes import box_join
from .graph import halves
from .light import NORTH_M, east_metres, frame_of, in_ring, ring_bounds, ring_edges, with_sun

UNIT_KEYS = ["task_id", "part"]


def _units(points: DataFrame) -> DataFrame:
    """(task_id, part, n, x0 .. y1, elevation): a unit's points, their bounds, and the sun at their middle at the first instant."""
    units = points.groupBy(*UNIT_KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("timestamp").alias("timestamp"))
    units = units.withColumns({"lon": (F.col("x0") + F.col("x1")) / 200_000, "lat": (F.col("y0") + F.col("y1")) / 200_000})
    return with_sun(units).withColumnRenamed("alt", "elevation").drop("lon", "lat", "az")


def _within(units: DataFrame, boxes: DataFrame, metres: str) -> DataFrame:
    """units with the boxes (building_id, height, b0 .. t1) that lie no farther from theirs than the column ``metres``."""
    east = east_metres(frame_of((F.col("y0") + F.col("y1")) / 2))
    around = units.withColumns({
        "west": F.col("x0") - F.col(metres) / east, "east": F.col("x1") + F.col(metres) / east, "south": F.col("y0") - F.col(metres) / NORTH_M, "north": F.col("y1") + F.col(metres) / NORTH_M,
    })
    catalog = boxes.withColumns({"min_lon": F.col("b0"), "max_lon": F.col("b1"), "min_lat": F.col("t0"), "max_lat": F.col("t1")})
    return box_join(around, catalog, globe=False, spread=True).drop("west", "east", "south", "north", "min_lon", "max_lon", "min_lat", "max_lat")


def with_context(units: DataFrame, boxes: DataFrame, most_m: float, least_m: float, margin_m: float) -> DataFrame:
    """units with context_m and reason: how far obstacles are looked for. ``most_m``, or where the sun is up and obstacles lie within
    that, the shadow of the highest of them and a margin, held to least_m..most_m (``height_solar``; else ``fallback``)."""
    bounds = ["x0", "x1", "y0", "y1"]  # units of equal bounds look once, and at the highest of equal boxes
    highest = boxes.groupBy("b0", "b1", "t0", "t1").agg(F.max("height").alias("height"))
    near = _within(units.select(*bounds).distinct().withColumn("_most", F.lit(float(most_m))), highest, "_most")
    known = units.join(near.groupBy(*bounds).agg(F.max("height").alias("_h")), bounds, "left")
    told = (F.col("elevation") > 0) & F.col("_h").isNotNull()
    reach = F.col("_h") / F.tan(F.greatest("elevation", F.radians(F.lit(0.01)))) + margin_m
    held = F.least(F.lit(float(most_m)), F.greatest(F.lit(float(min(least_m, most_m))), reach))
    return known.withColumns({"context_m": F.when(told, held).otherwise(float(most_m)), "reason": F.when(told, "height_solar").otherwise("fallback")}).drop("_h")


def obstacles_of(units: DataFrame, boxes: DataFrame, margin_m: float) -> DataFrame:
    """(task_id, part, building_id) of units (see ``with_context``): obstacles within the context that can shade the unit's box at
    its elevation, a margin added."""
    met = _within(units.where("elevation > 0"), boxes, "context_m")
    east = east_metres(frame_of((F.col("y0") + F.col("y1")) / 2))
    gap = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.greatest(F.col(b0) - F.col(a1), F.col(a0) - F.col(b1)))
    apart = F.hypot(gap("x0", "x1", "b0", "b1") * east, gap("y0", "y1", "t0", "t1") * NORTH_M)
    return met.where(apart <= F.col("height") / F.tan("elevation") + margin_m).select(*UNIT_KEYS, "building_id")


def execution_units(
    points: DataFrame, buildings: DataFrame, most_points: int, most_obstacles: int, least: int = 1, levels: int = 12, most_m: float = 700.0, least_m: float = 50.0, margin_m: float = 25.0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with part, units, their obstacles) of points (task_id, row_index, timestamp, lon, lat, x, y) and buildings.

    A task is a unit; one of more than ``most_points`` points, or of more obstacles that can shade it than ``most_obstacles``, is
    cut in halves (see ``halves``), and these again, ``levels`` times at most and never into units of fewer than ``least``
    points. units: (task_id, part, n, bounds, elevation, context_m, reason, obstacles, over); over names the units that could
    not be cut small enough. Only units that are still too large are ranked again. A unit's obstacles are found by a
    join of boxes of any size, so that no unit and no building is too large for a cell."""
    tall = F.greatest(F.coalesce("height", F.lit(0.0)), F.lit(0.0)).alias("height")
    boxes = rest(buildings.where(F.size("ring") > 0).select("building_id", tall, *ring_bounds()).toDF("building_id", "height", "b0", "b1", "t0", "t1"))

    def measured(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        units = rest(with_context(_units(some), boxes, most_m, least_m, margin_m))
        pairs = rest(obstacles_of(units, boxes, margin_m))
        many = pairs.groupBy(*UNIT_KEYS).agg(F.count(F.lit(1)).alias("obstacles"))
        units = units.join(many, UNIT_KEYS, "left").withColumn("obstacles", F.coalesce("obstacles", F.lit(0)).cast("long"))
        return units.withColumn("over", (F.col("n") > most_points) | (F.col("obstacles") > most_obstacles)), pairs

    columns = ["task_id", "row_index", "timestamp", "lon", "lat", "x", "y"]
    open_ = rest(points.where("x is not null and y is not null and timestamp is not null").select(*columns, F.lit(1).cast("long").alias("part")))
    done: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    for level in range(levels + 1):
        units, pairs = measured(open_)
        cut = rest(units.where("over").where(F.floor(F.col("n") / 2) >= max(1, least)).select(*UNIT_KEYS)) if level < levels else None
        if cut is None or cut.isEmpty():
            done.append((open_, units, pairs))
            break
        final = [df.join(cut, UNIT_KEYS, "left_anti") for df in (open_, units, pairs)]
        done.append(tuple(final))
        open_ = rest(halves(open_.join(cut, UNIT_KEYS, "left_semi").select(*columns, "part"), ["task_id"], F.lit(True), max(1, least)))
    out = []
    for k in range(3):
        whole = done[0][k]
        for more in done[1:]:
            whole = whole.unionByName(more[k])
        out.append(whole)
    return tuple(out)


def solve(points: DataFrame, pairs: DataFrame, buildings: DataFrame, min_altitude: float) -> DataFrame:
    """(task_id, row_index, sunlit): points of units (see ``execution_units``) against their unit's obstacles alone. A point is sunlit if the sun
    stands above ``min_altitude`` and neither a wall's shadow nor a footprint covers it."""
    mx, my = east_metres(frame_of(F.col("y"))), NORTH_M
    sun = with_sun(points.select("task_id", "part", "row_index", "timestamp", "lon", "lat", "x", "y")).select("task_id", "part", "row_index", "x", "y", "alt", "az")
    up = sun.where(F.col("alt") > min_altitude).withColumns({"ux": F.sin("az") / F.tan("alt") / mx, "uy": F.cos("az") / F.tan("alt") / my})
    shapes = buildings.where(F.size("ring") > 0).select("building_id", F.coalesce("height", F.lit(0.0)).alias("height"), ring_edges().alias("edges"))
    met = up.join(pairs, UNIT_KEYS).join(shapes.hint("merge"), "building_id")
    walls = met.select("row_index", "x", "y", "ux", "uy", "height", F.explode("edges").alias("e")).select("row_index", "x", "y", "ux", "uy", "height", "e.*")
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    dx, dy = F.col("height") * F.col("ux"), F.col("height") * F.col("uy")
    det = (bx - ax) * dy - (by - ay) * dx
    s, t = (x - ax) * dy - (y - ay) * dx, (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    between = lambda v: F.when(det > 0, (v >= 0) & (v <= det)).when(det < 0, (v <= 0) & (v >= det))
    shaded = walls.where((det != 0) & between(s) & between(t)).select("row_index").unionByName(met.where(in_ring(x, y)).select("row_index")).distinct()
    lit = sun.join(shaded.withColumn("_hit", F.lit(True)), "row_index", "left")
    return lit.select("task_id", "row_index", F.coalesce((F.col("alt") > min_altitude) & F.col("_hit").isNull(), F.lit(False)).cast("int").alias("sunlit"))
