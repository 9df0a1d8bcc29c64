"""Column expressions of positions, time and light."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, MERCATOR_M, MAX_LAT = 6_371_000.0, 6_378_137.0, 85.05112878
#: Metres of a degree: two figures are in use, each by the operators that name it.
DEGREE_M, SHORT_DEGREE_M = 111_320.0, 111_000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda a: F.pow(F.sin(F.radians(a) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would make an unknown distance the longest


def mercator_cell(lon: Column, lat: Column, size_m: float) -> tuple[Column, Column]:
    """(x, y) of the square cell: a routing key only, never a position. Null positions have none."""
    clamped = F.when(lat.isNotNull(), F.greatest(F.least(lat, F.lit(MAX_LAT)), F.lit(-MAX_LAT)))
    x, y = F.radians(lon) * MERCATOR_M, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(clamped) / 2)) * MERCATOR_M
    return F.floor(x / size_m), F.floor(y / size_m)


def sunlight_factor(cloud: Column) -> Column:
    """Share of sunlight that clouds let through; unknown cloud gives no factor."""
    held = F.greatest(F.lit(0.15), 1 - 0.85 * F.greatest(F.lit(0.0), F.least(cloud, F.lit(1.0))))
    return F.when(cloud.isNotNull(), held)


def equirect_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on a plane at the mean latitude."""
    dx = (lon2 - lon1) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + F.pow((lat2 - lat1) * DEGREE_M, 2))


def bounds_diagonal_m(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Diagonal of a box by 111,000 m a degree."""
    return F.hypot((north - south) * SHORT_DEGREE_M, (east - west) * SHORT_DEGREE_M * F.cos(F.radians((north + south) / 2)))


def nonzero_box(west: Column, south: Column, east: Column, north: Column, margin: float = 1e-5) -> tuple[Column, ...]:
    """The box, widened by ``margin`` on both sides where it has no width, or no height, or less."""
    thin, flat = east - west <= 0, north - south <= 0
    grow = lambda v, test, by: F.when(test, v + by).otherwise(v)
    return grow(west, thin, -margin), grow(south, flat, -margin), grow(east, thin, margin), grow(north, flat, margin)


def expand_box(west: Column, south: Column, east: Column, north: Column, metres: float) -> tuple[Column, ...]:
    """The box with ``metres`` on each side; none at or below 0."""
    if metres <= 0:
        return west, south, east, north
    lat = metres / SHORT_DEGREE_M
    lon = lat / F.greatest(F.cos(F.radians((north + south) / 2)), F.lit(1e-6))
    return nonzero_box(west - lon, south - lat, east + lon, north + lat)


def mercator_cell_bounds(x: Column, y: Column, size_m: float) -> tuple[Column, ...]:
    """(west, south, east, north) of a square cell."""
    lat = lambda v: F.degrees(2 * F.atan(F.exp(v * size_m / MERCATOR_M)) - math.pi / 2)
    lon = lambda v: F.degrees(v * size_m / MERCATOR_M)
    return lon(x), lat(y), lon(x + 1), lat(y + 1)


def cell_roundup(base: Column, wanted: Column) -> Column:
    """The multiple of the base cell that holds the wanted one: 0 where none is wanted, the base where it is smaller."""
    return F.when(wanted <= 0, 0.0).when(wanted <= base, base.cast("double")).otherwise(F.ceil(wanted / base) * base.cast("double"))


def metres_to_degrees(metres: Column, lat: Column) -> Column:
    """The larger of the degrees east and north that hold so many metres, either sign; the cosine is 0.1 at least."""
    m = F.abs(metres)
    return F.when(lat.isNotNull(), F.greatest(m / SHORT_DEGREE_M, m / (SHORT_DEGREE_M * F.greatest(F.lit(0.1), F.abs(F.cos(F.radians(lat)))))))


def web_tile(lon: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """(x, y) of the web map tile."""
    n, phi = F.pow(F.lit(2.0), zoom), F.radians(lat)
    return F.floor((lon + 180) / 360 * n), F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)


def web_tile_bounds(x: Column, y: Column, zoom: Column) -> tuple[Column, ...]:
    """(west, south, east, north) of a web map tile."""
    n = F.pow(F.lit(2.0), zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def web_tiles(west: Column, south: Column, east: Column, north: Column, zoom: int, first: int = 20) -> Column:
    """array<struct<x,y>>: the first tiles of a box, by x, then y."""
    x0, y0 = web_tile(west, north, F.lit(zoom))
    x1, y1 = web_tile(east, south, F.lit(zoom))
    pairs = F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return F.slice(pairs, 1, first)


def grid_key(lon: Column, lat: Column, per_degree: float) -> tuple[Column, Column]:
    """Cell numbers of a grid of ``per_degree`` cells a degree (0.5: cells of two degrees)."""
    return F.floor(lon * per_degree), F.floor(lat * per_degree)


def ring_area_deg(ring: Column) -> Column:
    """Area of a closed ring (array<struct<x,y>>) in squared units of its coordinates, by the shoelace rule."""
    after = F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    before = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    terms = F.zip_with(before, after, lambda p, q: p.x * q.y - q.x * p.y)
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def ring_area_m2(ring: Column) -> Column:
    """Area of a closed ring of degrees, by 111,000 m a degree both ways."""
    return ring_area_deg(ring) * SHORT_DEGREE_M * SHORT_DEGREE_M


def ring_center(ring: Column) -> Column:
    """struct<x,y>: mean of the vertices; null for an empty ring."""
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(ring), F.lit(0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def close_ring(ring: Column) -> Column:
    """The ring with its first vertex at its end too; closed and empty rings stay."""
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    return F.when((F.size(ring) > 0) & ((first.x != last.x) | (first.y != last.y)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def ring_issues(ring: Column) -> Column:
    """array<string> of what is wrong with a ring of degrees: ``incomplete`` (fewer than four vertices, or null: nothing else is
    looked at), ``out_of_range``, ``open``, ``area`` (below 1 m² or above 10 km²). Empty: none."""
    short = F.coalesce(F.size(ring) < 4, F.lit(True))
    first, last = F.try_element_at(ring, F.lit(1)), F.try_element_at(ring, F.lit(-1))
    area = ring_area_m2(ring)
    found = F.array(
        F.when(F.exists(ring, lambda p: (F.abs(p.x) > 180) | (F.abs(p.y) > 90)), "out_of_range"), F.when((first.x != last.x) | (first.y != last.y), "open"),
        F.when((area < 1) | (area > 1e7), "area"),
    )
    return F.when(short, F.array(F.lit("incomplete"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """(share of box a that b covers in per cent, metres between the centres where they do not overlap, aligned): aligned are
    boxes that overlap by more than 80 per cent. Boxes are (west, south, east, north)."""
    w, s, e, n = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    meets = (w < e) & (s < n)
    share = F.when(meets, (e - w) * (n - s) / ((a[2] - a[0]) * (a[3] - a[1])) * 100).otherwise(0.0)
    mid = lambda box: ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    apart = F.when(meets, 0.0).otherwise(haversine_m(*mid(a), *mid(b)))
    return share, apart, meets & (share > 80) & (apart < 100)


def dem_elevation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """(metres, valid) of an elevation in three bytes: invalid outside -500..9000 or where all are 0 or all are 255."""
    metres = r * 256 + g + b / 256 - 32768
    flat = ((r == 0) & (g == 0) & (b == 0)) | ((r == 255) & (g == 255) & (b == 255))
    return metres, metres.between(-500, 9000) & ~flat


def shade_level(percent: Column) -> Column:
    """``none`` below 10, ``light`` below 25, ``medium`` below 50, ``heavy`` below 75, else ``full``."""
    return F.when(percent < 10, "none").when(percent < 25, "light").when(percent < 50, "medium").when(percent < 75, "heavy").otherwise("full")


def dashes(lon1: Column, lat1: Column, lon2: Column, lat2: Column, dash_m: float, gap_m: float) -> Column:
    """array<struct<x0,y0,x1,y1>>: the dashes of a stretch, each ``dash_m`` long but the last, ``gap_m`` apart; a stretch shorter
    than 1.25 dashes, or of no length, stays whole."""
    total = equirect_m(lon1, lat1, lon2, lat2)
    at = lambda m: (lon1 + (lon2 - lon1) * m / total, lat1 + (lat2 - lat1) * m / total)

    def dash(k):
        begin = k * (dash_m + gap_m)
        (x0, y0), (x1, y1) = at(begin), at(F.least(begin + dash_m, total))
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    whole = F.array(F.struct(lon1.alias("x0"), lat1.alias("y0"), lon2.alias("x1"), lat2.alias("y1")))
    short = F.coalesce(total < dash_m * 1.25, F.lit(True))
    return F.when(short, whole).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(total / (dash_m + gap_m)) - 1), dash))


def gfs_indices(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(lat index, lon index) of a 0.25 degree grid from 90 north down and from 0 east: half rounds up."""
    half_up = lambda v: F.floor(v + 0.5)
    held = F.when(lat.isNotNull(), F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)))
    return half_up((90 - held) / 0.25), half_up(F.pmod(lon, F.lit(360.0)) / 0.25)


def gfs_run(seconds: Column) -> tuple[Column, Column, Column]:
    """(epoch second of the last run at 0, 6, 12 or 18 UTC, forecast hour, index of the three-hour step) for an instant."""
    run = F.floor(seconds / 21600) * 21600
    hour = F.floor((seconds - run) / 3600 + 0.5)
    return run, hour, F.floor(hour / 3 + 0.5)


def hilbert_key(x: Column, y: Column, west: float, south: float, east: float, north: float, bits: int = 16) -> Column:
    """Place of a position along a Hilbert curve of 2**bits by 2**bits cells over the box: neighbours on the curve are neighbours on the
    ground. Positions outside are held to the box; a null position has none."""
    last = (1 << bits) - 1
    cell = lambda v, a, b: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((v - a) / ((b - a) or 1.0) * (last + 1)))).cast("long")
    start = F.struct(cell(x, west, east).alias("x"), cell(y, south, north).alias("y"), F.lit(0).cast("long").alias("d"))

    def finer(state: Column, step: Column) -> Column:
        """The quadrant's place among four, and the position turned and mirrored into that quadrant's own frame."""
        side = F.call_function("shiftleft", F.lit(1).cast("long"), step.cast("int"))
        right, up = state.x.bitwiseAND(side) > 0, state.y.bitwiseAND(side) > 0
        place = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        mirror = ~up & right
        fx, fy = F.when(mirror, last - state.x).otherwise(state.x), F.when(mirror, last - state.y).otherwise(state.y)
        return F.struct(F.when(up, fx).otherwise(fy).alias("x"), F.when(up, fy).otherwise(fx).alias("y"), (state.d + side * side * place).alias("d"))

    walked = F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, finer, lambda state: state.d)
    return F.when(x.isNotNull() & y.isNotNull(), walked)
