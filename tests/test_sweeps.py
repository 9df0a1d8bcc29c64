"""Joins of boxes of any size, areas by plane sweep, daylight as intervals and tasks as runs, each against the long way."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solterra.functions import solar
from solterra.operators import areas, boxes, daylight, light
from solterra.operators import mobility as m

BOX, CATALOG = "i long, west double, south double, east double, north double", "j long, min_lon double, min_lat double, max_lon double, max_lat double"


def some_box(rng, globe):
    size = 10 ** rng.uniform(-4, 1.3) * (rng.random() > 0.05)
    west, south = (rng.uniform(-180, 180), rng.uniform(-80, 60)) if globe else (rng.uniform(-5, 5), rng.uniform(-5, 5))
    if globe and rng.random() < 0.3:
        west = 179.9 - rng.random() * size
    east = west + size * rng.random()
    return west, south, east - 360 * (globe and east > 180 and rng.random() < 0.5), south + size * rng.random()


def stretches(west, east):
    east += 360 * (west > east)
    if east - west >= 360:
        return [(-180, 180)]
    turns = math.floor((west + 180) / 360) * 360
    west, east = west - turns, east - turns
    return [(west, east)] if east < 180 else [(west, 180), (-180, east - 360)]


@pytest.mark.parametrize("globe", [True, False])
def test_boxes_of_all_sizes_meet_as_in_nested_loops(spark, globe):
    rng = random.Random(2)
    left, right = ([some_box(rng, globe) for _ in range(250)] for _ in range(2))
    if globe:
        left += [(-180.0, 0.0, 180.0, 1.0), (-181.0, -1.0, -179.0, 1.0), (170.0, -80.0, 190.0, 80.0), (0.0, 0.0, 0.0, 0.0)]
        right += [(-180.0, -1.0, -179.5, 1.0), (0.0, 0.0, 1.0, 1.0), (-10.0, -5.0, 350.0, 5.0)]
    cross = lambda a, b: any(p[0] <= q[1] and p[1] >= q[0] for p in a for q in b)
    along = (lambda b: stretches(b[0], b[2])) if globe else (lambda b: [(b[0], b[2])])
    wanted = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a[1] <= b[3] and a[3] >= b[1] and cross(along(a), along(b)))
    a = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(left)] + [(9999, None, 0.0, 1.0, 1.0)], BOX)
    b = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(right)], CATALOG)
    assert sorted((r.i, r.j) for r in boxes.box_join(a, b, globe=globe).collect()) == wanted and len(wanted) > 50
    assert boxes.box_join(a.limit(0), b, globe=globe).count() == 0 == boxes.box_join(a, b.limit(0), globe=globe).count()


def test_a_box_is_stored_four_times_at_most(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, *map(float, some_box(rng, False))) for i in range(500)], BOX)
    own = boxes._around(rows, "_l", boxes.LEFT, False).withColumn("_level", boxes.level_of(*(F.col(f"_l{c}") for c in "wsen")))
    assert boxes._cells(own, "_l").groupBy("i").count().agg(F.max("count")).first()[0] <= 4


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def covered(spark, rings, tile=10.0, most=400):
    rows = spark.createDataFrame([(0, r and [(float(x), float(y)) for x, y in r]) for r in rings], "g long, ring array<struct<x:double,y:double>>")
    return areas.union_area(rows, ["g"], tile, most).agg(F.sum("area")).first()[0]


def test_area_of_overlaps_counts_once(spark):
    assert covered(spark, [square(0, 0, 4, 4), square(2, 2, 4, 4)], 1.5) == pytest.approx(28, abs=1e-9)
    assert covered(spark, [square(0, 0, 4, 4), square(0, 0, 4, 4)[::-1], square(-5, -5, 30, 30)], 7.0) == pytest.approx(900, abs=1e-9)
    ell = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
    assert covered(spark, [ell, ell + ell[:1], square(1, 1, 3, 3), [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)], [], None]) == pytest.approx(24, abs=1e-9)
    assert covered(spark, [square(7_400_000, 4_000_000, 1, 1), square(7_400_000.5, 4_000_000, 1, 1)]) == pytest.approx(1.5, abs=1e-9)
    assert covered(spark, [None]) is None


def test_area_does_not_depend_on_tiles_and_is_what_pixels_settle_to(spark):
    rng = random.Random(1)
    rings = []
    for _ in range(60):
        x, y, r = rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(1, 8)
        rings.append([(x + r * math.cos(t), y + r * math.sin(t)) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7)))][:: rng.choice([1, -1])])
    at = (np.arange(2000) + 0.5) / 2000 * 60 - 10
    x, y = np.meshgrid(at, at)
    inside = np.zeros(x.shape, bool)
    for ring in rings:
        odd = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / ((by - ay) or 1) + ax)
        inside |= odd
    first, *others = (covered(spark, rings, tile, most) for tile, most in ((7.0, 400), (9.0, 20), (100.0, 30)))
    assert others == pytest.approx([first, first], abs=1e-8) and first == pytest.approx(inside.mean() * 3600, rel=1e-3)


def test_shadow_of_a_square_is_its_own_ground_and_what_it_sweeps(spark):
    ring = spark.createDataFrame([(square(0.0, 0.0, 10.0, 10.0),)], "ring array<struct<x:double,y:double>>")
    rows = ring.select(F.lit(0).alias("g"), F.explode(areas.shadow_rings(F.col("ring"), F.lit(5.0), F.lit(20.0))).alias("ring"))
    assert areas.union_area(rows, ["g"], 8.0).agg(F.sum("area")).first()[0] == pytest.approx(10 * 10 + 10 * 20 + 5 * 10, abs=1e-9)


def test_lit_runs_are_those_of_every_instant():
    rng = np.random.default_rng(1)
    days = [datetime.datetime(2024, month, day, tzinfo=datetime.timezone.utc).timestamp() for month in (1, 3, 6, 9, 12) for day in (1, 20, 21, 22)]
    first = np.array([rng.choice(days) + rng.integers(0, 86400) for _ in range(500)]).astype(np.int64)
    n, lon = rng.integers(1, 4000, 500), rng.uniform(-180, 180, 500)
    lat = np.concatenate([rng.uniform(-66, 66, 250), rng.uniform(64, 69, 150), rng.uniform(-90, 90, 90), [90.0, -90.0, 89.99, 0.0, 66.56, -66.56, 65.7, 67.4, 23.4, -23.4]])
    for step, above in ((60, 0.0), (600, 5.0), (7, -0.833)):
        row, lo, hi = daylight.lit_runs(first, n, lon, lat, step, above)
        got = [[] for _ in first]
        for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist()):
            got[r].append((a, b))
        for k in range(len(first)):
            lit = solar.altitude_at(first[k] + np.arange(n[k]) * step, lon[k], lat[k]) > np.radians(above)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], lit.astype(int), [0])))).reshape(-1, 2)
            assert got[k] == [(a, b - 1) for a, b in edges.tolist()], (first[k], n[k], lon[k], lat[k])


def test_lit_spans_of_odd_stays(spark):
    day = 1718928000
    rows = [(1, day, day + 3 * 86400, 0.0, 51.0), (2, day, None, 0.0, 51.0), (3, day + 43200, day, 0.0, 51.0), (4, None, day, 0.0, 51.0), (5, day, day + 86400, None, 51.0), (6, day, day + 86400, 20.0, 78.0), (7, day, day + 86400, 20.0, -78.0)]
    stays = spark.createDataFrame(rows, "row_index long, start_time long, end_time long, lon double, lat double")
    got = daylight.lit_spans(stays).groupBy("row_index").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("n")).collect()
    assert {(r.row_index, r.spans) for r in got} == {(1, 3), (3, 1), (6, 1)} and {r.row_index: r.n for r in got}[6] == 1440
    assert daylight.lit_spans(stays.limit(0)).count() == 0
    count = daylight.lit_count(stays.where("start_time is not null"), F.col("start_time"), F.lit(1440), F.col("lon"), F.col("lat")).collect()
    assert {r.row_index: r.lit for r in count}[6] == 1440 and {r.row_index: r.lit for r in count}[5] == 0 == {r.row_index: r.lit for r in count}[7]


def test_runs_hold_the_minutes_of_points(spark):
    rng = random.Random(6)
    rows = [(i, 1718928000 + rng.randrange(20_000), rng.choice([None, 0, 100, 4000, 9000]), rng.choice([0.0, 0.001, 0.5, None]), rng.choice([10.0, 10.0001]), rng.choice([None, "a", "b", "c"])) for i in range(300)]
    stays = spark.createDataFrame(rows, "row_index long, start_time long, length long, lon double, lat double, file_relpath string").withColumn("end_time", F.col("start_time") + F.col("length") - 50)
    points, names = m.task_points(stays), ["minute_ts", "cell_x", "cell_y", "point_count", "file_count", "west", "south", "east", "north"]
    listed = lambda df, columns: sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    runs = m.task_runs(stays)
    assert listed(m.minutes_of_runs(runs), names) == listed(m.cells(points), names)
    by_file = [*m.KEYS, "file_relpath", "point_count"]
    assert listed(m.minutes_of_runs(m.file_runs(stays)), by_file) == listed(points.groupBy(*m.KEYS, "file_relpath").agg(F.count(F.lit(1)).alias("point_count")), by_file)
    night = m.cells(points).withColumns({"lon": (F.col("west") + F.col("east")) / 2, "lat": (F.col("south") + F.col("north")) / 2}).withColumn("is_night", F.coalesce(~(F.expr(solar.altitude("minute_ts")) > 0), F.lit(True)).cast("int"))
    hours = ["minute_date", "minute_hour", "task_count", "point_count", "file_count", "max_files", "night_task_count"]
    assert listed(m.hourly_runs(runs), hours) == listed(m.hourly(night), hours)
    assert m.task_runs(stays.limit(0)).count() == 0
    plan = m.hourly_runs(runs)._jdf.queryExecution().optimizedPlan().toString()
    assert "start_time" in plan and plan.count("explode") <= 6  # by hours and stretches, not by minutes


def test_shadows_are_the_same_wherever_a_scene_lies_in_its_frame(spark):
    """A wall of ten metres, east of it points by metres, at latitudes from the equator to 65 degrees: shade ends where the sun says."""
    afternoon = 1710946800  # of an equinox
    rows, walls, wanted = [], [], {}
    for k, lat in enumerate(range(0, 66, 5)):
        y, east = int(lat * light.UNITS) + 2500, float(light.DEGREE_M * math.cos(math.radians((math.floor((lat * light.UNITS + 2500) / light.FRAME) + 0.5) * light.FRAME / light.UNITS)) / light.UNITS)
        alt = float(solar.altitude_at(np.array([afternoon + 0.0]), 0.0, y / light.UNITS)[0])
        az = spark.range(1).selectExpr(f"{solar.azimuth(str(afternoon), '0.0', str(y / light.UNITS))} as az").first().az
        walls.append((k, 10.0, [(-1, y - 100_00 // 10), (1, y - 100_00 // 10), (1, y + 100_00 // 10), (-1, y + 100_00 // 10)]))
        reach = 10 / math.tan(alt) * math.sin(az) / east  # units eastward that the wall's shadow goes
        for j, share in enumerate((0.5, 0.9, 1.1, 2.0)):
            rows.append((k * 10 + j, afternoon, 0.0, y / light.UNITS, round(1 + reach * share) if reach > 0 else round(-1 + reach * share), y))
            wanted[k * 10 + j] = share < 1
    points = spark.createDataFrame(rows, "row_index long, timestamp long, lon double, lat double, x long, y long")
    b = spark.createDataFrame(walls, "building_id long, height double, ring array<struct<x:long,y:long>>")
    got = {r.row_index: r.in_shadow for r in light.shadowed(points, b, 60.0, plane=False).collect() if r.lit}
    assert len(got) > 30 and got == {k: v for k, v in wanted.items() if k in got}


def test_reach_is_that_of_every_pair(spark):
    rng = random.Random(9)
    targets = [(i, x := rng.randrange(-2000, 2000), x + rng.randrange(30), y := rng.randrange(-2000, 2000), y + rng.randrange(30), rng.choice([None, -0.1, 0.02, 0.3, 1.2])) for i in range(40)]
    houses = [(j, rng.choice([None, 0.0, 3.0, 50.0, 400.0]), x := rng.randrange(-2000, 2000), x + 20, y := rng.randrange(-2000, 2000), y + 20) for j in range(60)]
    t = spark.createDataFrame(targets, "task_id long, x0 long, x1 long, y0 long, y1 long, elevation double")
    b = spark.createDataFrame(houses, "building_id long, height double, x0 long, x1 long, y0 long, y1 long")
    gap = lambda a0, a1, b0, b1: max(0, b0 - a1, a0 - b1)
    wanted = sorted((i, j) for i, *a, e in targets if e and e > 0 for j, h, *c in houses if math.hypot(gap(a[0], a[1], c[0], c[1]), gap(a[2], a[3], c[2], c[3])) <= (h or 0) / math.tan(e) + 25)
    assert sorted(tuple(r) for r in light.within_reach(t, b, 25.0, plane=True).collect()) == wanted and wanted
    assert light.within_reach(t, b.limit(0), 25.0).count() == 0 == light.within_reach(t.limit(0), b, 25.0).count()
