"""Buildings above the search height of the shadow join."""

from pyspark.sql import functions as F

from solterra.operators import light


def test_towers_shade_as_a_search_without_bound_says(spark):
    ring = [(float(x), float(y)) for x, y in ((-20, -20), (20, -20), (20, 20), (-20, 20))]
    towers = spark.createDataFrame([(1, 300.0, ring)], "building_id long, height double, ring array<struct<x:double,y:double>>")
    at = [(0, 0.0, 0.0), *((k, 90.0 * k * x, 90.0 * k * y) for k in range(1, 14) for x in (-1, 0, 1) for y in (0, 1))]
    points = spark.createDataFrame([(i, 1718980000 + 3600 * (i % 3), x, y) for i, (_, x, y) in enumerate(at)], "row_index long, timestamp long, x double, y double")
    points = points.withColumn("lon", F.lit(-74.0)).withColumn("lat", F.lit(40.7))
    got, wanted = ({r.row_index: r.in_shadow for r in light.shadowed(points, towers, h).collect()} for h in (60.0, 1000.0))
    assert got == wanted and any(got.values()) and not all(got.values())


def _square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_points_on_an_edge_or_a_corner_are_indoors_and_those_beside_it_not(spark):
    ring = "building_id long, height double, ring array<struct<x:long,y:long>>"
    b = spark.createDataFrame([(1, 5.0, [(0, 0), (6, 2), (4, 8)]), (2, 5.0, [(0, 0), (6, 2), (4, 8), (0, 0)]), (3, 1.0, []), (4, None, None)], ring)
    at = {0: (0, 0), 1: (3, 1), 2: (5, 5), 3: (2, 4), 4: (3, 2), 5: (6, 3), 6: (2, 5), 7: (None, 1), 8: (250, 250)}
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in at.items()], "row_index long, x long, y long")
    got = sorted(tuple(r) for r in light.indoor(points, b, cell=3.0).collect())
    assert got == sorted((i, k) for i in (0, 1, 2, 3, 4) for k in (1, 2))
    assert light.indoor(points, b.limit(0)).count() == 0 == light.indoor(points.limit(0), b).count()


def test_a_wall_of_ten_metres_throws_a_shadow_as_long_as_the_sun_says(spark):
    import math

    b = spark.createDataFrame([(1, 10.0, _square(-500.0, -1.0, 500.0, 0.0)), (2, 100.0, _square(900.0, -1.0, 2900.0, 0.0)), (3, None, _square(5000.0, 5000.0, 5001.0, 5001.0))], "building_id long, height double, ring array<struct<x:double,y:double>>")
    noon = spark.range(1).select(F.lit(1711213020).alias("timestamp"), F.lit(0.0).alias("lon"), F.lit(45.0).alias("lat"))  # equinox, sun due south
    alt, az = noon.selectExpr(light.solar.altitude(), light.solar.azimuth()).first()
    far = math.cos(az) / math.tan(alt)
    ys = [0.0, far * 10 - 0.1, far * 10 + 0.1, -0.5, -1.5]
    rows = [(k, 0.0, y) for k, y in enumerate(ys)] + [(10, 1900.0, far * 100 - 0.1), (11, 1900.0, far * 100 + 0.1), (12, None, 1.0), (13, 5000.5, 5000.5)]
    points = spark.createDataFrame(rows, "row_index long, x double, y double").crossJoin(noon)
    got = {r.row_index: (r.lit, r.in_shadow) for r in light.shadowed(points, b, max_height=60.0).collect()}
    assert {k for k, (_, s) in got.items() if s} == {0, 1, 3, 10, 13} and all(lit for lit, _ in got.values())


def test_nearest_reading_takes_the_earlier_of_two_and_none_beyond_the_limit(spark):
    r = spark.createDataFrame([("a", 0, 1.0), ("a", 100, 2.0), ("a", 1000, None), ("b", 50, 9.0), (None, 1, 7.0), ("a", None, 5.0)], "k string, timestamp long, v double")
    p = spark.createDataFrame([(0, "a", 50), (1, "a", 51), (2, "a", 700), (3, "a", 130), (4, "c", 0), (5, None, 1), (6, "a", None)], "i long, k string, timestamp long")
    assert {x.i: x.v for x in light.nearest_in_time(p, r, "k", "v", tolerance=200).collect()} == {0: 1.0, 1: 2.0, 2: None, 3: 2.0, 4: None, 5: None, 6: None}
    assert light.nearest_in_time(p, r.limit(0), "k", "v").where("v is not null").count() == 0
