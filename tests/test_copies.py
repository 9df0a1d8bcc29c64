"""Tables of many copies, files in any order, and joins whose sides are both large."""

import datetime
import glob
import math

import pytest
from pyspark.sql import functions as F

from solterra import registry
from solterra.operators import areas, exposure, light
from solterra.operators import graph as gr
from solterra.operators import mobility as m
from solterra.plans.mobility import _points, _runs
from solterra.plans.solver import _targets
from solterra.sources import files
from solterra.sources.views import stays

SF = "/root/testdata/sf0.001"
HOUSE = "array(named_struct('x', 0L, 'y', 0L), named_struct('x', 10L, 'y', 0L), named_struct('x', 10L, 'y', 10L), named_struct('x', 0L, 'y', 10L))"


@pytest.fixture(scope="module")
def houses(spark):
    """Fifty copies of one footprint, of heights 1 to 50."""
    return spark.range(50).selectExpr("id as building_id", "cast(id + 1 as double) as height", f"{HOUSE} as ring")


def _points_of(spark, n, x="id % 2 * 15L"):
    return spark.range(n).selectExpr("id as row_index", "1718971200L + id % 3 * 3600 as timestamp", "-74.0D as lon", "40.7D as lat", f"{x} as x", "5L as y")


def test_copies_of_positions_and_footprints_are_tested_once(spark, houses):
    points = _points_of(spark, 100)
    assert [tuple(r) for r in light._met(points, light.shapes_of(houses), 100.0).select("x", "y").collect()] == [(0, 5)]
    assert light.indoor(points, houses).count() == 50 * 50
    assert {(r.rings, r.first) for r in light.indoor_counts(points, houses).collect()} == {(50, 0)}
    assert light.indoor_counts(points, houses).count() == 50
    assert [tuple(r) for r in light.covered_spots(points, houses).collect()] == [(0, 5)]
    stored = houses.withColumn("px", F.lit(0)).withColumn("py", F.lit(0)).unionByName(houses.withColumn("px", F.lit(1)).withColumn("py", F.lit(0)))
    assert light.indoor_by_partition(points, stored, 8).count() == 50 * 50


def test_of_copies_the_highest_alone_throws_the_shadow(spark, houses):
    assert [tuple(r)[:2] for r in light.tallest(houses).collect()] == [(0, 50.0)]
    points, alone = _points_of(spark, 3000, "id % 60 - 30L"), houses.where("building_id = 49")
    one, many = ({tuple(r) for r in light.shadowed(points, b, 20.0).collect()} for b in (alone, houses))
    assert one == many and len(one) == 3000 and {r[2] for r in one} == {True, False}
    rings = lambda b: b.select(F.lit(1).alias("g"), F.explode(areas.shadow_rings(F.col("ring"), F.col("height"), F.col("height") / 2)).alias("ring"))
    area = lambda b: areas.union_area(rings(b), ["g"], 25.0).agg(F.sum("area")).first()[0]
    assert area(light.tallest(houses)) == pytest.approx(850.0, abs=1e-6) == area(houses)


def test_copies_within_reach_come_each(spark, houses):
    flat = houses.select("building_id", "height", *light.ring_bounds("ring"))
    target = spark.sql("select 7L as task_id, 40L as x0, 41L as x1, 0L as y0, 1L as y1, radians(45D) as elevation")
    assert sorted(r.building_id for r in light.within_reach(target, flat, 0.0, plane=True).collect()) == list(range(29, 50))  # thirty metres away


@pytest.mark.parametrize("name", ["fn_shadow_wall", "agg_sun_profile", "join_point_task", "join_indoor", "fn_point_in_ring", "join_point_shadow_ring", "join_point_shadow"])
def test_no_side_that_grows_is_planned_to_be_sent_whole(spark, name):
    """Before anything is known of sizes: the size of a file says nothing of the rows that are made of it."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


def test_tasks_of_stays_are_those_of_their_points(spark):
    runs = _runs(spark, SF).where("point_count > 1")
    got = m.stay_tasks(stays(spark, SF), runs).select("row_index", "minute_ts", "point_count")
    points = _points(spark, SF)
    wanted = gr.points_of(points.select("row_index", *m.KEYS), m.cells(points).where("point_count > 1").select(*m.KEYS, "point_count"), m.KEYS).select(*got.columns)
    assert got.count() > 0 and got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_traces_keep_their_last_instant(spark):
    """total * duration / duration is often a little more than the total."""
    v = spark.range(4000).selectExpr("id div 2 as route", "id % 2 as place", "id % 2 * (0.001D + id * 1e-6D) as lon", "0D as lat")
    got = exposure.route_trace(v, "route", 30).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("offset_s").alias("last"))
    assert got.count() == 2000 and got.where("n <> greatest(2, last div 30 + 1)").isEmpty()
    sound = exposure.track_summary(v.withColumnsRenamed({"place": "timestamp"}), "route", ["timestamp"]).select("route", "metres")
    assert got.join(sound, "route").where("n <> greatest(2, floor(floor(metres / 1.4) / 30) + 1)").isEmpty()


def test_a_file_of_one_user_a_user(spark, tmp_path):
    rows = spark.range(200, numPartitions=4).selectExpr("id % 5 + 100 as ad_id", "id as row_index")
    files.write_user_files(rows, "ad_id", str(tmp_path / "u"))
    assert len(glob.glob(str(tmp_path / "u/prefix=10/user=*/*.csv"))) == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "u")).count() == 200


def test_sessions_of_files_in_any_order_lose_no_row(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(hours=k), k % 3, 1.0) for k in range(300)]
    for part in (rows[200:], rows[:100], rows[100:200]):
        spark.createDataFrame(part, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = registry.QUERIES["stm_session_gap"](spark, str(tmp_path))
    assert got.agg(F.sum("n")).first()[0] == 300 and got.count() == 300


def test_rounding_is_half_to_even_without_decimals(spark):
    rows = spark.createDataFrame([(0.000005, -0.000015), (-73.999995, 40.700005), (None, float("nan"))], "lon double, lat double")
    units = light.to_units(rows.where("lon is not null"))
    wanted = rows.where("lon is not null").select(F.bround(F.col("lon") * light.UNITS).cast("long").alias("x"), F.bround(F.col("lat") * light.UNITS).cast("long").alias("y"))
    assert units.select("x", "y").collect() == wanted.collect()
    for name in ("fn_point_in_ring", "pipe_indoor", "pipe_task_graph_rows"):
        assert "bround" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_a_footprint_travel_by_blocks(spark, houses, monkeypatch):
    monkeypatch.setattr(light, "BLOCK_IDS", 16)
    points = _points_of(spark, 100)
    got = light.indoor(points, houses)
    assert got.distinct().count() == got.count() == 50 * 50
    last = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "explode(_ids" in last and "edges" not in last
    named = houses.withColumn("building_id", F.concat(F.lit("b"), "building_id"))
    assert light.indoor(points, named).distinct().count() == 50 * 50


def test_a_bundle_of_rays_meets_its_walls_once(spark, houses):
    def obstacles(n):
        up = spark.range(n).selectExpr("0L as _f", "0L as _gx", "0L as _gy", "0L as _sector", "0L as _length", "id % 7 as x", "5L as y", "1D + id % 3 * 0.01 as ux", "1D as uy")
        return light._obstacles(up, houses, 60.0, 10.0, 100.0, True)

    for n in (21, 2000):
        assert [o.count() for o in obstacles(n)] == [2, 1]  # the two walls on the sunny side and the footprint
    points = spark.range(10).selectExpr("id as row_index", "1718971200L as timestamp", "-74.0D as lon", "40.7D as lat", "id * 30 as x", "5L as y")
    plan = light.shadowed(points, houses, 60.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2


def test_shaded_rays_keep_their_columns_and_are_those_in_shadow(spark, houses):
    points = _points_of(spark, 3000, "id % 60 - 30L")
    wanted = light.shadowed(points, houses, 20.0).where("in_shadow").select("row_index")
    rays = light.with_sun(points).where(F.col("alt") > F.radians(F.lit(5)))
    got = light.shaded(rays, houses, 20.0)
    assert got.columns == rays.columns and wanted.count() > 0
    assert got.select("row_index").distinct().exceptAll(wanted).isEmpty() and wanted.exceptAll(got.select("row_index").distinct()).isEmpty()


@pytest.mark.parametrize("name", ["pipe_sunlight_file_minute", "agg_irbm_day"])
def test_a_stay_meets_the_buildings_by_bundle_before_the_weather(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "bround" not in plan
    assert plan.index("Window") < plan.index("LeftSemi")  # the weather's windows stand over the shadow's joins


def test_coverage_rounds_corners_without_decimals(spark):
    assert "bround" not in registry.QUERIES["agg_coverage"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_reach_become_rows_after_the_last_shuffle(spark, monkeypatch):
    monkeypatch.setattr(light, "REACH_IDS", 50)
    heights = [None, 0.0, -4.0, 1.0, 8.0, 9.0, 40.0, 700.0]
    rows = [(i, heights[i % 8], i % 16 // 2 * 30, i % 16 // 2 * 30 + 10, i % 3 * 40, i % 3 * 40 + 10) for i in range(400)]
    b = spark.createDataFrame(rows, "building_id long, height double, x0 long, x1 long, y0 long, y1 long")
    sun = [1e-14, 1e-6, 0.02, 0.1, 0.17, 0.5, 1.2, 0.0, -0.3, None]
    targets = [(k, x, x + 20, 5, 25, e) for k, (x, e) in enumerate((x, e) for x in (-500, 0, 130, 900) for e in sun)]
    t = spark.createDataFrame(targets, "task_id long, x0 long, x1 long, y0 long, y1 long, elevation double")
    out = light.within_reach(t, b, 25.0, plane=True)
    apart = lambda a0, a1, b0, b1: max(0, b0 - a1, a0 - b1)
    wanted = sorted((k, i) for k, x0, x1, y0, y1, e in targets if e and e > 0 for i, h, bx0, bx1, by0, by1 in rows if math.hypot(apart(x0, x1, bx0, bx1), apart(y0, y1, by0, by1)) <= max(h or 0.0, 0.0) / math.tan(e) + 25)
    assert sorted(tuple(r) for r in out.collect()) == wanted and len(wanted) > 1000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("explode(_ids") < plan.index("Join")  # nothing is joined or dealt out above it


def test_join_reach_takes_targets_of_any_sun_above_the_horizon(spark):
    d = "/root/testdata/sf0.001"
    low = _targets(spark, d).where("elevation > 0 and elevation <= radians(10)").select("task_id")
    assert registry.QUERIES["join_reach"](spark, d).join(low, "task_id", "left_semi").count() > 0
