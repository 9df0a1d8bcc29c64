"""Ranks, greedy cuts, halves and the solver's units against folds and sorts in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from solterra.operators import graph, light, quantiles, scans, solver


def fold(rows, most_rows, most):
    out, now = [], None
    for g, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        v = max(v or 0, 0)
        if now != (g,):
            now, chunk, n, total = (g,), 0, 0, 0
        if n and (n >= most_rows or (most > 0 and total + v > most)):
            chunk, n, total = chunk + 1, 0, 0
        n, total = n + 1, total + v
        out.append((g, i, chunk))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_rows, most, block, by", [(5, 8, 6, ["g"]), (3, 0, 4, ["g"]), (7, 20, 1000, ["g"]), (1, 5, 1, ["g"]), (6, 15, 8, None)])
def test_cuts_are_those_of_a_fold(spark, most_rows, most, block, by):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([None, -3, 0, 1, 2, 3, 9, 50])) for g in ((None, "a", "b", "c") if by else ("x",)) for i in range(rng.choice([1, 40, 150]) if by else 200)]
    for parts in (1, 7):
        tasks = spark.createDataFrame(rows, "g string, i long, point_count long").repartition(parts)
        got = scans.greedy_chunks(tasks, ["i"], most_rows, most, "point_count", by, block).collect()
        assert sorted(((r.g, r.i, r.chunk) for r in got), key=str) == fold(rows, most_rows, most)
    assert scans.greedy_chunks(tasks.limit(0), ["i"], most_rows, most, "point_count", by, block).count() == 0


def test_ranks_and_sums_follow_the_order(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 1, 5, -2])) for i in rng.sample(range(10_000), 700)]
    got = scans.ranked(spark.createDataFrame(rows, "i long, v long").repartition(9), [F.desc("i")], ["v"]).collect()
    total, wanted = 0, []
    for k, (i, v) in enumerate(sorted(rows, reverse=True)):
        wanted.append((i, v, k, total))
        total += v or 0
    assert sorted(map(tuple, got), reverse=True) == wanted
    assert scans.ranked(spark.createDataFrame([], "i long"), ["i"]).count() == 0


def parted(rows, most, levels, least, part=1):
    """{row_index: part} by the rule: first n // 2 rows of the longer axis to the left."""
    if len(rows) <= most or not levels or len(rows) < 2 or len(rows) // 2 < least:
        return {r[0]: part for r in rows}
    east = max(r[1] for r in rows) - min(r[1] for r in rows) >= max(r[2] for r in rows) - min(r[2] for r in rows)
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]) if east else (r[2], r[1], r[0]))
    return parted(rows[: len(rows) // 2], most, levels - 1, least, 2 * part) | parted(rows[len(rows) // 2 :], most, levels - 1, least, 2 * part + 1)


@pytest.mark.parametrize("most, levels, least", [(1, 2, 1), (10, 5, 1), (10, 5, 8), (4, 1, 1)])
def test_split_puts_the_middle_row_right_and_names_what_stays_too_large(spark, most, levels, least):
    rng = random.Random(3)
    rows = [(k, "abc"[k % 3], rng.choice([0.0, 1.0, rng.random()]), rng.choice([0.0, rng.random() * 2])) for k in range(103)]
    points = spark.createDataFrame(rows, "row_index long, g string, lon double, lat double")
    got = graph.spatial_split(points, "g", most, levels, least).collect()
    wanted = {}
    for g in "abc":
        wanted |= parted([(k, x, y) for k, h, x, y in rows if h == g], most, levels, least)
    assert {r.row_index: r.part for r in got} == wanted
    size = {}
    for k, g, *_ in rows:
        size[g, wanted[k]] = size.get((g, wanted[k]), 0) + 1
    assert all(r.over == (size[r.g, r.part] > most) for r in got) and len(got) == len(rows)


def test_light_is_the_same_for_any_size_of_unit(spark):
    rng = random.Random(12)
    x0, y0 = -7_400_000, 4_070_000
    points = [(f"t{k % 3}", k, 1718971200 + 7200 * (k % 5), x := x0 + rng.randrange(900), y := y0 + rng.randrange(900), x / 1e5, y / 1e5) for k in range(150)] + [("t9", 900, None, 1, 1, 0.0, 0.0)]
    rows = spark.createDataFrame(points, "task_id string, row_index long, timestamp long, x long, y long, lon double, lat double")
    square = lambda x, y: [(x, y), (x + 20, y), (x + 20, y + 12), (x, y + 12)]
    houses = spark.createDataFrame([(k, rng.choice([None, 5.0, 30.0, 60.0]), square(x0 + rng.randrange(900), y0 + rng.randrange(900))) for k in range(80)], "building_id long, height double, ring array<struct<x:long,y:long>>")
    one_time = rows.withColumn("task_id", F.concat_ws("|", "task_id", "timestamp"))  # a unit has one sun
    wanted = {r.row_index: int(r.lit and not r.in_shadow) for r in light.shadowed(rows.where("timestamp is not null"), houses, 60.0, plane=False).collect()}
    seen = set()
    for most_points, most_obstacles, least in ((1000, 1000, 1), (7, 1000, 1), (1000, 6, 1), (5, 5, 4)):
        parts, units, pairs = solver.execution_units(one_time, houses, most_points, most_obstacles, least, levels=5)
        assert {r.row_index: r.sunlit for r in solver.solve(parts, pairs, houses, math.radians(5)).collect()} == wanted
        for u in units.collect():
            assert u.over == (u.n > most_points or u.obstacles > most_obstacles) and (not u.over or u.n // 2 < least or u.part >= 32)
            seen.add((u.reason, u.over))
            assert 50.0 <= u.context_m <= 700.0
    assert set(wanted.values()) == {0, 1} and ("height_solar", False) in seen and ("height_solar", True) in seen


def test_context_falls_back_without_sun_or_obstacles(spark):
    night = spark.createDataFrame([("n", 1, 1718935200, -7_400_000, 4_070_000, -74.0, 40.7), ("far", 2, 1718985600, 0, 4_070_000, 0.0, 40.7)], "task_id string, row_index long, timestamp long, x long, y long, lon double, lat double")
    house = spark.createDataFrame([(1, 10.0, [(-7_400_010, 4_070_010), (-7_400_000, 4_070_010), (-7_400_000, 4_070_020)])], "building_id long, height double, ring array<struct<x:long,y:long>>")
    _, units, pairs = solver.execution_units(night, house, 10, 10)
    assert {(u.task_id, u.reason, u.context_m) for u in units.collect()} == {("n", "fallback", 700.0), ("far", "fallback", 700.0)} and pairs.count() == 0
    assert solver.execution_units(night.limit(0), house, 10, 10)[1].count() == 0 == solver.execution_units(night, house.limit(0), 10, 10)[2].count()


def test_ranks_of_doubles_are_exact_to_the_last_bit(spark):
    rng = random.Random(5)
    pool = [0.0, -0.0, 1.5, -1.5, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 0.1, 0.1 + 2**-56, math.nextafter(0.1, 1), math.nextafter(-0.1, -1), -0.1]
    rows = [(rng.choice([None, "", "a", "b"]), rng.choice([None, math.nan, rng.choice(pool), rng.choice(pool), rng.uniform(-1, 1)])) for _ in range(600)] + [("c", 7.0), ("d", None), ("e", math.nan)]
    got = quantiles.at_ranks(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"low": F.lit(0), "middle": F.floor(F.col("n") / 2), "high": F.col("n") - 1}).collect()
    wanted = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            wanted.setdefault(g, []).append(v)
    assert {r.g for r in got} == set(wanted) == {None, "", "a", "b", "c"}
    for r in got:
        v = sorted(wanted[r.g])
        assert (r.n, r.low, r.middle, r.high) == (len(v), v[0], v[len(v) // 2], v[-1])
    assert quantiles.at_ranks(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"a": F.lit(0)}).count() == 0
    assert quantiles.medians(spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "x double, y double"), ["x", "y"]).collect() == [("x", 2.0)]
