import math

import duckdb
import pytest

from solterra import registry
from solterra.operators import mobility as m
from solterra.operators.boxes import box_join

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def place(row):
    """Where a row sorts: nulls apart from every text, floats last and coarsely."""
    return [(v is None, "" if v is None else str(v)) for v in row if not isinstance(v, float)], [(v is None, 0.0 if v is None else round(v, 6)) for v in row if isinstance(v, float)]


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6) or (math.isnan(a) and math.isnan(b))
    return a is None and b is None if a is None or b is None else str(a) == str(b)


def compare(spark, name, where):
    duckdb.sql("SET timezone = 'UTC'")
    for table in ("events", "part", "orders"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS FROM '{where}/{table}.parquet'")
    wanted = duckdb.sql(registry.SQL[name])
    columns = sorted(wanted.columns)
    at = [list(wanted.columns).index(c) for c in columns]
    got = registry.QUERIES[name](spark, where)
    assert sorted(got.columns) == columns
    rows, expected = sorted(([r[c] for c in columns] for r in got.collect()), key=place), sorted(([r[i] for i in at] for r in wanted.fetchall()), key=place)
    assert len(rows) == len(expected)
    assert not [(a, b) for a, b in zip(rows, expected) if not all(map(same, a, b))][:3]


@pytest.fixture(scope="module")
def quick(spark):
    """Plans run as they are, without compiling code for each: the tables are small and the queries many."""
    plain_ = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in plain_}
    for k, v in plain_.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_gives_the_rows_of_its_sql(quick, name):
    compare(quick, name, SF)


@pytest.mark.parametrize("name", ["join_indoor", "join_point_shadow", "fn_shadow_wall", "join_point_shadow_ring", "pipe_exact_solver"])
def test_boundaries_hold_on_the_larger_tables(spark, name):
    compare(spark, name, LARGER)


def test_stays_expand_to_one_instant_at_least(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 100, 50), (3, 0, 0), (4, 0, 61)], "id long, start_time long, end_time long")
    assert {r["id"]: r["count"] for r in m.expand_stays(rows).groupBy("id").count().collect()} == {1: 1, 2: 1, 3: 1, 4: 2}


def test_gap_of_the_limit_keeps_the_segment(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 600), ("a", 1201)], "ad_id string, timestamp long")
    assert [r.segment for r in m.gap_segments(rows, "ad_id", ["timestamp"]).orderBy("timestamp").collect()] == [1, 1, 2]


def test_durations_clamp(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 400, 3), ("a", 410, 4)], "ad_id string, timestamp long, k long")
    assert [r.duration_s for r in m.durations(rows, "ad_id", ["k"]).orderBy("k").collect()] == [60, 300, 10, 60]


def test_boxes_that_touch_an_edge_match_once(spark):
    boxes = spark.createDataFrame([("t", 0.0, 0.0, 0.05, 0.05)], "task_id string, west double, south double, east double, north double")
    catalog = spark.createDataFrame([("p", 0.05, 0.05, 0.1, 0.1), ("q", 0.06, 0.0, 0.1, 0.1)], "partition_id string, min_lon double, min_lat double, max_lon double, max_lat double")
    assert [r.partition_id for r in box_join(boxes, catalog).collect()] == ["p"]
