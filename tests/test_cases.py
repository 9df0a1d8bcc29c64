"""Hand-made cases of the operators: nulls, ties, empty tables, boundaries, broken text."""

import math

import pytest
from pyspark.sql import functions as F

from solterra.functions import geo, solar, text
from solterra.operators import exposure, graph, light, mobility, reports, rows, shapes, tracks
from solterra.sources import files
from solterra.streaming import windows


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("v")).first().v


def test_numbers_and_times_of_text(spark):
    said = ["", " ", "abc", "12.9", None, "1e3", "inf", "nan", "-5", " 7 ", "1d", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04", "2024-13-01", "1704164645000"]
    got = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", text.number(F.col("t")).alias("n"), text.iso_seconds(F.col("t")).alias("s"), text.parse_epoch(F.col("t")).alias("e")).orderBy("k").collect()
    assert [r.n for r in got] == [None, None, None, 12.9, None, 1000.0, None, None, -5.0, 7.0, None, None, None, None, None, None, 1704164645000.0]
    assert [r.s for r in got[11:16]] == [1704153600.0, 1704164645.0, 1704157445.0, 1704164640.0, None] and got[16].e == 1704164645.0
    assert one(spark, text.parse_seconds(F.col("a"), F.col("b"), bucket_start=F.col("c")), a="-5", b="", c="2024-01-02T00:00:00.000Z") == 1704153600.0


def test_utc_text_does_not_follow_the_session_s_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert one(spark, text.minute_iso(F.col("t")), t=1704164645) == "2024-01-02T03:04:00.000Z"
        assert one(spark, text.minute_iso(F.col("t")), t=-1) == "1969-12-31T23:59:00.000Z"
        assert one(spark, F.hour(text.local(F.col("t"), "America/New_York")), t=1720000000) == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_local_hours_cross_daylight_saving(spark):
    dates = spark.sql("SELECT DATE'2024-03-09' AS date UNION ALL SELECT DATE'2024-03-11'")
    got = exposure.hour_grid(dates, [6, 22], "America/New_York", [50]).orderBy("timestamp").collect()
    assert [r.timestamp for r in got] == [1709982000, 1710039600, 1710151200, 1710208800]
    assert text.hour_list("22-3, 5,5, 24") == [0, 1, 2, 3, 5, 22, 23] and text.hour_list("") == []


def test_keys_and_paths(spark):
    assert one(spark, text.partition_id("p", F.lit(0.25), F.col("w"), F.col("s"), F.lit(-73.75), F.lit(0.0)), w=-74.0, s=-0.25) == "p_d025_w07400_s00025_w07375_n00000"
    assert tuple(one(spark, text.tile_bounds(F.col("t")), t="w075_n45_w070_n40")) == (-75, 40, -70, 45) and one(spark, text.tile_bounds(F.col("t")), t="w75") is None
    assert one(spark, text.derived_relpath(F.col("t")), t="a/shard_7/tasks.csv") == "shard_7.csv" and one(spark, text.derived_relpath(F.col("t")), t="tasks.csv") == "tasks.csv"
    assert one(spark, text.bucket_key(F.col("t")), t=" 2024-01-02T03:04:00Z ") == "2024-01-02T03:04:00.000Z" and one(spark, text.one_line(F.col("t"), 4), t="a\r\nbcd") == "a  b"
    assert [one(spark, text.plain_number(F.col("v")), v=v) for v in (0.0, 1.0, 0.25, 100.0, 0.1234567)] == ["0", "1", "0.25", "100", "0.123457"]
    parts = text.split_cell_key(F.col("k"))
    assert [one(spark, c, k="square:250:-7:12") for c in parts.values()] == ["square", 250, "-7", 12] and [one(spark, c, k="h3:x:8a") for c in parts.values()] == ["h3", None, "8a", None]


def test_positions_by_priority(spark):
    r = [(1, "1", "x", "2", "3", "9", "8", "1"), (2, "", "5", "2", "3", "9", "8", "0"), (3, None, None, " ", None, "9", "8", "yes"), (4, None, None, None, None, "9", "8", None)]
    raw = spark.createDataFrame(r, "k int, fnl_lon string, fnl_lat string, gps_lon string, gps_lat string, stay_point_x string, stay_point_y string, stay_status string")
    pick = lambda *a: [x.picked and x.picked.source for x in rows.pick_coordinates(raw, *a).orderBy("k").collect()]
    assert pick() == ["fnl", "gps", None, None] and pick(rows.INDOOR_PRIORITY) == ["stay_point", "gps", "stay_point", None] and pick(["fnl", "gps"], True) == ["gps", "gps", None, None]
    assert rows.pick_coordinates(raw.limit(0)).count() == 0 and rows.with_columns(raw, k="long", z="int").columns == [*raw.columns, "z"]


def test_heights(spark):
    b = spark.createDataFrame([("5",), ("-3",), ("tall",), (None,), ("inf",)], "height_m string")
    assert [r.v for r in b.select(rows.resolve_height(b).alias("v")).collect()] == [5.0, 0.0, 12.0, 12.0, 12.0]
    assert [r.v for r in b.select(rows.resolve_height(b.drop("height_m")).alias("v")).collect()] == [12.0] * 5
    kind = lambda h, n, k: one(spark, rows.height_by_type(F.lit(h).cast("double"), F.lit(n).cast("double"), F.lit(k).cast("string")))
    assert [kind(1.0, None, "x"), kind(500.0, None, "x"), kind(None, 2.0, "x"), kind(0.0, 0.0, "tower"), kind(None, None, None)] == [3.0, 300.0, 7.0, 50.0, 8.0]
    area = lambda h, a: one(spark, rows.height_by_area(F.lit(h).cast("double"), F.lit(a).cast("double")))
    assert [area(4.0, None), area(None, 100.0), area(-1.0, 1e9), area(None, None)] == [4.0, 5.0, 60.0, 12.0]


def test_merges_replace_whole_rows_and_pages_tell_of_more(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k int, v double, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, 3.0, "q")], "k int, v double, w string")
    assert sorted(map(tuple, rows.merge_rows(old, new, ["k"]).collect())) == [(1, 1.0, "a"), (2, None, "z")]
    many = spark.range(7)
    kept, more = rows.page(many, None, [F.asc("id")], 3)
    assert [(r.id, r.m) for r in kept.select("id", more.alias("m")).orderBy("id").collect()] == [(0, True), (1, True), (2, True)]
    kept, more = rows.page(many, F.col("id") > 4, [F.asc("id")], 3)
    assert [(r.id, r.m) for r in kept.select("id", more.alias("m")).orderBy("id").collect()] == [(5, False), (6, False)]


def test_unknown_distances_stay_unknown(spark):
    pts = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, None, 0.0), ("a", 3, 0.0, 0.001)], "who string, timestamp long, lon double, lat double")
    assert one(spark, geo.haversine_m(F.lit(None).cast("double"), F.col("x"), F.col("x"), F.col("x")), x=1.0) is None
    assert tracks.with_distance(pts, "who", ["timestamp"]).agg(F.sum("step_m")).first()[0] == 0.0
    assert one(spark, geo.sunlight_factor(F.lit(None).cast("double"))) is None
    assert [round(one(spark, geo.sunlight_factor(F.col("c")), c=c), 9) for c in (-0.1, 0.0, 1.0, 1.2)] == [1.0, 1.0, 0.15, 0.15]


def test_rings(spark):
    P = "array<struct<x:double,y:double>>"
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    d = spark.createDataFrame([(1, square), (2, [*square, square[0]]), (3, []), (4, None), (5, square[:2])], f"k int, ring {P}")
    got = d.select("k", F.size(geo.close_ring(F.col("ring"))).alias("n"), geo.ring_area_deg(F.col("ring")).alias("a"), geo.ring_issues(F.col("ring")).alias("i"), F.size(light.ring_edges("ring")).alias("e")).orderBy("k").collect()
    assert [(r.n, r.a, r.i, r.e) for r in got] == [(5, 4.0, ["open", "area"], 4), (5, 4.0, ["area"], 5), (0, 0.0, ["incomplete"], 0), (None, None, ["incomplete"], None), (3, 0.0, ["incomplete"], 2)]
    assert tuple(one(spark, geo.ring_center(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in square))))) == (1.0, 1.0)


def test_tiles_boxes_and_grids(spark):
    x, y = geo.web_tile(F.lit(-74.0), F.lit(40.7), F.lit(16))
    w, s, e, n = (one(spark, c) for c in geo.web_tile_bounds(x, y, F.lit(16)))
    assert w <= -74.0 < e and s <= 40.7 < n and one(spark, F.size(geo.web_tiles(F.lit(-75.0), F.lit(40.0), F.lit(-70.0), F.lit(42.0), 9))) == 20
    assert [one(spark, c) for c in geo.gfs_indices(F.lit(-0.1), F.lit(90.0))] == [0, 1440] and [one(spark, geo.cell_roundup(F.lit(b), F.lit(v))) for b, v in ((250, 0), (250, 100), (250, 600))] == [0.0, 250.0, 750.0]
    tiles = spark.createDataFrame([("t", 0.0, 0.0, 0.6, 0.5), ("flat", 0.0, 1.0, 0.5, 1.0)], "tile_id string, west double, south double, east double, north double")
    got = shapes.partitions_of(tiles, 0.25).collect()
    assert len(got) == 6 and max(r.max_lon for r in got) == 0.6 and {r.tile_id for r in got} == {"t"}
    assert shapes.refined(shapes.partitions_of(tiles, 0.5), shapes.partitions_of(tiles, 0.5).where("min_lon = 0"), 0.25).count() == 4
    assert shapes.sample_grid(tiles.where("tile_id = 't'"), 1).count() == 9 and shapes.step_for(10, 10, 25) == 2
    overlap = lambda *b: [one(spark, c) for c in geo.box_overlap(tuple(map(F.lit, (0.0, 0.0, 1.0, 1.0))), tuple(map(F.lit, b)))]
    assert overlap(0.0, 0.0, 1.0, 1.0) == [100.0, 0.0, True] and overlap(1.0, 0.0, 2.0, 1.0)[0] == 0.0 and overlap(1.0, 0.0, 2.0, 1.0)[1] > 100_000


def test_features_and_catalogs(spark):
    docs = spark.createDataFrame([(1, '{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]},"properties":{"h":3}},{"geometry":null}]}'), (2, "no json"), (3, None)], "k int, doc string")
    got = shapes.read_features(docs, "doc").orderBy("position").collect()
    assert [(r.k, r.position, r.geometry_type, r.props) for r in got] == [(1, 0, "Point", {"h": "3"}), (1, 1, None, {})]
    bad = spark.createDataFrame([(None, None, 0.0, 0.0, 1.0, 1.0, None, None)], shapes.CATALOG)
    with pytest.raises(Exception, match="lacks its id"):
        shapes.catalog(bad).collect()
    multi = spark.createDataFrame([(1, [[[(0.0, 0.0)]], []])], "k int, geom array<array<array<struct<x:double,y:double>>>>")
    assert shapes.polygons_of(multi, "geom").count() == 1


def test_raster_components_wind_and_touch_by_sides_only(spark):
    art = ["###.#", "..#.#", "###..", "#...#", "####."]
    px = spark.createDataFrame([(r, c, 5.0 + r if x == "#" else 0.0) for r, line in enumerate(art) for c, x in enumerate(line)] + [(9, 9, None), (9, 8, float("nan"))], "r long, c long, value double")
    got = shapes.raster_components(px, 1.0).collect()
    by = {}
    for p in got:
        by.setdefault((p.component, p.height), set()).add((p.r, p.c))
    assert sorted(map(len, by.values())) == [1, 2, 12] and {h for _, h in by} == {9.0, 6.0, 8.0}
    assert shapes.raster_components(px.limit(0), 1.0).count() == 0


def test_spans_are_runs_of_lit_instants(spark):
    stays = spark.createDataFrame([("a", 1, 0, 600, 0.0, 0.0), ("a", 2, 0, None, 0.0, 0.0), ("b", 3, 30, 200, 0.0, 0.0)], "ad_id string, row_index long, start_time long, end_time long, lon double, lat double")
    lit = lambda t: F.expr(f"pmod({t}, 300) < 120")
    got = sorted((r.row_index, r.start_ts, r.end_ts, r.n) for r in mobility.lit_spans(stays, lit).collect())
    assert got == [(1, 0, 60, 2), (1, 300, 360, 2), (2, 0, 0, 1), (3, 30, 90, 2)]
    assert mobility.lit_spans(stays.limit(0), lit).count() == 0 and mobility.lit_spans(stays, lambda t: F.lit(False)).count() == 0


def test_graph_joins(spark):
    edges = spark.createDataFrame([("t1", "p1"), ("t1", "p2"), ("t2", "p1"), ("t2", "p1"), ("t3", "p3"), ("t4", None)], "task_id string, partition_id string")
    there = spark.createDataFrame([("p1",), ("p1",), ("p3",)], "partition_id string")
    assert sorted(map(tuple, graph.with_all_partitions(edges, there).collect())) == [("t2", 1), ("t3", 1)]
    assert graph.with_all_partitions(edges, there.limit(0)).count() == 0
    stays = spark.createDataFrame([(1, "c", 30, 200), (2, "c", 30, None), (3, None, 30, 200)], "row_index long, cell string, start_time long, end_time long")
    minutes = spark.createDataFrame([("c", 0), ("c", 60), ("c", 180), ("c", 240), ("c", 60)], "cell string, minute_ts long")
    assert sorted(map(tuple, graph.minutes_of(stays, minutes).collect())) == [(1, 0), (1, 60), (1, 180), (2, 0)]
    none = graph.edge_metrics(edges.limit(0)).first()
    assert none.edge_count == 0 and none.multi_partition_task_fraction == 0.0 and none.avg_partitions_per_task is None
    boxes = spark.createDataFrame([(0.0, 90.0, 1.0, 90.0), (0.0, 59.0, 1.0, 61.0)], "west double, south double, east double, north double")
    pole, north = graph.padded(boxes, 111_320.0).collect()
    assert pole.west == -180.0 and round(north.west, 6) == -2.0 and north.north == 62.0


def test_percentiles_histograms_and_plans(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), ("a", float("nan")), ("b", 4.0)], "k string, v double")
    assert {r.k: r.p90 for r in graph.percentiles_at(v, ["k"], "v").collect()} == {"a": 10.0, "b": 4.0}
    assert graph.percentiles(v.where("k = 'a' and v < 11"), "v").first().p90 == 7.9 and graph.percentiles(v.limit(0), "v").first().p50 is None
    assert sorted(map(tuple, graph.histogram(v, "v", 3).collect())) == [(0, 3), (1, 1), (2, 1)] and graph.histogram(v.where("k = 'b'"), "v", 3).collect()[0].bin == 0
    assert graph.histogram(v.limit(0), "v", 3).count() == 0
    tasks = spark.createDataFrame([(k, p) for k, p in enumerate([3, 3, 9, 1, 1, 1, None])], "k int, point_count long")
    plan = lambda *a: [r.chunk for r in graph.chunk_plan(tasks, ["k"], *a).orderBy("k").collect()]
    assert plan(3, 6) == [0, 0, 1, 2, 2, 2, 3] and plan(3, 0) == [0, 0, 0, 1, 1, 1, 2] and graph.chunk_plan(tasks.limit(0), ["k"], 3, 6).count() == 0


def test_reports_of_nothing_and_of_nulls(spark):
    daily = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("", 9.0), (None, 9.0)], "id string, m double")
    r = reports.by_person_day(daily, ["m"]).first()
    assert (r.people, r.person_days, r.m_mean, r.m_median) == (2, 5, 2.0, 2.0) and reports.by_person(daily, ["m"]).first().m_mean_person == 2.0
    assert reports.by_person_day(daily.limit(0), ["m"]).first().person_days == 0
    lines = spark.createDataFrame([("f", 1, "a,b"), ("f", 2, "a"), ("f", 3, " "), ("f", 4, "a,b"), ("g", 2, "x")], "file string, line_no long, text string")
    assert {r.file: (r.rows, r.bad_rows, r.first_bad) for r in reports.width_by_file(lines, F.size(F.split("text", ","))).collect()} == {"f": (2, 1, 2), "g": (1, 1, 2)}
    readings = spark.createDataFrame([("c", t, float(t % 50)) for t in range(12)] + [("i", t, float(-t)) for t in range(12)] + [("few", t, float(-t)) for t in range(9)] + [("n", 0, None)], "k string, timestamp long, ssrd double")
    assert {r.k: r["mode"] for r in reports.ssrd_mode(readings, "k").collect()} == {"c": "cumulative", "i": "incremental", "few": "cumulative"}


def test_irradiance_cumulative_and_reset(spark):
    r = spark.createDataFrame([("a", 0, 100.0), ("a", 10, 300.0), ("a", 20, 50.0), ("a", 20, 60.0), ("a", 30, None)], "k string, timestamp long, ssrd double")
    assert [x.watts for x in light.irradiance(r, "k").orderBy("timestamp", "ssrd").collect() if x.ssrd in (300.0, 50.0)] == [20.0, 5.0]


def test_dwell_ends_at_rows_of_another_kind_and_homes_prefer_stays(spark):
    at = lambda h: 1704067200 + 5 * 3600 + int(h * 3600)  # hour h of 2024-01-01 in New York
    p = [("u", at(0), -74.0, 40.7, False), ("u", at(0.01), -74.0, 40.7, False), ("u", at(5.9), None, 40.7, True), ("u", at(7), -73.0, 41.0, True), ("u", at(23), -73.0, 41.0, True), ("u", at(23.02), -73.0, 41.0, True), ("v", at(12), 0.0, 0.0, True)]
    pts = spark.createDataFrame(p, "who string, timestamp long, lon double, lat double, stay boolean")
    got = [r.dwell_s for r in exposure.dwell(pts, "who", ["timestamp"], "America/New_York", 300).orderBy("who", "timestamp").collect()]
    assert got == [36, 300, None, None, 72, None, None]
    homes = exposure.homes(pts, "who", ["timestamp"], "America/New_York").collect()
    assert [(h.who, round(h.lon, 6), h.seconds) for h in homes] == [("u", -73.0, 72)]


def test_spikes_come_back(spark):
    p = [(0, 0.0), (10, 0.0), (20, 0.02), (30, 0.0), (40, 0.02), (700, 0.02)]
    pts = spark.createDataFrame([("u", t, lon, 0.0) for t, lon in p], "who string, timestamp long, lon double, lat double")
    assert [r.timestamp for r in exposure.spikes(pts, "who", ["timestamp"]).where("spike").orderBy("timestamp").collect()] == [20, 30]


def test_cleaning_drops_jump_and_return_and_short_segments(spark):
    p = [(t, 0.0) for t in range(0, 601, 60)] + [(660, 1.0), (720, 0.0)] + [(2000, 0.0)]
    pts = spark.createDataFrame([("u", k, t, lon, 0.0) for k, (t, lon) in enumerate(p)] + [("u", 99, 5, 200.0, 0.0), ("u", 98, None, 0.0, 0.0)], "who string, row_index long, timestamp long, lon double, lat double")
    got = {r.row_index: (r.reason, r.segment) for r in tracks.cleaned(pts, "who", ["timestamp", "row_index"]).collect()}
    assert [got[k][0] for k in (0, 11, 12, 13, 98, 99)] == ["kept", "jump_speed", "jump_speed", "short_segment", "invalid", "invalid"] and got[0][1] == 1


def test_route_traces_walk_the_line(spark):
    v = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 0.001, 0.0), ("r", 2, 0.001, 0.001), ("still", 0, 5.0, 5.0)], "route string, place long, lon double, lat double")
    got = [(r.offset_s, r.lon, r.lat) for r in exposure.route_trace(v, "route", 30).where("route = 'r'").orderBy("offset_s").collect()]
    whole = 2 * 0.001 * math.pi / 180 * 6_371_000
    assert [g[0] for g in got] == list(range(0, int(whole / 1.4) + 1, 30)) and got[0][1:] == (0.0, 0.0) and all(lon == 0.001 or lat == 0.0 for _, lon, lat in got)
    assert [(r.offset_s, r.lon) for r in exposure.route_trace(v, "route", 30).where("route = 'still'").orderBy("offset_s").collect()] == [(0, 5.0), (30, 5.0)]


def test_the_sun_of_an_almanac(spark):
    """Published times for Greenwich (51.48 N, 0 E), 2024-06-20 and 2024-12-21, to four minutes; noon heights by 90 - lat + declination."""
    for day, rise, dip, height in ((1718841600, 3 * 3600 + 43 * 60, 20 * 3600 + 21 * 60, 90 - 51.48 + 23.44), (1734739200, 8 * 3600 + 4 * 60, 15 * 3600 + 53 * 60, 90 - 51.48 - 23.44)):
        row = spark.range(1).selectExpr(f"{day} as day", "0.0D as lon", "51.48D as lat", f"{day} + 43200 as timestamp").selectExpr(f"{solar.sunrise()} as a", f"{solar.sunset()} as b", f"{solar.altitude()} as h").first()
        assert abs(row.a - day - rise) < 240 and abs(row.b - day - dip) < 240 and abs(math.degrees(row.h) - height) < 0.3
    polar = spark.range(1).selectExpr("1718841600 as day", "0.0D as lon", "80.0D as lat").selectExpr(f"{solar.sunrise()} as a").first()
    assert polar.a is None


def test_trace_files_and_rejects(spark):
    raw = spark.createDataFrame([(1, "a", "1704164645", "1", "2"), (2, "", "1", "1", "2"), (3, "a", "x", "1", "2"), (4, "a", "5", "181", "2"), (5, None, None, None, None)], "source_row long, ID string, ts string, longitude string, lat string")
    good, bad = files.trace_rows(raw)
    assert [tuple(r) for r in good.collect()] == [(1, "a", 1704164645.0, 1.0, 2.0, None)] and sorted(map(tuple, bad.collect())) == [(2, "id"), (3, "time"), (4, "position"), (5, "id")]
    with pytest.raises(ValueError, match="lat"):
        files.trace_rows(raw.drop("lat"))


def test_csv_files_short_rows_and_blank_ones(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "a.csv").write_text('x,y,z\n1,"a, b",3\n\n , ,\n4,5\n')
    (tmp_path / "d" / "b.txt").write_text("x,y,z\n9,9,9\n")
    got = sorted(tuple(r)[:3] for r in files.csv_rows(spark, f"file://{tmp_path}/d").collect())
    assert got == [("1", "a, b", "3"), ("4", "5", "")]
    assert sorted(map(tuple, reports.width_by_file(files.numbered_lines(spark, f"file://{tmp_path}/d/e"), files.width_of(F.col("text"))).select("rows", "bad_rows", "first_bad").collect())) == [(3, 1, 5)]


def test_manifests_stay_below_their_root(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n")
    said = lambda text_: (tmp_path / "list.txt").write_text(text_)
    root, listed = f"file://{tmp_path}", f"file://{tmp_path}/list.txt"
    said("# note\n\na.csv\n./a.csv\na.csv\n")
    assert files.manifest(spark, listed, root) == [f"{root}/a.csv"] * 2
    for bad in ("../a.csv", "/etc/passwd", "x/../../a.csv", "hdfs://h/a"):
        said(bad)
        with pytest.raises(ValueError, match="outside"):
            files.manifest(spark, listed, root)
    said("gone.csv")
    assert files.manifest(spark, listed, root, skip_missing=True) == []
    with pytest.raises(FileNotFoundError):
        files.manifest(spark, listed, root)


def test_cubes_of_other_grids_are_an_error(spark):
    one_ = spark.createDataFrame([(0, 1.0, 2.0, 5.0), (1, 1.0, 2.0, None)], "timestamp long, lat double, lon double, value double")
    assert sorted(map(tuple, files.merged_cube({"a": one_, "b": one_}).collect()))[0] == (0, 1.0, 2.0, 5.0, 5.0)
    with pytest.raises(Exception, match="grids differ"):
        files.merged_cube({"a": one_, "b": one_.limit(1)}).collect()


def test_chunks_resume_after_a_broken_run(spark, tmp_path):
    path, calls = f"file://{tmp_path}/out", []
    chunks = spark.createDataFrame([(k % 3, k) for k in range(9)], "chunk long, task_id long")

    def work(todo):
        calls.append(sorted({r.chunk for r in todo.collect()}))
        return todo.withColumn("v", F.col("task_id") * 2)

    files.write_chunks(chunks.where("chunk = 0"), work, path)
    chunks.where("chunk = 1").withColumn("v", F.lit(-1)).write.mode("append").partitionBy("chunk").parquet(f"{path}/rows")  # rows without the mark
    assert files.write_chunks(chunks, work, path) == [1, 2] and files.write_chunks(chunks, work, path) == [] and calls == [[0], [1, 2]]
    assert sorted(r.v for r in spark.read.parquet(f"{path}/rows").collect()) == [2 * k for k in range(9)]
    more = chunks.unionByName(spark.createDataFrame([(0, 77)], chunks.schema))
    assert files.write_chunks(more, work, path) == [0] and spark.read.parquet(f"{path}/rows").count() == 10


def test_sessions_join_at_just_the_gap_in_batch_too(spark):
    rows_ = spark.createDataFrame([("a", t) for t in (0, 600, 1201, 1801)] + [("b", 5)], "who string, s long").select("who", F.timestamp_seconds("s").alias("ts"))
    got = sorted((r.who, r.start.timestamp(), r["last"].timestamp(), r.n) for r in windows.sessions(rows_, "who", 600).collect())
    assert [g[3] for g in got] == [2, 2, 1]


def test_polygons_that_touch(spark):
    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    b = spark.createDataFrame([(1, sq(0, 0, 10)), (2, sq(100, 100, 5)), (3, sq(4, 4, 1)), (4, sq(10, 0, 5)), (5, sq(-50, -50, 200)), (6, [(-5, 3), (20, 3), (20, 4), (-5, 4)])], "building_id long, ring array<struct<x:long,y:long>>")
    assert sorted(r.building_id for r in light.touches_polygon(b, sq(2, 2, 8)).select("building_id").collect()) == [1, 3, 4, 5, 6]
