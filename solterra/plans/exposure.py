"""Queries of the exposure chain: shadow, weather, effective light, homes, days; and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import rest
from ..functions import geo, solar, text
from ..operators import exposure as x
from ..operators import light, mobility, reports
from ..sources.views import STAYS_SQL, stays, view, view_sql, weather
from .light import _MY, _SHADOW, _WEATHER, _buildings, _points, mx
from .mobility import _ORDER, _TRACK, _W, _X, _Y, _track

QUERIES, SQL = {}, {}
ZONE = "America/New_York"
_LOCAL = f"(to_timestamp(timestamp) AT TIME ZONE '{ZONE}')"


def add(name: str, query, sql: str) -> None:
    QUERIES[name], SQL[name] = query, sql


def exposed(s, d):
    """Every stay's start with light, shadow, weather and duration."""
    rows = mobility.durations(_track(s, d), *_ORDER).withColumn("grid", F.floor((F.col("lon") + 74.0) * 100)).select("row_index", "ad_id", "timestamp", "lon", "lat", "grid", "duration_s")
    readings = light.irradiance(weather(s, d), "grid").withColumnsRenamed({"tcc": "cloud", "watts": "irradiance"})
    lit = light.with_shadow(light.to_units(rows), _buildings(s, d), max_height=60.0, plane=False).drop("x", "y")
    both = light.nearest_in_time(lit, readings, "grid", ["cloud", "irradiance"])
    return x.integrated(x.effective(both.withColumn("sunlit", (F.col("lit") & ~F.col("in_shadow")).cast("int"))))


_WATTS = f"""{_WEATHER}, wl AS (SELECT *, ssrd - lag(ssrd) OVER w AS step, timestamp - lag(timestamp) OVER w AS dt FROM weather WINDOW w AS (PARTITION BY grid ORDER BY timestamp)),
  modes AS (SELECT grid, count(*) >= 10 AND count(*) FILTER (step < -1e-3) / (count(*) - 1) > 0.2 AS own FROM wl GROUP BY grid),
  readings AS (SELECT grid, timestamp, tcc, CASE WHEN step IS NOT NULL THEN greatest(0.0E0, CASE WHEN own OR step < 0 THEN ssrd ELSE step END / dt) END AS watts FROM wl JOIN modes USING (grid))"""
_EXPOSED = f"""{_SHADOW}, {_WATTS}, timed AS (SELECT *, CAST(floor((lon + 74.0E0) * 100) AS BIGINT) AS grid, CASE WHEN gap IS NULL OR gap <= 0 THEN 60 ELSE least(gap, 300) END AS duration_s FROM (SELECT *, lead(timestamp) {_W} - timestamp AS gap FROM track)),
  near_w AS (SELECT t.row_index, r.tcc AS cloud, r.watts AS irradiance FROM timed t LEFT JOIN readings r ON r.grid = t.grid AND abs(r.timestamp - t.timestamp) <= 86400
    QUALIFY row_number() OVER (PARTITION BY t.row_index ORDER BY abs(r.timestamp - t.timestamp), r.timestamp) = 1),
  seen AS (SELECT t.row_index, t.ad_id, t.timestamp, t.duration_s, w.cloud, w.irradiance, CAST(s.lit AND NOT s.in_shadow AS INTEGER) AS sunlit, CASE WHEN cloud IS NOT NULL THEN greatest(0.15E0, 1 - 0.85E0 * greatest(0.0E0, least(cloud, 1.0E0))) END AS factor
    FROM timed t JOIN near_w w USING (row_index) JOIN shadow s USING (row_index)),
  exposed AS (SELECT *, sunlit * coalesce(factor, 1.0E0) AS sunlit_effective, 100 - sunlit * coalesce(factor, 1.0E0) * 100 AS shadow_effective, CASE WHEN irradiance IS NULL THEN NULL WHEN sunlit = 0 THEN 0.0 ELSE irradiance END AS irradiance_effective FROM seen)"""
_OUT = ["row_index", "sunlit", *(f"{c}" for c in ("factor", "sunlit_effective", "shadow_effective", "irradiance_effective", "sunlight_s", "shadow_s", "irradiance_j"))]
_rounded = lambda df, names: df.select(*(F.round(c, 6).alias(c) if c not in ("row_index", "sunlit", "duration_s") else F.col(c) for c in names))
add("pipe_sunlight_file_minute", lambda s, d: _rounded(exposed(s, d), _OUT),
    f"""WITH {_EXPOSED} SELECT row_index, sunlit, round(factor, 6) AS factor, round(sunlit_effective, 6) AS sunlit_effective, round(shadow_effective, 6) AS shadow_effective, round(irradiance_effective, 6) AS irradiance_effective,
      round(sunlit_effective * duration_s, 6) AS sunlight_s, round(shadow_effective / 100 * duration_s, 6) AS shadow_s, round(greatest(coalesce(irradiance_effective, 0.0), 0.0) * duration_s, 6) AS irradiance_j FROM exposed""")
_PART = lambda c, a, b, by: f"round(sum(CASE WHEN h >= {a} AND h < {b} THEN {c} ELSE 0.0 END) / {by}, 6)"
_PERIODS = ", ".join(f"{_PART('sun', a, b, 60)} AS {n}_min, {_PART('j', a, b, 1000)} AS {n}_kj" for n, (a, b) in x.PERIODS.items())
_DAY = f"""e AS (SELECT *, hour({_LOCAL}) AS h, strftime({_LOCAL}, '%Y-%m-%d') AS date, coalesce(sunlit, 0) * duration_s AS raw, coalesce(sunlit_effective, 0.0) * duration_s AS sun, greatest(coalesce(irradiance, 0.0), 0.0) * coalesce(sunlit, 0) * duration_s AS j FROM {{src}})
  SELECT {{by}}, date, count(*) AS n_samples, round(sum(raw) / 60, 6) AS raw_sunlight_min, round(sum(sun) / 60, 6) AS sunlight_min, round(sum(j) / 1000, 6) AS irradiance_kj, round(sum(j) / nullif(sum(sun), 0.0), 6) AS mean_irradiance, {_PERIODS} FROM e GROUP BY ALL"""
add("agg_irbm_day", lambda s, d: x.daily(exposed(s, d), ["ad_id"], ZONE), f"WITH {_EXPOSED}, " + _DAY.format(src="exposed", by="ad_id"))
_LIGHT = lambda s, d: view(s, d, "light_rows")
_L = view_sql("light_rows")
_F = "CASE WHEN cloud IS NOT NULL THEN greatest(0.15E0, 1 - 0.85E0 * greatest(0.0E0, least(cloud, 1.0E0))) END"
add("fn_sunlight_factor", lambda s, d: _LIGHT(s, d).select("row_index", F.round(geo.sunlight_factor(F.col("cloud")), 9).alias("factor")), f"WITH {_L} SELECT row_index, round({_F}, 9) AS factor FROM light_rows")
add("fn_effective", lambda s, d: _rounded(x.effective(_LIGHT(s, d)), ["row_index", "factor", "sunlit_effective", "shadow_effective", "irradiance_effective"]),
    f"WITH {_L}, f AS (SELECT *, {_F} AS factor FROM light_rows) SELECT row_index, round(factor, 6) AS factor, round(sunlit * coalesce(factor, 1.0E0), 6) AS sunlit_effective, round(100 - sunlit * coalesce(factor, 1.0E0) * 100, 6) AS shadow_effective, CASE WHEN irradiance IS NULL THEN NULL WHEN sunlit = 0 THEN 0.0 ELSE irradiance END AS irradiance_effective FROM f")
add("fn_shadow_reach", lambda s, d: _LIGHT(s, d).select("row_index", F.round(x.shadow_reach(F.when(F.col("row_index") % 8 > 0, F.col("shadow_percent")), F.col("row_index") % 100 - 20.0, 25.0, 60.0, 900.0), 6).alias("metres")),
    f"WITH {_L} SELECT row_index, round(CASE WHEN row_index % 100 - 20 > 0 AND row_index % 8 > 0 THEN least(900.0, greatest(60.0, shadow_percent / tan(radians(greatest(row_index % 100 - 20.0E0, 0.01))) + 25.0)) ELSE 900.0 END, 6) AS metres FROM light_rows")
add("fn_sunrise_sunset", lambda s, d: stays(s, d).select("row_index", (F.floor(F.col("start_time") / 86400) * 86400).alias("day"), "lon", (F.col("lat") + F.col("row_index") % 31).alias("lat")).select("row_index", *(F.round(F.expr(f()), 3).alias(n) for f, n in ((solar.sunrise, "sunrise"), (solar.sunset, "sunset")))),
    f"WITH {STAYS_SQL}, p AS (SELECT row_index, CAST(floor(start_time / 86400) * 86400 AS BIGINT) AS day, lon, lat + row_index % 31 AS lat FROM stays) SELECT row_index, round({solar.sunrise()}, 3) AS sunrise, round({solar.sunset()}, 3) AS sunset FROM p")
_PLACED = "CASE WHEN row_index % 13 = 0 THEN NULL ELSE lon END AS lon, lat, row_index % 3 = 0 AS stay"
_placed = lambda s, d: _track(s, d).withColumn("lon", F.when(F.col("row_index") % 13 > 0, F.col("lon"))).withColumn("stay", F.col("row_index") % 3 == 0)
_NIGHT = f"(hour({_LOCAL}) >= 22 OR hour({_LOCAL}) < 6)"
_DWELL = f"""{_TRACK}, placed AS (SELECT ad_id, row_index, timestamp, {_PLACED} FROM track), dw AS (SELECT *, {_NIGHT} AS night, CASE WHEN {_NIGHT} AND lon IS NOT NULL AND lat IS NOT NULL AND lead(timestamp) {_W} IS NOT NULL THEN greatest(0, least(lead(timestamp) {_W} - timestamp, 7200)) END AS dwell_s FROM placed)"""
add("win_dwell_cell", lambda s, d: x.dwell(_placed(s, d), *_ORDER, ZONE, 7200).select("row_index", "night", F.col("dwell_s").cast("long")), f"WITH {_DWELL} SELECT row_index, night, CASE WHEN dwell_s IS NOT NULL THEN dwell_s END AS dwell_s FROM dw")
_CELLS = lambda cond: f"(SELECT ad_id, {_X} AS cx, {_Y} AS cy, CAST(sum(dwell_s) AS BIGINT) AS seconds, sum(lon * dwell_s) / nullif(sum(dwell_s), 0) AS lon, sum(lat * dwell_s) / nullif(sum(dwell_s), 0) AS lat FROM dw WHERE dwell_s IS NOT NULL AND {cond} GROUP BY ALL HAVING sum(dwell_s) > 0)"
_BEST = "QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY seconds DESC, cx, cy) = 1"
_HOME = f"{_DWELL}, ev AS (SELECT * FROM {_CELLS('true')} {_BEST}), st AS (SELECT * FROM {_CELLS('stay')} {_BEST}), home AS (SELECT ad_id, coalesce(st.lon, ev.lon) AS lon, coalesce(st.lat, ev.lat) AS lat, coalesce(st.seconds, ev.seconds) AS seconds FROM ev LEFT JOIN st USING (ad_id))"
_homes = lambda s, d: x.homes(_placed(s, d), *_ORDER, ZONE, 250.0, 7200)
add("agg_home_cell", lambda s, d: _homes(s, d).select("ad_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.col("seconds").cast("long")), f"WITH {_HOME} SELECT ad_id, round(lon, 9) AS lon, round(lat, 9) AS lat, seconds FROM home")
_dates = lambda s, d: stays(s, d).select("ad_id", F.to_date(text.local(F.col("start_time"), ZONE)).alias("date")).distinct()
_DATES = f"dates AS (SELECT DISTINCT ad_id, CAST(to_timestamp(start_time) AT TIME ZONE '{ZONE}' AS DATE) AS date FROM stays)"
_GRID = f"hours AS (SELECT ad_id, date, hour, buffer_m, CAST(epoch((date + to_hours(hour)) AT TIME ZONE '{ZONE}') AS BIGINT) AS timestamp FROM dates, unnest([8, 12, 17]) a(hour), unnest([50, 100]) b(buffer_m))"
add("gen_hour_grid", lambda s, d: x.hour_grid(_dates(s, d), [8, 12, 17], ZONE, [50, 100]).select("ad_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "hour", "buffer_m", "timestamp"), f"WITH {STAYS_SQL}, {_DATES}, {_GRID} SELECT ad_id, strftime(date, '%Y-%m-%d') AS date, hour, buffer_m, timestamp FROM hours")


def irbm(s, d, hours=(8, 12, 17), buffers=(50, 100), n=3):
    """Per home, date and buffer: the share of a grid of points around the home that the sun reaches, hour by hour, summed to a day."""
    home = _homes(s, d).select("ad_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))
    grid = x.hour_grid(_dates(s, d).join(home, "ad_id"), list(hours), ZONE, list(buffers))
    grid = rest(light.with_sun(grid).where(F.col("alt") > F.radians(F.lit(5.0))))  # the sun of a home serves all its spots
    step = F.explode(F.sequence(F.lit(1), F.lit(n)))
    spots = grid.withColumn("i", step).withColumn("j", step)
    away = lambda k: (2.0 * F.col(k) / (n + 1) - 1) * F.col("buffer_m")
    east = light.east_metres(light.frame_of(F.col("y")))  # of the home's frame
    spots = light.to_units(spots).withColumn("x", F.col("x") + F.rint(away("i") / east).cast("long")).withColumn("y", F.col("y") + F.rint(away("j") / light.NORTH_M).cast("long"))
    by = ["ad_id", "buffer_m", "timestamp"]  # a home's grid of one instant; spots in shade are counted, those in the sun never travel on
    bit = F.expr(f"shiftleft(1L, (i - 1) * {n} + j - 1)").alias("bit")  # n up to 7
    shade = light.shaded(spots.select(*by, "x", "y", "alt", "az", bit), _buildings(s, d), max_height=60.0, plane=False).groupBy(*by).agg(F.bit_count(F.bit_or("bit")).alias("_shade"))
    cover = grid.select(*by, "lon").join(shade.hint("merge"), by, "left").select(*by, "lon", (F.lit(1.0) * (n * n - F.coalesce("_shade", F.lit(0))) / (n * n)).alias("sunlit"))
    readings = light.irradiance(weather(s, d), "grid").withColumnsRenamed({"tcc": "cloud", "watts": "irradiance"})
    rows = light.nearest_in_time(cover.withColumn("grid", F.floor((F.col("lon") + 74.0) * 100)), readings, "grid", ["cloud", "irradiance"])
    rows = rows.withColumn("sunlit_effective", F.col("sunlit") * F.coalesce(geo.sunlight_factor(F.col("cloud")), F.lit(1.0))).withColumn("duration_s", F.lit(3600))
    return x.daily(rows, ["ad_id", "buffer_m"], ZONE)


_MX = mx("round_even(lat * 100000, 0)")
_SPOTS = f"""h2 AS (SELECT ad_id, round(lon, 9) AS lon, round(lat, 9) AS lat FROM home), hg AS (SELECT hours.*, lon, lat FROM hours JOIN h2 USING (ad_id)),
  day AS (SELECT * FROM hg WHERE {solar.altitude()} > radians(5.0)),
  spots AS (SELECT *, CAST(round_even(lon * 100000, 0) AS BIGINT) + CAST(round_even((2.0E0 * i / 4 - 1) * buffer_m / {_MX}, 0) AS BIGINT) AS x, CAST(round_even(lat * 100000, 0) AS BIGINT) + CAST(round_even((2.0E0 * j / 4 - 1) * buffer_m / {_MY}, 0) AS BIGINT) AS y FROM day, range(1, 4) a(i), range(1, 4) b(j)),
  points AS MATERIALIZED (SELECT row_number() OVER () AS row_index, * FROM spots)"""
_IRBM_SHADOW = _SHADOW.split("points AS (", 1)[1].split("FROM track), ", 1)[1]
add("pipe_irbm", irbm,
    f"""WITH {_HOME}, {_DATES}, {_GRID}, {_SPOTS}, {_IRBM_SHADOW}, {_WATTS},
      cover AS (SELECT ad_id, buffer_m, timestamp, CAST(floor((lon + 74.0E0) * 100) AS BIGINT) AS grid, avg(CASE WHEN in_shadow THEN 0.0 ELSE 1.0 END) AS sunlit FROM points JOIN shadow USING (row_index) GROUP BY ALL),
      nw AS (SELECT c.*, r.tcc AS cloud, r.watts AS irradiance FROM cover c LEFT JOIN readings r ON r.grid = c.grid AND abs(r.timestamp - c.timestamp) <= 86400
        QUALIFY row_number() OVER (PARTITION BY c.ad_id, c.buffer_m, c.timestamp ORDER BY abs(r.timestamp - c.timestamp), r.timestamp) = 1),
      ready AS (SELECT *, sunlit * coalesce(CASE WHEN cloud IS NOT NULL THEN greatest(0.15E0, 1 - 0.85E0 * greatest(0.0E0, least(cloud, 1.0E0))) END, 1.0E0) AS sunlit_effective, 3600 AS duration_s FROM nw), """ + _DAY.format(src="ready", by="ad_id, buffer_m"))
_STEP = "2 * 6371000.0E0 * asin(sqrt(least(1.0E0 + 0 * ({b}lat - {a}lat), pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
_NEIGHBOURS = f"nb AS (SELECT row_index, lon AS b_lon, lat AS b_lat, lag(lon) {_W} AS a_lon, lag(lat) {_W} AS a_lat, lead(lon) {_W} AS c_lon, lead(lat) {_W} AS c_lat, timestamp - lag(timestamp) {_W} AS d1, lead(timestamp) {_W} - timestamp AS d2 FROM track)"
_ab, _bc, _ac = (_STEP.format(a=a, b=b) for a, b in (("a_", "b_"), ("b_", "c_"), ("a_", "c_")))
add("win_spike_return", lambda s, d: x.spikes(_track(s, d), *_ORDER, 500_000, 0.02, 60.0, 200.0).select("row_index", "spike"),
    f"WITH {_TRACK}, {_NEIGHBOURS} SELECT row_index, coalesce(d1 BETWEEN 1 AND 500000 AND d2 BETWEEN 1 AND 500000 AND {_ab} / d1 * 3.6E0 > 0.02 AND {_bc} / d2 * 3.6E0 > 0.02 AND {_ac} <= 200 AND {_ab} >= 60 AND {_bc} >= 60, false) AS spike FROM nb")
add("win_moving_only", lambda s, d: x.moving_segments(_track(s, d).withColumn("duration_s", F.col("row_index") % 400 - 20), *_ORDER, 21600, 300).select("row_index", "segment", F.col("segment_s").cast("long")),
    f"""WITH {_TRACK}, g AS (SELECT *, timestamp - lag(timestamp) {_W} AS dt FROM track), s AS (SELECT *, sum(CASE WHEN dt IS NULL OR dt <= 0 OR dt > 21600 THEN 1 ELSE 0 END) {_W} AS seg FROM g),
      u AS (SELECT *, CAST(sum(greatest(0, least(row_index % 400 - 20, 300))) OVER (PARTITION BY ad_id, seg) AS BIGINT) AS segment_s FROM s) SELECT row_index, dense_rank() OVER (PARTITION BY ad_id ORDER BY seg) AS segment, segment_s FROM u WHERE segment_s >= 300""")
add("win_track_distance", lambda s, d: x.track_summary(_track(s, d), *_ORDER),
    f"WITH {_TRACK}, nb AS (SELECT ad_id, timestamp, lon AS b_lon, lat AS b_lat, lag(lon) {_W} AS a_lon, lag(lat) {_W} AS a_lat FROM track) SELECT ad_id, round(sum(coalesce({_ab}, 0.0E0)), 4) AS metres, CAST(floor((max(timestamp) - min(timestamp)) / 60 + 0.5) AS BIGINT) AS minutes, count(*) AS n FROM nb GROUP BY 1")
_route = lambda s, d: stays(s, d).where("row_index % 40 < 5").select(F.floor(F.col("row_index") / 40).alias("route"), (F.col("row_index") % 40).alias("place"), "lon", "lat")
add("src_route_trace", lambda s, d: x.route_trace(_route(s, d), "route", 120).select("route", "offset_s", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat")),
    f"""WITH {STAYS_SQL}, v AS (SELECT CAST(floor(row_index / 40) AS BIGINT) AS route, row_index % 40 AS place, lon AS b_lon, lat AS b_lat FROM stays WHERE row_index % 40 < 5),
      n AS (SELECT *, lag(b_lon) OVER w AS a_lon, lag(b_lat) OVER w AS a_lat FROM v WINDOW w AS (PARTITION BY route ORDER BY place)), t AS (SELECT *, sum(coalesce({_ab}, 0.0E0)) OVER (PARTITION BY route ORDER BY place) AS upto, sum(coalesce({_ab}, 0.0E0)) OVER (PARTITION BY route) AS total FROM n),
      q AS (SELECT *, CASE WHEN total > 0 THEN greatest(1, CAST(floor(total / 1.4E0) AS BIGINT)) ELSE 120 END AS dur FROM t), k AS (SELECT DISTINCT route, total, dur, unnest(range(greatest(2, CAST(floor(dur / 120) AS BIGINT) + 1))) AS k FROM q),
      o AS (SELECT route, total, k, least(dur, k * 120) AS offset_s, total * least(dur, k * 120) / dur AS m FROM k), j AS (SELECT o.route, o.k, o.offset_s, o.m, q.* EXCLUDE (route, dur) FROM o JOIN q ON q.route = o.route AND q.upto >= o.m - 1e-9
        QUALIFY row_number() OVER (PARTITION BY o.route, o.k ORDER BY q.upto, q.place) = 1)
      SELECT route, offset_s, round(CASE WHEN a_lon IS NULL OR upto = m THEN b_lon ELSE b_lon - (b_lon - a_lon) * (upto - m) / ({_ab}) END, 9) AS lon, round(CASE WHEN a_lat IS NULL OR upto = m THEN b_lat ELSE b_lat - (b_lat - a_lat) * (upto - m) / ({_ab}) END, 9) AS lat FROM j""")
add("pipe_recompute", lambda s, d: reports.recompute_delta(_LIGHT(s, d).where("not indoor"), 0.85, 0.15, 0.2).select("rows", "rows_weather", F.round("new_s", 6).alias("new_s")),
    f"WITH {_L}, n AS (SELECT *, CASE WHEN source <> 'night' AND sunlit IS NOT NULL AND cloud IS NOT NULL THEN greatest(0.15E0, 1 - greatest(0.0, least(cloud, 1.0)) * 0.85E0) END AS factor FROM light_rows WHERE NOT indoor) SELECT count(*) AS rows, count(factor) AS rows_weather, round(sum(sunlit * factor * duration_s), 6) AS new_s FROM n")
_INSIDE = _SHADOW.split(", sun AS MATERIALIZED", 1)[0]
add("pipe_indoor", lambda s, d: reports.without_indoor(_points(s, d).select("row_index", "x", "y", F.lit(1).alias("sunlit"), F.lit(0.0).alias("shadow_percent"), F.lit("engine").alias("source")).join(light.covered_spots(_points(s, d), _buildings(s, d)).withColumn("indoor", F.lit(True)), ["x", "y"], "left")).select("row_index", "sunlit", "shadow_percent", "source"),
    f"WITH {_INSIDE}, i AS (SELECT DISTINCT row_index FROM inside) SELECT row_index, CASE WHEN i.row_index IS NULL THEN 1 ELSE 0 END AS sunlit, CASE WHEN i.row_index IS NULL THEN 0.0E0 ELSE 100.0E0 END AS shadow_percent, CASE WHEN i.row_index IS NULL THEN 'engine' ELSE 'indoor' END AS source FROM points LEFT JOIN i USING (row_index)")
