"""From light at a point to the light of a day: daylight, effective values, dwell, home and daily exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import solar, text
from ..functions.geo import mercator_cell, sunlight_factor
from .light import with_sun

#: Parts of the day as local hours, the last not included (fixed values).
PERIODS = {"morning": (6, 10), "midday": (10, 14), "afternoon": (14, 18), "evening": (18, 22)}


def daylight(points: DataFrame, above_deg: float = 0.0) -> DataFrame:
    """Points (timestamp, lon, lat, more) at which the sun is up: each instant is tested, whatever day its sunset falls on."""
    return with_sun(points).where(F.col("alt") > F.radians(F.lit(above_deg))).drop("alt", "az")


def effective(rows: DataFrame) -> DataFrame:
    """rows (sunlit 0 or 1, cloud, irradiance) with factor, sunlit_effective, shadow_effective and irradiance_effective. Unknown cloud
    leaves the light as it is; unknown irradiance stays so; where there is no sun it is 0."""
    out = rows.withColumn("factor", sunlight_factor(F.col("cloud")))
    out = out.withColumn("sunlit_effective", F.col("sunlit") * F.coalesce("factor", F.lit(1.0)))
    out = out.withColumn("shadow_effective", 100 - F.col("sunlit_effective") * 100)
    return out.withColumn("irradiance_effective", F.when(F.col("irradiance").isNull(), None).when(F.col("sunlit") == 0, 0.0).otherwise(F.col("irradiance")))


def integrated(rows: DataFrame) -> DataFrame:
    """rows (duration_s and what ``effective`` adds) with sunlight_s, shadow_s and irradiance_j; unknown light counts as none."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = rows.withColumn("sunlight_s", of("sunlit_effective") * F.col("duration_s")).withColumn("shadow_s", of("shadow_effective") / 100 * F.col("duration_s"))
    return out.withColumn("irradiance_j", F.greatest(of("irradiance_effective"), F.lit(0.0)) * F.col("duration_s"))


def shadow_reach(height: Column, elevation_deg: Column, margin: float, least: float, most: float) -> Column:
    """Metres that a search for obstacles must reach: how far ``height`` throws a shadow and a margin, held to least..most; most
    where the sun is down or the height unknown."""
    reach = height / F.tan(F.radians(F.greatest(elevation_deg, F.lit(0.01)))) + margin
    known = F.coalesce((elevation_deg > 0) & height.isNotNull(), F.lit(False))
    return F.when(known, F.least(F.lit(most), F.greatest(F.lit(least), reach))).otherwise(most)


def daily(rows: DataFrame, by: list[str], zone: str) -> DataFrame:
    """Per ``by`` and local date of rows (timestamp, sunlit, sunlit_effective, irradiance, duration_s): rows, minutes of sun as seen and
    after cloud, energy in kJ (irradiance already knows of clouds), its mean over the seconds of sun after cloud (null without
    any), and minutes and energy by part of the day. Unknown values add nothing."""
    at = text.local(F.col("timestamp"), zone)
    rows = rows.withColumn("_hour", F.hour(at)).withColumn("date", F.date_format(at, "yyyy-MM-dd"))
    rows = rows.withColumn("_raw", F.coalesce(F.col("sunlit"), F.lit(0)) * F.col("duration_s")).withColumn("_sun", F.coalesce(F.col("sunlit_effective"), F.lit(0.0)) * F.col("duration_s"))
    rows = rows.withColumn("_j", F.greatest(F.coalesce("irradiance", F.lit(0.0)), F.lit(0.0)) * F.col("_raw"))
    part = lambda c, a, b: F.sum(F.when((F.col("_hour") >= a) & (F.col("_hour") < b), F.col(c)).otherwise(0.0))
    periods = [x for name, (a, b) in PERIODS.items() for x in (F.round(part("_sun", a, b) / 60, 6).alias(f"{name}_min"), F.round(part("_j", a, b) / 1000, 6).alias(f"{name}_kj"))]
    return rows.groupBy(*by, "date").agg(
        F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("_raw") / 60, 6).alias("raw_sunlight_min"), F.round(F.sum("_sun") / 60, 6).alias("sunlight_min"), F.round(F.sum("_j") / 1000, 6).alias("irradiance_kj"),
        F.round(F.sum("_j") / F.nullif(F.sum("_sun"), F.lit(0.0)), 6).alias("mean_irradiance"), *periods,
    )


def dwell(points: DataFrame, by: str, order: list[str], zone: str, max_gap: int, night_from: int = 22, night_to: int = 6) -> DataFrame:
    """points with night and dwell_s: seconds to the next row, held to 0..``max_gap``, of rows at night with a position; else, and for
    the last row, null. So time after a day row or a row without a position belongs to nothing."""
    night = text.is_local_night(F.col("timestamp"), zone, night_from, night_to)
    gap = F.lead("timestamp").over(Window.partitionBy(by).orderBy(*order)) - F.col("timestamp")
    counts = night & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return points.withColumn("night", night).withColumn("dwell_s", F.when(counts & gap.isNotNull(), F.greatest(F.lit(0), F.least(gap, F.lit(max_gap)))))


def dwell_cells(rows: DataFrame, by: str, cell_m: float) -> DataFrame:
    """Per ``by`` and cell, seconds of dwell and their mean position, of rows with dwell (see ``dwell``)."""
    x, y = mercator_cell(F.col("lon"), F.col("lat"), cell_m)
    weigh = lambda c: F.sum(F.col(c) * F.col("dwell_s")) / F.nullif(F.sum("dwell_s"), F.lit(0))
    kept = rows.where("dwell_s is not null").withColumn("cell_x", x).withColumn("cell_y", y)
    return kept.groupBy(by, "cell_x", "cell_y").agg(F.sum("dwell_s").alias("seconds"), weigh("lon").alias("lon"), weigh("lat").alias("lat"))


def homes(points: DataFrame, by: str, order: list[str], zone: str, cell_m: float = 250.0, max_gap: int = 300) -> DataFrame:
    """(by, lon, lat, seconds): mean position, by seconds, in the cell where each spends most night seconds while staying (stay),
    or at all where staying gives none. Ties by cell; who has no night second has no home. Dwell follows the rows as they
    are; a row of another kind ends it."""
    timed = dwell(points, by, order, zone, max_gap)
    best = lambda cells: (
        cells.where("seconds > 0").groupBy(by).agg(F.max_by(F.struct("lon", "lat", "seconds"), F.struct("seconds", -F.col("cell_x"), -F.col("cell_y"))).alias("h"))
    )
    stay, every = best(dwell_cells(timed.where("stay"), by, cell_m)), best(dwell_cells(timed, by, cell_m))
    found = every.join(stay.withColumnRenamed("h", "s"), by, "left").select(by, F.coalesce("s", "h").alias("h"))
    return found.select(by, "h.lon", "h.lat", "h.seconds")


def hour_grid(dates: DataFrame, hours: list[int], zone: str, buffers: list[int]) -> DataFrame:
    """dates (date DATE, more) by local hour and buffer: hour, buffer_m, timestamp."""
    out = dates.withColumn("hour", F.explode(F.array(*map(F.lit, hours)))).withColumn("buffer_m", F.explode(F.array(*map(F.lit, buffers))))
    return out.withColumn("timestamp", text.local_hour_seconds(F.col("date"), F.col("hour"), zone))


def spikes(points: DataFrame, by: str, order: list[str], max_gap: int = 600, max_kmh: float = 200.0, away_m: float = 500.0, back_m: float = 200.0) -> DataFrame:
    """points with spike: the middle of three neighbours that goes ``away_m`` or farther, faster than ``max_kmh`` both ways, and
    comes back to within ``back_m``; steps must take 1 to ``max_gap`` seconds. First and last rows are none."""
    from ..functions.geo import haversine_m

    w = Window.partitionBy(by).orderBy(*order)
    at = lambda f: (f("lon").over(w), f("lat").over(w), f("timestamp").over(w))
    (lon0, lat0, t0), (lon2, lat2, t2) = at(F.lag), at(F.lead)
    d1, d2 = F.col("timestamp") - t0, t2 - F.col("timestamp")
    out, back, across = haversine_m(lon0, lat0, F.col("lon"), F.col("lat")), haversine_m(F.col("lon"), F.col("lat"), lon2, lat2), haversine_m(lon0, lat0, lon2, lat2)
    timed = d1.between(1, max_gap) & d2.between(1, max_gap)
    spike = timed & (out / d1 * 3.6 > max_kmh) & (back / d2 * 3.6 > max_kmh) & (across <= back_m) & (out >= away_m) & (back >= away_m)
    return points.withColumn("spike", F.coalesce(spike, F.lit(False)))


def moving_segments(points: DataFrame, by: str, order: list[str], max_gap: int = 600, least_s: int = 300) -> DataFrame:
    """Rows of segments whose own durations (duration_s, held to 0..300; null: 0) last ``least_s`` seconds or more; segments are
    numbered anew from 1."""
    from .mobility import gap_segments

    held = F.greatest(F.lit(0), F.least(F.coalesce("duration_s", F.lit(0)), F.lit(300)))
    timed = gap_segments(points, by, order, max_gap).withColumn("segment_s", F.sum(held).over(Window.partitionBy(by, "segment"))).where(F.col("segment_s") >= least_s)
    return timed.withColumn("segment", F.dense_rank().over(Window.partitionBy(by).orderBy("segment")).cast("long"))


def track_summary(points: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Per ``by``: metres along its rows, whole minutes from first to last (half up) and rows."""
    from .tracks import with_distance

    minutes = F.floor((F.max("timestamp") - F.min("timestamp")) / 60 + 0.5)
    return with_distance(points, by, order).groupBy(by).agg(F.round(F.sum("step_m"), 4).alias("metres"), minutes.alias("minutes"), F.count(F.lit(1)).alias("n"))


def route_trace(vertices: DataFrame, by: str, step_s: int, pace: float = 1.4) -> DataFrame:
    """(by, offset_s, lon, lat): places every ``step_s`` seconds along a polyline (by, place, lon, lat) walked at ``pace`` metres a
    second, from its start to its last whole second; two at least. Each vertex knows the metres before it, and the instants of
    its stretch are made there, so that the line never meets as one list. Lines without length stand still at their start."""
    from .tracks import with_distance

    step = max(1, step_s)
    line = with_distance(vertices.select(by, F.col("place").alias("timestamp"), "lon", "lat"), by, ["timestamp"])
    w = Window.partitionBy(by).orderBy("timestamp")
    total = F.max("total_m").over(Window.partitionBy(by))
    line = line.withColumn("_total", total).withColumn("_lon", F.lead("lon").over(w)).withColumn("_lat", F.lead("lat").over(w)).withColumn("_to", F.lead("total_m").over(w)).withColumn("_n", F.row_number().over(w))
    line = line.withColumn("_dur", F.when(F.col("_total") > 0, F.greatest(F.lit(1), F.floor(F.col("_total") / pace))).otherwise(step))
    count = F.greatest(F.lit(2), F.floor(F.col("_dur") / step) + 1)
    offset = lambda k: F.least(F.col("_dur"), k * step)
    metres = lambda k: F.col("_total") * offset(k) / F.col("_dur")
    first = (F.col("_n") == 1) & (F.col("_total") == 0)
    # of rounding: the last instant, total * duration / duration, may come out beyond the line
    near = lambda k: metres(k) - 1e-9
    held = line.where(F.col("_to").isNotNull() & (F.col("_to") > F.col("total_m")) | first)
    ks = F.filter(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.col("_total").eqNullSafe(0.0) | ((near(k) <= F.col("_to")) & ((near(k) > F.col("total_m")) | (k == 0) & (F.col("total_m") == 0))))
    rows = held.withColumn("_k", F.explode(ks))
    share = F.coalesce(F.try_divide(metres(F.col("_k")) - F.col("total_m"), F.col("_to") - F.col("total_m")), F.lit(0.0))
    share = F.when(F.col("_total") > 0, share).otherwise(0.0)
    move = lambda a, b: F.col(a) + (F.coalesce(F.col(b), F.col(a)) - F.col(a)) * share
    return rows.select(by, offset(F.col("_k")).alias("offset_s"), move("lon", "_lon").alias("lon"), move("lat", "_lat").alias("lat"))
