"""Reports: by person, day, file, district, track and building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import medians


def by_person_day(daily: DataFrame, values: list[str]) -> DataFrame:
    """One row: people, person_days, and mean and median of each value over rows; rows without an id (null or empty) count for
    person_days alone. Nulls of a value count for nothing."""
    named = F.nullif(F.trim("id"), F.lit("")).isNotNull()
    of = lambda c: F.when(named, F.col(c))
    means = daily.agg(F.countDistinct(F.nullif(F.trim("id"), F.lit(""))).alias("people"), F.count(F.lit(1)).alias("person_days"), *(F.round(F.avg(of(c)), 9).alias(f"{c}_mean") for c in values))
    middle = medians(daily.where(named), values).agg(*(F.round(F.max(F.when(F.col("value") == c, F.col("median"))), 9).alias(f"{c}_median") for c in values))
    return means.crossJoin(F.broadcast(middle))  # a row each


def by_person(daily: DataFrame, values: list[str]) -> DataFrame:
    """One row: the mean over people of each person's mean; people without a value count for nothing in it."""
    means = daily.where(F.nullif(F.trim("id"), F.lit("")).isNotNull()).groupBy("id").agg(*(F.avg(c).alias(c) for c in values))
    return means.agg(*(F.round(F.avg(c), 9).alias(f"{c}_mean_person") for c in values))


def daylight_by_file(rows: DataFrame, in_hours: Column) -> DataFrame:
    """Per file_relpath: rows, rows in the hours asked for, of those the ones with irradiance above 0 and the ones of source
    ``night``, first and last timestamp. Null irradiance is 0."""
    at = F.coalesce(in_hours, F.lit(False))
    return rows.groupBy("file_relpath").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(at).alias("rows_in_hours"), F.count_if(at & (F.col("irradiance") > 0)).alias("irr_nonzero"), F.count_if(at & (F.col("source") == "night")).alias("source_night"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
    )


def suspects(by_file: DataFrame, min_rows: int, irr_below: float, night_above: float) -> DataFrame:
    """by_file with suspect: with ``min_rows`` rows in hours or more, too few of them have light or too many are night."""
    n = F.greatest("rows_in_hours", F.lit(1))
    odd = (F.col("irr_nonzero") / n < irr_below) | (F.col("source_night") / n > night_above)
    return by_file.withColumn("suspect", (F.col("rows_in_hours") >= min_rows) & odd)


def by_district(by_file: DataFrame, district: Column, flag: str) -> DataFrame:
    """Per district its files and those with the flag."""
    return by_file.groupBy(district.alias("district")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias("flagged"))


def width_by_file(lines: DataFrame, width: Column) -> DataFrame:
    """Per file: lines, lines of another width than its header (line 1), and the first of them. lines (file, line_no, text);
    blank lines don't count; ``width`` counts the fields of text. A file is grouped, never read whole."""
    rows = lines.where(F.trim("text") != "").withColumn("_w", width)
    heads = rows.where("line_no = 1").select("file", F.col("_w").alias("_head"))
    bad = (F.col("_w") != F.col("_head")) | F.col("_head").isNull()
    return rows.where("line_no > 1").join(heads, "file", "left").groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_rows"), F.min(F.when(bad, F.col("line_no"))).alias("first_bad"))


def recomputed(rows: DataFrame, coef: float = 0.85, min_factor: float = 0.15) -> DataFrame:
    """rows (sunlit, cloud, source, duration_s) with factor, sunlit_effective, shadow_effective, sunlight_s and shadow_s anew:
    null for night rows and where light, cloud or duration is unknown."""
    known = (F.lower(F.coalesce("source", F.lit(""))) != "night") & F.col("sunlit").isNotNull() & F.col("cloud").isNotNull() & F.col("duration_s").isNotNull()
    factor = F.when(known, F.greatest(F.lit(min_factor), 1 - F.greatest(F.lit(0.0), F.least("cloud", F.lit(1.0))) * coef))
    out = rows.withColumn("factor", factor).withColumn("sunlit_effective", F.col("sunlit") * F.col("factor")).withColumn("shadow_effective", 100 - F.col("sunlit_effective") * 100)
    return out.withColumn("sunlight_s", F.col("sunlit_effective") * F.col("duration_s")).withColumn("shadow_s", F.col("shadow_effective") / 100 * F.col("duration_s"))


def recompute_delta(rows: DataFrame, coef: float, min_factor: float, old_min_factor: float) -> DataFrame:
    """One row: rows, rows with weather, rows that another least factor changes, sunlight seconds of old and new, and the change
    in per cent (null without old seconds)."""
    new = recomputed(rows, coef, min_factor)
    old_factor = F.greatest(F.lit(old_min_factor), 1 - F.greatest(F.lit(0.0), F.least("cloud", F.lit(1.0))) * coef)
    old_s = F.when(F.col("factor").isNotNull(), F.col("sunlit") * old_factor * F.col("duration_s"))
    both = new.withColumn("_old", old_s)
    out = both.agg(
        F.count(F.lit(1)).alias("rows"), F.count("factor").alias("rows_weather"), F.count_if(F.abs(F.col("sunlight_s") - F.col("_old")) > 1e-9).alias("rows_impacted"),
        F.coalesce(F.sum("_old"), F.lit(0.0)).alias("old_s"), F.coalesce(F.sum("sunlight_s"), F.lit(0.0)).alias("new_s"),
    )
    return out.withColumn("pct", F.try_divide(F.col("new_s") - F.col("old_s"), F.col("old_s")) * 100)


def without_indoor(rows: DataFrame) -> DataFrame:
    """rows with the light of those indoors taken away: sunlit 0, shadow_percent 100, irradiance 0, source ``indoor``. A null
    indoor is outdoors."""
    inside = F.coalesce(F.col("indoor"), F.lit(False))
    new = {"sunlit": F.lit(0), "shadow_percent": F.lit(100.0), "irradiance": F.lit(0.0), "source": F.lit("indoor")}
    return rows.withColumns({c: F.when(inside, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in new.items() if c in rows.columns})


def canopy_loss(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with a column for each of ``pairs``: what the first (without canopy) has more than the second, 0 at least; a null
    of either gives null."""
    return rows.withColumns({name: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(F.lit(0.0), F.col(a) - F.col(b))) for name, (a, b) in pairs.items()})


def positional(left: DataFrame, right: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    """left with ``columns`` of the row of ``right`` at the same row_index, renamed by the suffix; none where there is no such
    row. Two runs over one input pair by that number, not by how they happen to be stored."""
    return left.join(right.select("row_index", *(F.col(c).alias(c + suffix) for c in columns)), "row_index", "left")


def track_totals(tracks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tracks, metres, minutes and mean comfort (nulls apart); for one person filter before, or give ``by``."""
    return tracks.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("tracks"), F.sum("distance_m").alias("distance_m"), F.sum("duration_min").alias("duration_min"), F.round(F.avg("comfort"), 9).alias("comfort"))


def track_activity(tracks: DataFrame) -> DataFrame:
    """Per activity its tracks and metres, most tracks first, ties by name."""
    return tracks.groupBy("activity").agg(F.count(F.lit(1)).alias("tracks"), F.sum("distance_m").alias("distance_m")).orderBy(F.desc("tracks"), "activity")


def track_monthly(tracks: DataFrame, newest: int = 12) -> DataFrame:
    """Per year and month its tracks and metres; the ``newest`` months with tracks."""
    at = F.col("created_at")
    months = tracks.groupBy(F.year(at).alias("year"), F.month(at).alias("month")).agg(F.count(F.lit(1)).alias("tracks"), F.sum("distance_m").alias("distance_m"))
    return months.orderBy(F.desc("year"), F.desc("month")).limit(newest)


def building_types(buildings: DataFrame, most: int = 10) -> DataFrame:
    """The commonest kinds and their counts; ties by name, null last."""
    return buildings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("kind").asc_nulls_last()).limit(most)


def building_stats(buildings: DataFrame) -> DataFrame:
    """One row: buildings, different (region, tile_id) pairs, a size by 2,000 bytes each, oldest and newest. A pair with a null
    is one too."""
    pair = F.struct(F.coalesce("region", F.lit("")), F.col("region").isNull(), F.coalesce("tile_id", F.lit("")))
    return buildings.agg(F.count(F.lit(1)).alias("buildings"), F.countDistinct(pair).alias("tiles"), (F.count(F.lit(1)) * 2000).alias("bytes"), F.min("created").alias("oldest"), F.max("created").alias("newest"))


def point_stats(points: DataFrame) -> DataFrame:
    """One row about shadow_percent: mean, least, largest, standard deviation of the population, and counts by level at 10, 30, 60
    and 80. Nulls count for nothing; no rows give nulls and zeros."""
    p = F.col("shadow_percent")
    level = lambda a, b: F.count_if((p >= a) & (p < b))
    return points.agg(
        F.round(F.avg(p), 9).alias("mean"), F.min(p).alias("least"), F.max(p).alias("largest"), F.round(F.stddev_pop(p), 9).alias("deviation"), F.count_if(p < 10).alias("no_shadow"), level(10, 30).alias("light"),
        level(30, 60).alias("moderate"), level(60, 80).alias("heavy"), F.count_if(p >= 80).alias("extreme"),
    )


def trace_intensity(rows: DataFrame, by: str, default_kmh: float = 18.0) -> DataFrame:
    """(by, intensity): seven tenths mean speed over 45 km/h and three tenths rows a second over 4 (1 at most), held to 0.25..1.
    An unknown speed is ``default_kmh``; without time between rows their number counts as the rate."""
    span = F.max("timestamp") - F.min("timestamp")
    rate = F.when(span > 0, F.count(F.lit(1)) / span).otherwise(F.count(F.lit(1)))
    mean = F.avg(F.coalesce("speed_kmh", F.lit(default_kmh)))
    blend = mean / 45 * 0.7 + F.least(rate / 4, F.lit(1.0)) * 0.3
    return rows.groupBy(by).agg(F.round(F.greatest(F.lit(0.25), F.least(blend, F.lit(1.0))), 9).alias("intensity"))


def bounds(rows: DataFrame) -> DataFrame:
    """One row: rows, rows with a position, rows without, and the bounds of lon and lat (null without any)."""
    there = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    of = lambda f, c: f(F.when(there, F.col(c)))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(there).alias("valid"), F.count_if(~there).alias("skipped"), of(F.min, "lon").alias("west"), of(F.min, "lat").alias("south"), of(F.max, "lon").alias("east"), of(F.max, "lat").alias("north"))


def ssrd_mode(readings: DataFrame, by: str) -> DataFrame:
    """(by, mode): ``incremental`` where more than a fifth of the steps of ssrd go down, ``cumulative`` else and with fewer than
    ten readings. Nulls and NaN are no readings."""
    there = readings.where("ssrd is not null and not isnan(ssrd)")
    step = F.col("ssrd") - F.lag("ssrd").over(Window.partitionBy(by).orderBy("timestamp"))
    down = there.withColumn("_d", step).groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_d") < -1e-3).alias("_down"))
    return down.select(by, F.when((F.col("_n") >= 10) & (F.col("_down") / (F.col("_n") - 1) > 0.2), "incremental").otherwise("cumulative").alias("mode"))
