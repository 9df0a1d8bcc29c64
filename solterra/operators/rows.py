"""Rows as they come from files: positions by priority, heights, validity, hours, samples, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .scans import ranked

#: Columns of each source of positions (fixed names of the file format).
COORDINATES = {
    "fnl": ("fnl_lon", "fnl_lat"), "gps": ("gps_lon", "gps_lat"), "gpx": ("gpx_lon", "gpx_lat"), "air": ("air_lon", "air_lat"),
    "stay_point": ("stay_point_x", "stay_point_y"), "lnglat": ("lng", "lat"), "lonlat": ("lon", "lat"),
}
PRIORITY = ["fnl", "gps", "gpx", "air", "lnglat"]
INDOOR_PRIORITY = ["stay_point", *PRIORITY]
#: Heights of building types in metres where nothing else is known (fixed values).
TYPE_HEIGHTS = {
    "house": 6.0, "residential": 12.0, "apartments": 20.0, "commercial": 15.0, "retail": 8.0, "office": 25.0, "industrial": 10.0,
    "warehouse": 8.0, "hospital": 15.0, "school": 10.0, "church": 12.0, "tower": 50.0, "skyscraper": 100.0,
}


def with_columns(rows: DataFrame, **types: str) -> DataFrame:
    """rows with a null column for each named one that is absent; columns that are there stay as they are."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in rows.columns})


def is_stay(status: Column) -> Column:
    """Whether a stay status says so: a number of 1 or more, or true, yes, y. Null, empty and other text: no."""
    t = F.lower(F.trim(status))
    return F.coalesce(text.number(t) >= 1, t.isin("true", "yes", "y"), F.lit(False))


def _pair(rows: DataFrame, source: str, ok) -> Column:
    lon, lat = (F.trim(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("string") for c in COORDINATES[source])
    there = ok(lon) & ok(lat)
    if source == "stay_point":
        there &= is_stay(F.col("stay_status").cast("string")) if "stay_status" in rows.columns else F.lit(False)
    return F.when(there, F.struct(lon.alias("lon"), lat.alias("lat"), F.lit(source).alias("source")))


def pick_coordinates(rows: DataFrame, priority: list[str] = PRIORITY, numeric: bool = False) -> DataFrame:
    """rows with picked struct<lon,lat,source> (text): the first source of ``priority`` of which both values are there, the stay
    point only while staying; with ``numeric`` both must be finite numbers, else any text counts. Null where none is; sources
    whose columns are absent are passed over."""
    ok = (lambda c: text.number(c).isNotNull()) if numeric else (lambda c: F.coalesce(c != "", F.lit(False)))
    return rows.withColumn("picked", F.coalesce(*(_pair(rows, s, ok) for s in priority)))


def resolve_height(rows: DataFrame, preferred: str | None = None, default: float = 12.0) -> Column:
    """Height in metres by the first column there is of ``preferred``, height, height_m, HEIGHT, height_mean, else 3.5 for each
    of levels: what is no finite number is ``default``, negative is 0."""
    names = [c for c in (preferred, "height", "height_m", "HEIGHT", "height_mean") if c and c in rows.columns]
    if names:
        value = text.number(F.col(names[0]).cast("string"))
    else:
        value = text.number(F.col("levels").cast("string")) * 3.5 if "levels" in rows.columns else F.lit(None).cast("double")
    return F.greatest(F.coalesce(value, F.lit(default)), F.lit(0.0))


def height_by_area(height: Column, area: Column) -> Column:
    """A height above 0, else 0.12 of the root of an area above 0 held to 5..60, else 12."""
    return F.when(height > 0, height).when(area > 0, F.greatest(F.least(F.sqrt(area) * 0.12, F.lit(60.0)), F.lit(5.0))).otherwise(12.0)


def levels_of(height: Column) -> Column:
    """Storeys of three metres, one at least; half rounds up."""
    return F.when(height.isNotNull(), F.greatest(F.lit(1), F.floor(height / 3 + 0.5)).cast("long"))


def height_by_type(height: Column, levels: Column, kind: Column) -> Column:
    """A height, else 3.5 for each level, both held to 3..300; else by TYPE_HEIGHTS; else 8. Zero and null count as absent."""
    held = lambda v: F.greatest(F.lit(3.0), F.least(v, F.lit(300.0)))
    table = F.create_map(*(x for k, v in TYPE_HEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    return F.when(height != 0, held(height)).when(levels != 0, held(levels * 3.5)).otherwise(F.coalesce(F.try_element_at(table, kind), F.lit(8.0)))


def validity(rows: DataFrame, id_col: str, lon: str, lat: str, start: str) -> Column:
    """``no_id``, ``no_position``, ``no_start`` or ``ok``: the first that is wrong; an empty id is none, text positions must be
    finite numbers."""
    number = lambda c: text.number(F.col(c).cast("string"))
    return (
        F.when(F.coalesce(F.trim(F.col(id_col).cast("string")), F.lit("")) == "", "no_id")
        .when(number(lon).isNull() | number(lat).isNull(), "no_position").when(number(start).isNull(), "no_start").otherwise("ok")
    )


def valid_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a box lies within the WGS84 range and isn't inverted or without width or height; null corners: not."""
    inside = west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90)
    return F.coalesce(inside & (west < east) & (south < north), F.lit(False))


def boxes_touch(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether boxes (west, south, east, north) overlap, edges included."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def in_hours(rows: DataFrame, seconds: str, zone: str, spec: str) -> DataFrame:
    """Rows whose local hour is in the list (see ``text.hour_list``); an empty list keeps none, rows without a time go."""
    return rows.where(F.hour(text.local(F.col(seconds), zone)).isin(text.hour_list(spec)))


def hash_share(id_col: Column) -> Column:
    """A number in [0, 1) that hangs on the id alone: its first 16 hex digits of SHA-1 as a fraction."""
    return F.conv(F.substring(F.sha1(id_col.cast("string").cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def sample_ids(rows: DataFrame, id_col: str, share: float) -> DataFrame:
    """All rows of about ``share`` of the ids: an id is in or out whatever else there is; null ids are out."""
    return rows.where(hash_share(F.col(id_col)) < share)


def hash_shard(id_col: Column, shards: int) -> Column:
    """Shard of an id by its first 8 hex digits of SHA-1."""
    return F.pmod(F.conv(F.substring(F.sha1(id_col.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def shard_stats(rows: DataFrame, id_col: str, shards: int) -> DataFrame:
    """(shard, n, ids): rows and different ids of each shard that has rows; rows without an id have shard null."""
    return rows.groupBy(hash_shard(F.col(id_col), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(id_col).alias("ids"))


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the other columns of ``new`` where new has the row's keys: a row of new replaces all of them, nulls too; rows
    only in new are left out. New has a key once."""
    values = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, F.struct(*values).alias("_new"))
    joined = old.join(fresh, keys, "left")
    return joined.select(*keys, *(F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c) for c in values))


def first_valid(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(by, lon, lat): position of the first row of each ``by`` that has one, in the order given; ties by the position."""
    there = rows.where("lon is not null and lat is not null")
    return there.groupBy(by).agg(F.min_by(F.struct("lon", "lat"), F.struct(*order, "lon", "lat")).alias("p")).select(by, "p.lon", "p.lat")


def round_robin(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """rows with shard: place in the order modulo n."""
    return ranked(rows, order).withColumn("shard", F.pmod("rank", F.lit(n)).cast("int")).drop("rank")


def page(rows: DataFrame, after: Column | None, order: list[Column], limit: int) -> tuple[DataFrame, Column]:
    """(rows of a page and one more if there is one, marked by ``has_more``): those beyond the cursor in the order. ``after``
    says which rows lie beyond it; the order must be total."""
    kept = (rows.where(after) if after is not None else rows).orderBy(*order).limit(limit + 1)
    w = Window.orderBy(*order)
    numbered = kept.withColumn("_n", F.row_number().over(w)).withColumn("has_more", F.max("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return numbered.where(F.col("_n") <= limit).drop("_n"), F.col("has_more")
