"""Column expressions of text, time and keys. Unless said otherwise a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def utc(seconds: Column) -> Column:
    """The wall clock in UTC at epoch second ``seconds``, whatever the session's time zone."""
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def number(text: Column) -> Column:
    """The finite number that trimmed text is, else null: empty text, words and ``inf`` are none."""
    t = F.trim(text)
    value = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def minute_floor(seconds: Column) -> Column:
    return F.floor(seconds / 60) * 60


def minute_iso(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:00.000Z`` of the minute that holds the epoch second, fractions and times before 1970 too."""
    return F.date_format(utc(minute_floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket(seconds: Column, minutes: Column) -> tuple[Column, Column]:
    """[start, end) of the bucket of ``minutes`` (held to 1..1440) that holds the second."""
    width = F.when(minutes.isNotNull(), F.greatest(F.lit(1), F.least(minutes, F.lit(1440))) * 60)
    start = F.floor(seconds / width) * width
    return start, start + width


def bucket_key(text: Column) -> Column:
    """Trimmed key; one that ends in Z and has no dot gets milliseconds."""
    t = F.trim(text)
    return F.when(t.endswith("Z") & ~t.contains("."), F.concat(F.regexp_replace(t, "Z$", ""), F.lit(".000Z"))).otherwise(t)


def iso_seconds(text: Column) -> Column:
    """Epoch seconds (double) of ISO text: a date, or date and time with or without a zone, UTC without one; else null."""
    t = F.trim(text)
    whole = F.regexp_replace(t, r"^(.{10}[T ][0-9]{2}:[0-9]{2})(?=Z|[+-]|$)", "$1:00")
    dated = F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), whole).otherwise(F.concat(whole, F.lit("Z")))
    return F.when(t.rlike(_ISO), dated.try_cast("timestamp").cast("double"))


def parse_seconds(*texts: Column, bucket_start: Column | None = None) -> Column:
    """Epoch seconds (double): the first of ``texts`` that is a number above 0 or an ISO time, else the ISO time of
    ``bucket_start``."""
    tries = [x for t in texts for x in (F.when(number(t) > 0, number(t)), iso_seconds(t))]
    return F.coalesce(*tries, *([iso_seconds(bucket_start)] if bucket_start is not None else []))


def parse_epoch(text: Column) -> Column:
    """Epoch seconds (double) of a number, taken for milliseconds above 10^12, or of an ISO time."""
    n = number(text)
    return F.coalesce(F.when(n > 1e12, n / 1000).otherwise(n), iso_seconds(text))


def local(seconds: Column, zone: str | Column) -> Column:
    """The wall clock of the zone at an epoch second; daylight saving by the zone's rules."""
    return F.convert_timezone(F.lit("UTC"), zone if isinstance(zone, Column) else F.lit(zone), utc(seconds))


def is_local_night(seconds: Column, zone: str | Column, night_from: int = 22, night_to: int = 6) -> Column:
    hour = F.hour(local(seconds, zone))
    return (hour >= night_from) | (hour < night_to)


def local_hour_seconds(date: Column, hour: Column, zone: str) -> Column:
    """Epoch seconds of an hour of a local date."""
    wall = date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, F.lit(0), F.lit(0))
    moved = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    return F.timestamp_diff("SECOND", F.lit(_EPOCH).cast("timestamp_ntz"), moved)


def hour_list(spec: str) -> list[int]:
    """Hours of ``6-8,12,22-3``: ranges include both ends and wrap at midnight; hours outside 0..23 go."""
    out: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        first, _, last = part.partition("-")
        a, b = int(first), int(last or first)
        out |= set(range(a, b + 1)) if a <= b else set(range(a, 24)) | set(range(b + 1))
    return sorted(h for h in out if 0 <= h <= 23)


def hundredths(value: Column, positive: str, negative: str) -> Column:
    """A sign letter and five digits: hundredths of a degree, half to even."""
    return F.concat(F.when(value >= 0, positive).otherwise(negative), F.lpad(F.bround(F.abs(value) * 100).cast("long").cast("string"), 5, "0"))


def partition_id(prefix: str, size_deg: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """``prefix_dSSS_w07400_n04070_w07395_n04075``: size and corners of a rectangle in hundredths of a degree."""
    size = F.lpad(F.bround(size_deg * 100).cast("long").cast("string"), 3, "0")
    corners = [hundredths(west, "e", "w"), hundredths(south, "n", "s"), hundredths(east, "e", "w"), hundredths(north, "n", "s")]
    return F.concat_ws("_", F.lit(prefix), F.concat(F.lit("d"), size), *corners)


_TILE = "^([we])([0-9]{3})_([ns])([0-9]{2})_([we])([0-9]{3})_([ns])([0-9]{2})$"


def tile_bounds(tile_id: Column) -> Column:
    """struct<west,south,east,north> (int) of ids such as ``w075_n45_w070_n40``, corners in any order; null for other text."""
    part = lambda k: F.regexp_extract(tile_id, _TILE, k)
    signed = lambda k, minus: F.when(part(k) == minus, -1).otherwise(1) * part(k + 1).try_cast("int")
    lon, lat = (signed(1, "w"), signed(5, "w")), (signed(3, "s"), signed(7, "s"))
    box = F.struct(F.least(*lon).alias("west"), F.least(*lat).alias("south"), F.greatest(*lon).alias("east"), F.greatest(*lat).alias("north"))
    return F.when(tile_id.rlike(_TILE), box)


def district(path: Column) -> Column:
    """First part of a relative path."""
    return F.split_part(path, F.lit("/"), F.lit(1))


def derived_relpath(path: Column) -> Column:
    """``shard.csv`` of ``.../shard/tasks.csv``; a path without a folder stays."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return F.when(folder != "", F.concat(folder, F.lit(".csv"))).otherwise(path)


def has_prefix(text: Column, prefixes: list[str]) -> Column:
    """Whether text begins with any of the prefixes; null counts as no."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.coalesce(text.startswith(p), F.lit(False))
    return out


def one_line(text: Column, limit: int = 200) -> Column:
    """Line breaks as spaces, ``limit`` characters at most."""
    return F.substring(F.translate(text, "\r\n", "  "), 1, limit)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of an array of ids, each ended by a line feed; an empty array has the digest of nothing."""
    return F.sha2(F.array_join(F.transform(ids, lambda i: F.concat(i, F.lit("\n"))), ""), 256)


def month(seconds: Column) -> Column:
    return F.date_format(utc(seconds), "yyyy-MM")


def split_cell_key(key: Column) -> dict[str, Column]:
    """Parts of ``provider:resolution:token[:y]``: resolution and square_y are whole numbers where they can be; the token of a
    ``square`` key is its x."""
    part = lambda k: F.nullif(F.split_part(key, F.lit(":"), F.lit(k)), F.lit(""))
    square = part(1) == "square"
    return {"cell_provider": part(1), "cell_resolution": part(2).try_cast("int"), "cell_token": part(3), "square_y": F.when(square, part(4).try_cast("bigint"))}


def plain_number(value: Column) -> Column:
    """Six digits behind the point at most, no trailing zeros: ``0``, ``1``, ``0.25``; null stays null."""
    text = F.when(value.isNotNull(), F.format_string("%.6f", value))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
