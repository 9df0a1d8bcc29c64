"""Daylight of stays as intervals: rise and set are worked out for stay and day, and only the instants beside them are tested."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import solar

DAY = 86_400
#: Days whose sun at midnight or noon stands so near the limit, in radians, are tested instant by instant.
NEAR = 0.009
#: Stay-days that are worked out at a time.
BLOCK = 200_000


def _edge(first, step, t, lon, lat, limit, up: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first lit instant, or with not ``up`` of the last one, whether it was found) about the moment t."""
    k = (np.ceil if up else np.floor)((t - first) / step).astype(np.int64)
    lit = [solar.altitude_at(first + (k + j) * step, lon, lat) > limit for j in (-2, -1, 0, 1, 2)]
    out, found = k.copy(), np.zeros(len(k), bool)
    for j in (-1, 0, 1):
        here = lit[j + 2] & ~lit[j + 1 if up else j + 3]
        out[here & ~found] = k[here & ~found] + j
        found |= here
    return out, found


def lit_runs(first: np.ndarray, n: np.ndarray, lon: np.ndarray, lat: np.ndarray, step: int = 60, above_deg: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): runs of instants lo..hi of rows of n instants ``step`` seconds apart from ``first`` at which the sun stands above
    ``above_deg``. Within a half of a solar day the sun only climbs or only sinks, so that an edge between an instant that is lit
    and one that isn't settles it; where none is found beside the worked out moment, every instant of the day is tested."""
    limit = np.radians(above_deg)
    shift = lon * 240.0
    from_day, to_day = np.floor((first + shift) / DAY), np.floor((first + (n - 1) * step + shift) / DAY)
    days = (to_day - from_day + 1).astype(np.int64)
    row = np.repeat(np.arange(len(first)), days)
    day = from_day[row] + np.arange(len(row)) - np.repeat(np.cumsum(days) - days, days)
    begin, lon_, lat_, first_ = day * DAY - shift[row], lon[row], lat[row], first[row]
    a = np.maximum(0, np.ceil((begin - first_) / step)).astype(np.int64)
    b = np.minimum(n[row] - 1, np.ceil((begin + DAY - first_) / step) - 1).astype(np.int64)
    night0, noon, night1 = (solar.altitude_at(begin + k * DAY / 2, lon_, lat_) - limit for k in (0, 1, 2))
    sure = (np.abs(night0) > NEAR) & (np.abs(noon) > NEAR) & (np.abs(night1) > NEAR)
    lo, hi = a.copy(), np.where(noon > 0, b, a - 1)
    for up, night in ((True, night0), (False, night1)):
        at = np.flatnonzero(sure & (noon > 0) & (night < 0) & (a <= b))
        t = solar.crossing(begin[at] + DAY / 2, lon_[at], lat_[at], limit, up)
        k = (t - first_[at]) / step
        near = (k > a[at] - 3) & (k < b[at] + 3)
        far = at[~near]
        if up:
            lo[far] = np.where(k[~near] < a[far], a[far], b[far] + 1)
        else:
            hi[far] = np.where(k[~near] > b[far], b[far], a[far] - 1)
        at, t = at[near], t[near]
        edge, found = _edge(first_[at], step, t, lon_[at], lat_[at], limit, up)
        sure[at[~found]] = False
        if up:
            lo[at] = np.maximum(a[at], edge)
        else:
            hi[at] = np.minimum(b[at], edge)
    kept = sure & (lo <= hi)
    rows, los, his = [row[kept]], [lo[kept]], [hi[kept]]
    unsure = np.flatnonzero(~sure & (a <= b))
    many = (b - a + 1)[unsure]
    of = np.repeat(unsure, many)
    k = a[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    lit = solar.altitude_at(first_[of] + k * step, lon_[of], lat_[of]) > limit
    rows, los, his = np.concatenate([*rows, row[of[lit]]]), np.concatenate([*los, k[lit]]), np.concatenate([*his, k[lit]])
    order = np.lexsort((los, rows))  # neighbours, of one day or of two, become one run
    rows, los, his = rows[order], los[order], his[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (los[1:] > his[:-1] + 1)) if len(rows) else np.zeros(0, bool)
    return rows[new], los[new], his[np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1)] if len(rows) else his


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)) for c in names]


def _blocks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of rows with a place and time, few enough days at a time, and their _first, _n, _lon, _lat."""
    for batch in batches:
        n = np.asarray(batch.column("_n"))
        upto = np.cumsum(n * step // DAY + 2)
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")))
            part = batch.slice(at, end - at)
            yield part, _numbers(part, ["_first", "_n", "_lon", "_lat"])
            at = end


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), more])


def _timed(rows: DataFrame, first, n, lon, lat) -> DataFrame:
    return rows.withColumns({"_first": first.cast("long"), "_n": n.cast("long"), "_lon": lon.cast("double"), "_lat": lat.cast("double")})


def lit_spans(stays: DataFrame, step: int = 60, above_deg: float = 0.0) -> DataFrame:
    """Stays (start_time, end_time, lon, lat, more) with a row for each closed span of consecutive lit instants: start_ts, end_ts, n.
    Instants are those of ``expand_stays``; none of them becomes a row. Stays without a start or a place, or with no lit
    instant, give none. Nothing is shuffled."""
    length = F.greatest(F.coalesce(F.col("end_time"), F.col("start_time")) - F.col("start_time"), F.lit(0))
    rows = _timed(stays.where("start_time is not null and lon is not null and lat is not null"), F.col("start_time"), F.greatest(F.lit(1), F.ceil(length / step)), F.col("lon"), F.col("lat"))
    keep = stays.columns

    def run(batches):
        for batch, (first, n, lon, lat) in _blocks(batches, step):
            row, lo, hi = lit_runs(first, n, lon, lat, step, above_deg)
            taken = batch.select(keep).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(first[row] + lo * step), pa.array(first[row] + hi * step), pa.array(hi - lo + 1)], [*keep, "start_ts", "end_ts", "n"])

    return rows.mapInArrow(run, _schema(stays, "start_ts long, end_ts long, n long"))


def lit_count(rows: DataFrame, first, n, lon, lat, step: int = 60, above_deg: float = 0.0) -> DataFrame:
    """rows with lit: how many of the n instants from ``first`` on are lit; 0 without a place."""
    placed, keep = _timed(rows, first, n, F.coalesce(lon, F.lit(float("nan"))), F.coalesce(lat, F.lit(float("nan")))), rows.columns

    def run(batches):
        for batch, (first, n, lon, lat) in _blocks(batches, step):
            count = np.zeros(len(n), np.int64)
            there = np.flatnonzero(np.isfinite(lon) & np.isfinite(lat))
            row, lo, hi = lit_runs(first[there], n[there], lon[there], lat[there], step, above_deg)
            np.add.at(count, there[row], hi - lo + 1)
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(count)], [*keep, "lit"])

    return placed.mapInArrow(run, _schema(rows, "lit long"))
