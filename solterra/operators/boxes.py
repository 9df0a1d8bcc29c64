"""Joins of boxes of any size by a grid of many levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of level k are 4 ** k wide; no box is stored finer than LOWEST, about a ten-thousandth of a unit, nor coarser than HIGHEST;
#: cells of level WORLD hold the globe.
LOWEST, HIGHEST, WORLD = -7, 20, 5
LEFT, RIGHT = ("west", "south", "east", "north"), ("min_lon", "min_lat", "max_lon", "max_lat")


def level_of(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The level whose cells are as wide as the box or wider, up to four times: the box touches four of them at most."""
    longer = F.greatest(east - west, north - south)
    return F.greatest(F.lit(LOWEST), F.when(longer > 0, F.ceil(F.log2(longer) / 2))).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(4.0), level)).cast("long")


def _around(rows: DataFrame, side: str, names: tuple[str, ...], globe: bool) -> DataFrame:
    """rows with the bounds that are joined, ``side`` before their names. On the globe a box begins within -180..180 and may
    end beyond (a west greater than the east goes across the date line); then it comes a second time, moved back by a turn."""
    w, s, e, n = (F.col(c).cast("double") for c in names)
    if not globe:
        return rows.withColumns({f"{side}w": w, f"{side}s": s, f"{side}e": e, f"{side}n": n, f"{side}moved": F.lit(0.0)})
    width = e - w + F.when(w > e, 360.0).otherwise(0.0)
    begin = F.when(width >= 360, -180.0).when((w >= -180) & (w < 180), w).otherwise(F.pmod(w + 180, F.lit(360.0)) - 180)
    end = F.when(width >= 360, 180.0).when((w >= -180) & (w < 180) & (w <= e), e).otherwise(begin + width)
    rows = rows.withColumns({f"{side}w": begin, f"{side}s": s, f"{side}e": end, f"{side}n": n})
    turns = F.when(F.col(f"{side}e") >= 180, F.array(F.lit(0.0), F.lit(360.0))).otherwise(F.array(F.lit(0.0)))
    rows = rows.withColumn(f"{side}moved", F.explode(turns))
    return rows.withColumns({f"{side}{c}": F.col(f"{side}{c}") - F.col(f"{side}moved") for c in "we"})


def _cells(rows: DataFrame, side: str) -> DataFrame:
    """rows in each cell of level _level that they touch."""
    covered = lambda a, b: F.explode(F.sequence(_cell(F.col(f"{side}{a}"), F.col("_level")), _cell(F.col(f"{side}{b}"), F.col("_level"))))
    return rows.withColumn("_x", covered("w", "e")).withColumn("_y", covered("s", "n"))


def box_join(boxes: DataFrame, catalog: DataFrame, on: list[str] | None = None, globe: bool = True, spread: bool = False, highest: int | None = None, parts: int | None = None) -> DataFrame:
    """Boxes (west, south, east, north, more) with the rectangles (min_lon .. max_lat, more) that they touch, edges included; with
    ``on`` only those of equal columns. Each pair comes once, boxes across the date line included (``globe``: degrees).

    A box is stored in the cells of the level of its own size, four at most. A pair meets at the level of its coarser box: boxes
    look up the levels that rectangles stand on, from their own level upwards; rectangles look up the coarser levels
    of larger boxes. A pair counts in the first cell of its overlap. The levels of the catalog, a few numbers, are gathered first.
    Boxes with a null bound, or that end before they begin, match nothing. With ``spread`` the catalog too is dealt out by cell
    and never sent whole to every executor. ``highest``: the level of the largest box, if known; rectangles look up none beyond it.
    ``parts``: partitions that both are dealt out to, however few their bytes, where a cell makes many more rows than it reads.
    """
    on = on or []
    whole = lambda df, n: df.where(F.col(n[0]).isNotNull() & F.col(n[2]).isNotNull() & (F.col(n[1]) <= F.col(n[3])) & (F.lit(globe) | (F.col(n[0]) <= F.col(n[2]))))
    left, right = _around(whole(boxes, LEFT), "_l", LEFT, globe), _around(whole(catalog, RIGHT), "_r", RIGHT, globe)
    own = lambda df, side: df.withColumn("_own", level_of(*(F.col(f"{side}{c}") for c in "wsen")))
    left, right = own(left, "_l"), own(right, "_r")
    levels = sorted(r[0] for r in right.select("_own").distinct().collect())
    if not levels:
        levels = [LOWEST]
    keys = [*on, "_level", "_x", "_y"]
    placed = lambda df: df.repartition(parts, *keys) if parts else df
    dealt = lambda df: placed(df).hint("merge") if spread else df
    up = F.filter(F.array(*map(F.lit, levels)), lambda k: k >= F.col("_own"))
    finer = placed(_cells(left.withColumn("_level", F.explode(up)), "_l").drop("_own")).join(dealt(_cells(right.withColumnRenamed("_own", "_level"), "_r")), keys)
    stored = placed(_cells(left.where(F.col("_own") > levels[0]).withColumnRenamed("_own", "_level"), "_l"))
    top = highest if highest is not None else WORLD if globe else HIGHEST
    higher = F.explode(F.sequence(F.col("_own") + 1, F.greatest(F.col("_own") + 1, F.lit(top))))
    coarser = stored.join(dealt(_cells(right.withColumn("_level", higher), "_r").drop("_own")), keys)
    touch = (F.col("_lw") <= F.col("_re")) & (F.col("_le") >= F.col("_rw")) & (F.col("_ls") <= F.col("_rn")) & (F.col("_ln") >= F.col("_rs"))
    first = (F.col("_x") == _cell(F.greatest("_lw", "_rw"), F.col("_level"))) & (F.col("_y") == _cell(F.greatest("_ls", "_rs"), F.col("_level")))
    met = finer.unionByName(coarser).where(touch & first)
    if globe:  # a pair that meets where both begin doesn't count again a turn away
        at_home = ((F.col("_lw") + F.col("_lmoved")) <= (F.col("_re") + F.col("_rmoved"))) & ((F.col("_le") + F.col("_lmoved")) >= (F.col("_rw") + F.col("_rmoved")))
        met = met.where(((F.col("_lmoved") == 0) & (F.col("_rmoved") == 0)) | (((F.col("_lmoved") == 0) | (F.col("_rmoved") == 0)) & ~at_home))
    return met.drop("_level", "_x", "_y", *(f"{side}{c}" for side in ("_l", "_r") for c in ("w", "s", "e", "n", "moved")))
