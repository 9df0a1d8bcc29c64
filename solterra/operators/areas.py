"""Area that polygons cover together: exact, by plane sweep over grid tiles."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .light import ring_edges

#: Edges of a tile that one sweep takes; tiles of more are parted.
MOST = 400


def shadow_rings(ring: Column, dx: Column, dy: Column) -> Column:
    """array<ring>: a footprint and, for each wall, the ground between it and itself moved by (dx, dy), its shadow's length."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    walls = F.transform(ring_edges(ring), lambda e: F.array(corner(e.ax, e.ay), corner(e.bx, e.by), corner(e.bx + dx, e.by + dy), corner(e.ax + dx, e.ay + dy)))
    return F.concat(F.array(F.transform(ring, lambda p: corner(p.x, p.y))), walls)


def swept_area(edges: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area within the box of the union of polygons, of edges (ax, ay, bx, by, turn) with ax < bx; turn is 1 where the polygon lies
    above the edge and -1 where below. Between neighbours among all ends, crossings and places where an edge meets the box's top or
    bottom nothing changes order, so that covered length is linear and the middle of such a slab stands for it."""
    ax, ay, bx, by, turn = edges.T
    slope = (by - ay) / (bx - ax)
    cuts = [np.array([x0, x1]), ax, bx]
    with np.errstate(divide="ignore", invalid="ignore"):
        cuts += [ax + (y - ay) / slope for y in (y0, y1)]
        i, j = np.triu_indices(len(ax), 1)
        at = (ay[j] - slope[j] * (ax[j] - x0) - ay[i] + slope[i] * (ax[i] - x0)) / (slope[i] - slope[j]) + x0
        cuts.append(at[(at > np.maximum(ax[i], ax[j])) & (at < np.minimum(bx[i], bx[j]))])
    cuts = np.concatenate(cuts)
    cuts = np.unique(cuts[(cuts >= x0) & (cuts <= x1)])  # what isn't a number goes too
    area = 0.0
    for k in range(0, len(cuts) - 1, 256):
        left, right = cuts[k : k + 257][:-1, None], cuts[k : k + 257][1:, None]
        middle = (left + right) / 2
        over = (ax <= middle) & (middle <= bx)
        y = np.clip(np.where(over, ay + slope * (middle - ax), y1), y0, y1)
        order = np.argsort(y, axis=1, kind="stable")
        depth = np.cumsum(np.take_along_axis(np.where(over, turn, 0), order, 1), axis=1)
        length = np.where(depth[:, :-1] > 0.5, np.diff(np.take_along_axis(y, order, 1), axis=1), 0.0).sum(axis=1)
        area += float(((right - left)[:, 0] * length).sum())
    return area


def union_area(polygons: DataFrame, by: list[str], tile: float, most: int = MOST) -> DataFrame:
    """(by, tx, ty, area): how much of each tile of side ``tile`` the polygons (by, ring array<struct<x,y>>) of a group cover
    together, overlaps once; tiles without any don't come, so that a group's area is the sum of its tiles'.

    Rings may be open or closed and of either direction but must not cross themselves; null rings and those without area cover
    nothing, equal polygons count once. Polygons are cut by tile: each tile gets the edges over its width, from just the polygons
    that touch it, and is swept alone. A tile of more than ``most`` edges is parted into a grid of smaller ones by that number, so
    that no task sweeps a crowded place whole. ``by`` holds columns of simple types."""
    held = polygons.where("ring is not null").select(*by, F.transform("ring", lambda p: F.struct(p.x.cast("double").alias("x"), p.y.cast("double").alias("y"))).alias("ring")).distinct()
    twice = F.aggregate(ring_edges("ring"), F.lit(0.0), lambda s, e: s + (e.ax - F.col("ring")[0].x) * (e.by - F.col("ring")[0].y) - (e.bx - F.col("ring")[0].x) * (e.ay - F.col("ring")[0].y))
    turned = held.where(F.size("ring") > 2).select(*by, F.signum(twice).alias("_sign"), ring_edges("ring").alias("_edges")).where("_sign <> 0")
    edge = lambda e: F.struct(
        *(F.when(e.ax < e.bx, e[a]).otherwise(e[b]).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))), (F.when(e.ax < e.bx, 1.0).otherwise(-1.0) * F.col("_sign")).alias("turn")
    )
    whole = turned.select(*by, F.transform(F.filter("_edges", lambda e: e.ax != e.bx), edge).alias("_edges"))
    bound = lambda f, c: f(F.transform("_edges", lambda e: e[c]))
    whole = whole.withColumns({"_x0": bound(F.array_min, "ax"), "_x1": bound(F.array_max, "bx")})

    def cut(rows: DataFrame, tx: str, ty: str, x_from: Column, y_from: Column, side: Column, last: Column | None) -> DataFrame:
        """rows in the tiles that their polygon touches, column by column, with the edges over the column."""
        hold = lambda v: v if last is None else F.greatest(F.lit(0), F.least(v, last))
        rows = rows.withColumn(tx, F.explode(F.sequence(hold(F.floor((F.col("_x0") - x_from) / side)), hold(F.floor((F.col("_x1") - x_from) / side)))))
        a, b = x_from + F.col(tx) * side, x_from + (F.col(tx) + 1) * side
        rows = rows.withColumns({"_a": a, "_b": b}).withColumn("_edges", F.filter("_edges", lambda e: (e.ax <= F.col("_b")) & (e.bx >= F.col("_a"))))
        at = lambda e, x: e.ay + (e.by - e.ay) / (e.bx - e.ax) * (x - e.ax)
        ends = F.flatten(F.transform("_edges", lambda e: F.array(at(e, F.greatest(e.ax, F.col("_a"))), at(e, F.least(e.bx, F.col("_b"))))))
        rows = rows.where(F.size("_edges") > 0).withColumn("_ys", ends)
        low, high = F.floor((F.array_min("_ys") - y_from) / side), F.floor((F.array_max("_ys") - y_from) / side)
        inside = F.lit(True) if last is None else (high >= 0) & (low <= last)
        return rows.where(inside).withColumn(ty, F.explode(F.sequence(hold(low), hold(high)))).drop("_a", "_b", "_ys")

    side = F.lit(float(tile))
    tiled = cut(whole, "tx", "ty", F.lit(0.0), F.lit(0.0), side, None)
    crowd = tiled.groupBy(*by, "tx", "ty").agg(F.sum(F.size("_edges")).alias("_n"))
    parts = crowd.select(*(F.col(c).alias(f"_k{c}") for c in (*by, "tx", "ty")), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / most))).cast("long").alias("_parts")).where("_parts > 1")
    same = F.lit(True)
    for c in (*by, "tx", "ty"):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
    known = tiled.join(parts, same, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop(*(f"_k{c}" for c in (*by, "tx", "ty")))
    plain, crowded = known.where("_parts = 1").withColumns({"_i": F.lit(0).cast("long"), "_j": F.lit(0).cast("long")}), known.where("_parts > 1")
    small = side / F.col("_parts")
    crowded = cut(crowded, "_i", "_j", F.col("tx") * side, F.col("ty") * side, small, F.col("_parts") - 1)
    rows = plain.unionByName(crowded).select(*by, "tx", "ty", "_i", "_j", "_parts", F.explode("_edges").alias("_e")).select(*by, "tx", "ty", "_i", "_j", "_parts", "_e.*")
    keys = [*by, "tx", "ty", "_i", "_j"]

    def run(batches):
        def each():
            for batch in batches:
                yield from zip(zip(*(batch.column(c).to_pylist() for c in [*keys, "_parts"])), np.stack([np.asarray(batch.column(c)) for c in ("ax", "ay", "bx", "by", "turn")], axis=1))

        out = []
        for key, group in itertools.groupby(each(), key=lambda r: r[0]):
            *name, tx, ty, i, j, parts = key
            every = np.array([e for _, e in group])
            line, of = np.unique(every[:, :4], axis=0, return_inverse=True)
            edges = np.column_stack([line, np.bincount(of.ravel(), every[:, 4])])  # polygons that share an edge each count in its turn
            size = tile / parts
            left, low = tx * tile + i * size, ty * tile + j * size
            edges = edges - np.array([left, low, left, low, 0.0])  # small numbers: nothing is lost where lines cross
            out.append((*name, tx, ty, swept_area(edges, 0.0, 0.0, size, size)))
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    told = rows.select(*by, "tx", "ty", F.col("ax").alias("area")).schema
    arrow, names = to_arrow_schema(told), told.names
    swept = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, told)
    return swept.groupBy(*by, "tx", "ty").agg(F.sum("area").alias("area")).where("area > 0")
