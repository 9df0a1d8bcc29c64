"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of a label are one class with a count. In each tree, nodes of over LEAF classes are split again and again at
the median of a random projection; the share SPILL of the node on either side of it goes to both, so that a level makes
1 + 2 * SPILL copies at every depth. Directions and cuts are fitted on a bounded sample of each node, then every vector is
routed. Within leaves all cosines are computed; a leaf that no projection splits, because its vectors are alike, is
compared in blocks. Only vectors of one length meet. A pair counts in the first leaf that its two vectors share, so links are counted without writing
pairs: a leaf gives counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, read, stage
from .components import connected_components

TREES, LEAF, SPILL = 4, 256, 0.02
#: Vectors that fit a node's splits (in expectation), levels a round, and the rows of a block of an unsplit leaf.
SAMPLE, LEVELS, BLOCK = 4096, 6, 256

_NODE = ["label", "length", "tree", "node"]


def _direction(tree: int, node: int, size: int) -> np.ndarray:
    u = np.random.default_rng((tree, node)).standard_normal(size)
    return u / np.linalg.norm(u)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, length, x): unit vectors of the rows that can link. Of rows that share a vec_id the least (label, vector) counts."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("label", F.col("embedding").cast("array<double>").alias("v"))).alias("r"))
    norm = F.sqrt(F.aggregate("r.v", F.lit(0.0), lambda s, v: s + v * v))
    rows = rows.select("vec_id", "r.label", "r.v", norm.alias("norm")).where("norm > 0")
    return rows.select("vec_id", "label", F.size("v").alias("length"), F.transform("v", lambda v: v / F.col("norm")).alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _fit(rows: pa.Table) -> pa.Table:
    """Cuts (low, high) of LEVELS levels below a node, in heap order: what lies below high goes left, what does not lie
    below low goes right. NaN where a node stays whole."""
    x, tree, root = _matrix(rows.column("x")), rows.column("tree")[0].as_py(), rows.column("node")[0].as_py()
    levels = max(1, min(LEVELS, math.ceil(math.log2(rows.column("n")[0].as_py() / (LEAF * 0.75)))))
    cuts = np.full((2, (1 << levels) - 1), np.nan)
    inside = {1: np.arange(len(x))}
    for h in range(1, 1 << levels):
        mine = inside.get(h)
        if mine is None or len(mine) < 8:
            continue
        depth = h.bit_length() - 1
        p = x[mine] @ _direction(tree, root << depth | (h - (1 << depth)), x.shape[1])
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        left, right = mine[p < high], mine[p >= low]
        if len(left) + len(right) > 1.6 * len(mine) or not len(left):  # its vectors are too alike for this direction
            continue
        cuts[:, h - 1] = low, high
        inside[2 * h], inside[2 * h + 1] = left, right
    return pa.table({**{c: rows.column(c)[:1] for c in _NODE}, "cuts": pa.array([cuts.ravel().tolist()], pa.list_(pa.float64()))})


def _route(batches):
    for batch in batches:
        out, vectors = ([], [], []), batch.column("x")
        places: dict[tuple, list[int]] = {}
        cuts_of = batch.column("cuts")
        trees, nodes = batch.column("tree").to_pylist(), batch.column("node").to_pylist()
        for k, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("length").to_pylist(), trees, nodes)):
            places.setdefault(key, []).append(k)
        for (*_, tree, root), rows in places.items():
            (lows, highs), front = np.array(cuts_of[rows[0]].as_py()).reshape(2, -1), {1: np.arange(len(rows))}
            x, rows = _matrix(vectors.take(pa.array(rows))), np.array(rows)
            while front:
                h, mine = front.popitem()
                depth = h.bit_length() - 1
                node = root << depth | (h - (1 << depth))
                if h > len(lows) or math.isnan(lows[h - 1]):
                    out[0].append(rows[mine])
                    out[1].append(np.full(len(mine), node))
                    out[2].append(np.full(len(mine), h <= len(lows)))  # it could not be split: final
                    continue
                p = x[mine] @ _direction(tree, node, x.shape[1])
                for side, to in ((p < highs[h - 1], 2 * h), (p >= lows[h - 1], 2 * h + 1)):
                    if side.any():
                        front[to] = mine[side]
        at = pa.array(np.concatenate(out[0]) if out[0] else np.zeros(0, np.int64))
        kept = batch.take(at)
        yield pa.RecordBatch.from_arrays(
            [kept.column("vec_id"), kept.column("m"), kept.column("label"), kept.column("length"), kept.column("tree"), pa.array(np.concatenate(out[1]) if out[1] else np.zeros(0, np.int64)), pa.array(np.concatenate(out[2]) if out[2] else np.zeros(0, bool)), kept.column("x")],
            ["vec_id", "m", "label", "length", "tree", "node", "final", "x"],
        )


def forest(vectors: DataFrame) -> DataFrame:
    """(vec_id, m, label, length, tree, node, x): every class (vec_id, m, label, length, x) in the leaves of TREES trees of its label and length."""
    label = vectors.schema["label"].dataType.simpleString()
    columns = ["vec_id", "m", *_NODE, "x"]
    open_rows = stage(vectors.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn("node", F.lit(1).cast("long")).withColumn("final", F.lit(False)), "root")
    done = []
    for _ in range(60 // LEVELS):
        sizes = stage(open_rows.where("not final").groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF), "sizes")
        if sizes.isEmpty():
            break
        sample = open_rows.where("not final").join(sizes, _NODE).where(F.pmod(F.xxhash64("vec_id", "tree", "node"), F.col("n")) < SAMPLE).select(*_NODE, "n", "x")
        cuts = stage(sample.groupBy(*_NODE).applyInArrow(_fit, f"label {label}, length int, tree int, node long, cuts array<double>"), "cuts")
        done.append(open_rows.where("final").select(columns))
        done.append(open_rows.where("not final").join(sizes, _NODE, "left_anti").select(columns))
        inner = open_rows.where("not final").join(cuts, _NODE).select("vec_id", "m", *_NODE, "cuts", "x")
        open_rows = stage(inner.mapInArrow(_route, f"vec_id long, m long, label {label}, length int, tree int, node long, final boolean, x array<double>"), "routed")
    out = open_rows.select(columns)
    for more in done:
        out = out.unionByName(more)
    return stage(out, "leaves")


def _first_shared(homes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first leaf that rows a and b share, of their padded lists of leaves."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for at in range(0, len(a), 50_000):
        x, y, found = homes[a[at : at + 50_000]], homes[b[at : at + 50_000]], out[at : at + 50_000]
        same = x[:, 0] == y[:, 0]  # the lists ascend: where their first leaves agree, no other comes before
        found[same] = x[same, 0]
        rest = np.flatnonzero(~same)
        for c in range(homes.shape[1]):
            if not len(rest):
                break
            hit = (x[rest, c : c + 1] == y[rest]).any(axis=1) & (x[rest, c] >= 0)
            found[rest[hit]] = x[rest[hit], c]
            rest = rest[~hit]
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id of vectors (vec_id, label, embedding).

    Vectors of equal label and length link at ``cosine`` or more, in double precision. Vectors that are null, empty, zero, or
    hold null or non-finite components, and rows without a label, link with nothing and are kept. Rows that share a vec_id
    are one vector; rows without one are left out. Equal vectors link with each other and share their links to others.
    An empty table gives no rows.
    """
    x = stage(usable(vectors), "vectors")
    same = ["label", "length", "h1", "h2"]  # vectors of equal hashes are one class
    x = x.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64("x", F.lit(1)))
    classes = stage(x.groupBy(*same).agg(F.min_by("x", "vec_id").alias("x"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("m")), "classes")
    leaves = forest(classes.select(F.col("first").alias("vec_id"), "m", "label", "length", "x"))
    code = F.col("tree").cast("long") * (1 << 60) + F.col("node")  # trees in order, then leaves
    homes = leaves.groupBy("vec_id").agg(F.array_sort(F.collect_list(code)).alias("homes"))
    placed = leaves.join(stage(homes, "homes"), "vec_id")
    sizes = stage(leaves.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "leaf_sizes")
    placed = placed.join(sizes, _NODE).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(*_NODE, code.alias("code"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "m", "homes", "x")

    def compare(rows: pa.Table) -> pa.Table:
        ids, many, block, m = np.asarray(rows.column("vec_id")), np.asarray(rows.column("m")), np.asarray(rows.column("block")), _matrix(rows.column("x"))
        lists = rows.column("homes").combine_chunks()
        n_homes = np.diff(np.asarray(lists.offsets))
        homes = np.full((len(ids), n_homes.max()), -1, np.int64)
        homes[np.arange(n_homes.max()) < n_homes[:, None]] = np.asarray(lists.flatten())
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        near = np.triu(m @ m.T >= cosine, 1)
        if i != j:  # only pairs across the two blocks; each block alone has a task of its own
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        mine = _first_shared(homes, a, b) == rows.column("code")[0].as_py()
        a, b = a[mine], b[mine]
        links = (np.bincount(a, many[b], len(ids)) + np.bincount(b, many[a], len(ids))).astype(np.int64)
        edges = _spanning(len(ids), a, b)
        n = links.nonzero()[0]
        return pa.table({
            "a": pa.array(np.concatenate([ids[n], ids[edges[:, 0]]])), "b": pa.array([None] * len(n) + ids[edges[:, 1]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([links[n], np.zeros(len(edges), np.int64)])),
        })

    found = stage(placed.groupBy(*_NODE, "code", "i", "j").applyInArrow(compare, "a long, b long, n long"), "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    component = connected_components(found.where("b is not null").select("a", "b")).toDF("first", "component")
    every = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    drop_staged(leaves)
    told = classes.select(*same, "first", "m").join(counts, "first", "left").join(component, "first", "left")
    told = told.select(*same, (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component"))
    out = every.join(x.select("vec_id", *same).join(told, same).select("vec_id", "n_links", "component"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A spanning forest of the links (a, b) among n rows: by rounds, each row takes the least row it is joined to."""
    label = np.arange(n)
    kept = []
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return np.array(kept, np.int64).reshape(-1, 2)
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        high, low = np.maximum(x, y), np.minimum(x, y)
        first = np.unique(high, return_index=True)[1]  # one link takes each high root below another: no circle
        kept.extend(zip(a[first].tolist(), b[first].tolist()))
        label[high[first]] = low[first]
        while (label[label] != label).any():
            label = label[label]


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
