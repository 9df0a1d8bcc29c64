"""SimHash near-duplicates by multi-index hashing.

Documents get a fingerprint of 64 bits or a multiple of it. Each fingerprint is cut into segments; a table holds every
(segment, value), small Hamming balls around each value are looked up in it, and complete distances decide. A bucket of
more than ``BUCKET`` fingerprints, or of few that a crowd looks up, is not expanded into pairs of rows: its members are
compared in bounded blocks inside tasks, which give a spanning forest of the same links. Long fingerprints meet by the
halves of their segments instead (see ``proposed``), so that neither the balls nor what chance brings together travels.

With a fixed ``max_bits`` that the segments' balls cover, links are exactly the pairs within that distance. With a
``similarity`` in its place the distance only proposes pairs: ``plan`` chooses segments of which the balls find a pair at
that similarity with RECALL or more, at every size of the table, every segment is looked up, and a pair links if the
Jaccard similarity of its shingles is ``similarity`` or more. Nothing is capped in either way.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, id_text, read, stage
from .components import connected_components

#: Fingerprints in one bucket beyond which it is compared in blocks, and the rows of a block. Chance puts four into a bucket on
#: average at most (see ``plan``), so that only groups of alike documents go beyond it, at every size of the table. A bucket of
#: fewer is compared in blocks too if it meets more lookups than a full one does by chance: else each of a crowd would meet it in rows.
BUCKET, BLOCK = 24, 1024
#: Rows of halves, and pairs of them, that a task takes up at once.
ROWS, PAIRS = 1 << 15, 1 << 17
#: The share of pairs at the border similarity that the lookup is to find.
RECALL = 0.97


def plan(n: int, similarity: float) -> tuple[int, int, int, int]:
    """(words of the fingerprint, bits of a segment, segments, bits that may differ) for n documents.

    A segment is as wide as keeps the chance matches of a value at four or fewer, 16 bits at least; their number follows
    from RECALL, since a ball of radius 1 in each finds a pair at the border with a known probability. All bits of the
    fingerprint are looked up. Three standard deviations above the mean distance at the border may differ."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = max(16, 4 * math.ceil((math.log2(max(n, 1)) - 2) / 4))
    found = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    words = math.ceil(bits * math.log(1 - RECALL) / math.log(1 - found) / 64)
    total = 64 * words
    return words, bits, total // bits, math.floor(total * p + 3 * math.sqrt(total * p * (1 - p)))


def _more_words(h: np.ndarray, n: int) -> np.ndarray:
    """n 64-bit hashes of each shingle: the hash itself, then splitmix64 steps from it."""
    out = [h]
    for i in range(1, n):
        z = h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def shingle_hashes(text: bytes, shingle_words: int, distinct: bool = False) -> np.ndarray:
    """Hashes of the text's shingles; a text of fewer words has itself as its one shingle, one of none has no shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(shingle_words)))) if len(tokens) >= shingle_words else [b" ".join(tokens)]
    if distinct:
        shingles = set(shingles)
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), shingles), np.uint64)


def fingerprint(text: bytes, shingle_words: int, words: int = 1, distinct: bool = False) -> np.ndarray:
    """``words`` 64-bit words; bit i is set if it is set in over half the hashes. No words: zero."""
    hashes = shingle_hashes(text, shingle_words, distinct)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 16384):  # bounds the memory that a very long text takes
        bits = _more_words(hashes[at : at + 16384], words).astype("<u8", copy=False)
        counts += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8").astype(np.int64)


def fingerprints(docs: DataFrame, shingle_words: int = 5, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp array<long>) for every row; nulls and empty texts have the fingerprint zero."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words, words, distinct) for t in as_bytes(batch.column("text"))], np.int64).reshape(-1)
            at = pa.array(np.arange(0, len(fps) + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(fps))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp array<long>")


def _carried(words: int) -> int:
    """Words of a fingerprint that go with each lookup: all of a short one, so that only close pairs become rows, or the first two."""
    return words if words <= 3 else 2


def _masks(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(bits), r)], np.int64)


def _probes(nodes: DataFrame, words: int, bits: int, segments: int, radius: int) -> DataFrame:
    """(key, node, sig, exact): sig is what ``_carried`` says of the fingerprint; for each segment the keys in the ball around its value. Of two values one bit apart, the
    one with the bit set finds the other, so for radius 1 the other way is left out."""
    masks, carried = _masks(bits, radius), _carried(words)

    def run(batches):
        for batch in batches:
            width = len(batch.column("fp").values) // max(1, batch.num_rows)
            fps = np.asarray(batch.column("fp").flatten()).reshape(-1, width) if batch.num_rows else np.zeros((0, 1), np.int64)
            ids = np.asarray(batch.column("node"))
            for s in range(segments):
                word, shift = divmod(s * bits, 64)
                value = (fps[:, word] >> shift) & ((1 << bits) - 1) if shift + bits <= 64 else ((fps[:, word] >> shift) & ((1 << (64 - shift)) - 1)) | ((fps[:, word + 1] & ((1 << (shift + bits - 64)) - 1)) << (64 - shift))
                for at in range(0, len(masks), 64):
                    m = masks[at : at + 64]
                    keep = ((value[:, None] & m) == m) if radius == 1 else np.ones((len(value), len(m)), bool)
                    row, col = np.nonzero(keep)
                    keys = (value[row] ^ m[col]) | (s << 40)
                    sig = [pa.array(fps[row, w]) for w in range(carried)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[row]), *sig, pa.array(m[col] == 0)], ["key", "node", *(f"sig{w}" for w in range(carried)), "exact"])

    return nodes.mapInArrow(run, "key long, node long, " + "".join(f"sig{w} long, " for w in range(carried)) + "exact boolean")


def _forest(rows: np.ndarray, ids: np.ndarray, left: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among rows that join a row of ``left`` to any other."""
    n = len(ids)
    near = np.zeros((n, n), bool)
    for i in np.nonzero(left)[0]:
        near[i] = np.bitwise_count((rows[i] ^ rows).view(np.uint64)).sum(axis=1, dtype=np.int32) <= limit
    near |= near.T
    edges, seen = [], np.zeros(n, bool)
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        front = [start]
        while front:
            i = front.pop()
            new = np.nonzero(near[i] & ~seen)[0]
            seen[new] = True
            edges.extend((int(ids[i]), int(ids[j])) for j in new)
            front.extend(new.tolist())
    return edges


def _close(pairs: DataFrame, nodes: DataFrame, max_bits: int) -> DataFrame:
    """The pairs (a, b) of which the whole fingerprints differ in ``max_bits`` or fewer."""
    fa, fb = nodes.select(F.col("node").alias("a"), F.col("fp").alias("fp_a")), nodes.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    apart = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(fa, "a").join(fb, "b").where(apart <= max_bits).select("a", "b").distinct()


def candidates(nodes: DataFrame, words: int, max_bits: int, segment_bits: int, segments: int, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, members): pairs (a, b) of nodes (node long, fp array<long> of ``words`` items) that differ in ``max_bits``
    or fewer and meet in a bucket of BUCKET fingerprints or fewer, not looked up by a crowd; and for the other buckets
    (None if there is none) their members (key, node): those in the bucket, and those that look it up."""
    probes = _probes(nodes, words, segment_bits, segments, radius)
    table = probes.where("exact")
    carried = [f"sig{w}" for w in range(_carried(words))]
    sizes = stage(table.groupBy("key").agg(F.count(F.lit(1)).alias("n_table")), "sizes")
    # Lookups of a bucket are told from the sizes of those around it; chance gives it four from each value there at most.
    masks = [int(m) for m in _masks(segment_bits, radius)[1:]]
    chance = 2 * segment_bits if radius == 1 else 4 * len(masks)
    around = F.filter(F.array(*map(F.lit, masks)), lambda m: F.col("key").bitwiseAND(m) == m) if radius == 1 else F.array(*map(F.lit, masks)).cast("array<long>")
    looked_up = sizes.select(F.explode(F.transform(around, lambda m: F.col("key").bitwiseXOR(m))).alias("key"), F.lit(0).cast("long").alias("n_table"), F.col("n_table").alias("n_lookups"))
    met = sizes.withColumn("n_lookups", F.lit(0).cast("long")).unionByName(looked_up).groupBy("key").agg(F.sum("n_table").alias("n_table"), F.sum("n_lookups").alias("n_lookups"))
    hot = stage(met.where((F.col("n_table") > BUCKET) | (F.col("n_table") * F.col("n_lookups") > BUCKET * chance)).select("key"), "hot")
    t = table.join(hot, "key", "left_anti").select("key", F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in carried))
    # What differs in the words carried along differs in the whole: more than max_bits there is more than max_bits.
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in carried), F.lit(0))
    # A pair that meets in several segments counts in the first of them: there its bucket gave the pair, or was compared in blocks.
    first = F.lit(True)
    for s in range(segments):
        word, shift = divmod(s * segment_bits, 64)
        if word < len(carried) and shift + segment_bits <= 64:
            differ = F.shiftright(F.col(carried[word]).bitwiseXOR(F.col(f"{carried[word]}_b")), shift).bitwiseAND(F.lit((1 << segment_bits) - 1))
            first &= ~((F.lit(s) < F.shiftright("key", 40)) & (F.bit_count(differ) <= radius))
    pairs = (
        probes.join(t, "key")
        .where((F.col("node") != F.col("b")) & (~F.col("exact") | (F.col("node") < F.col("b"))) & (apart <= max_bits) & first)
        .select(F.col("node").alias("a"), "b")
    )
    if words > len(carried):
        pairs = _close(pairs.distinct(), nodes, max_bits)
    if hot.isEmpty():
        return pairs, None
    return pairs, probes.join(hot, "key").select("key", "node").distinct()


def _value(s: int, bits: int) -> Column:
    """Segment s of a fingerprint."""
    word, shift = divmod(s * bits, 64)
    low = F.shiftrightunsigned(F.col("fp")[word], shift)
    if shift + bits > 64:
        low = low.bitwiseOR(F.shiftleft(F.col("fp")[word + 1], 64 - shift))
    return low.bitwiseAND(F.lit((1 << bits) - 1))


def _segments_within(x: np.ndarray, bits: int, segments: int) -> Iterator[np.ndarray]:
    """For each segment, whether the rows of x (fingerprints XORed) have one bit of it set at most."""
    for s in range(segments):
        word, shift = divmod(s * bits, 64)
        v = x[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | x[:, word + 1] << np.uint64(64 - shift)
        yield np.bitwise_count(v & np.uint64((1 << bits) - 1)) <= 1


def _bucket_pairs(code: np.ndarray, size: np.ndarray, masks: np.ndarray, exact: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of buckets (sorted code, size) that are one bit apart, and each bucket of ``exact`` with itself."""
    yield (np.flatnonzero(exact & (size > 1)),) * 2
    for m in masks:
        i = np.flatnonzero(code & m)
        at = np.minimum(np.searchsorted(code, code[i] ^ m), len(code) - 1)
        met = code[at] == code[i] ^ m
        yield i[met], at[met]


def _met(spot: np.ndarray, other: np.ndarray, fps: np.ndarray, bits: int, segments: int, max_bits: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by spot and other, whole spots) of one spot and others one bit apart at most, that differ in ``max_bits``
    or fewer: those whose first common segment this is. Buckets of more than ``most`` rows are left to be compared in blocks."""
    begin = np.flatnonzero(np.r_[len(spot) > 0, (spot[1:] != spot[:-1]) | (other[1:] != other[:-1])])
    size = np.diff(np.r_[begin, len(spot)])
    begin, size = begin[size <= most], size[size <= most]
    if not len(begin):
        return
    at, width = spot[begin], bits - bits // 2
    run = np.cumsum(np.r_[False, at[1:] != at[:-1]])
    # equal values share both halves: they count in the first of them
    for i, j in _bucket_pairs(run << width | other[begin], size, _masks(width, 1)[1:], at >> 41 << 41 == at >> 40 << 40):
        n = size[i] * size[j]
        ends = np.cumsum(n)
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(ends // PAIRS)) + 1):
            which = np.repeat(part, n[part])
            k = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            a, b = begin[i[which]] + k // size[j[which]], begin[j[which]] + k % size[j[which]]
            x = fps[a] ^ fps[b]
            near = (np.bitwise_count(x).sum(axis=1, dtype=np.int32) <= max_bits) & ((a < b) | (i[which] != j[which]))
            a, b, x = a[near], b[near], x[near]
            first = np.full(len(a), segments)
            for s, within in enumerate(_segments_within(x, bits, segments)):
                first = np.where(within & (first == segments), s, first)
            here = first == spot[a] >> 41
            yield a[here], b[here]


def proposed(nodes: DataFrame, words: int, max_bits: int, bits: int, segments: int) -> tuple[DataFrame, DataFrame | None]:
    """As ``candidates`` with radius 1, for fingerprints of any length: of values one bit apart one half is equal, so that a node goes,
    with its whole fingerprint, to the two halves of each segment and not to each value around it. Values meet inside tasks; only
    close pairs become rows. Members of a bucket of more than BUCKET nodes: those in it, and those one bit away (of two such
    buckets, one has the other's)."""
    width, most = bits - bits // 2, BUCKET
    values = F.posexplode(F.array(*(_value(s, bits) for s in range(segments)))).alias("_s", "_v")
    s, v, low = F.col("_s").cast("long"), F.col("_v"), F.lit((1 << width) - 1)
    table = nodes.select("node", values).select("node", F.shiftleft(s, 40).bitwiseOR(v).alias("key"))
    hot = stage(table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"), "hot")
    spot = lambda h, half, other: F.struct(F.shiftleft(2 * s + h, 40).bitwiseOR(half).alias("spot"), other.alias("other"))
    halves = F.array(spot(0, F.shiftright(v, width), v.bitwiseAND(low)), spot(1, v.bitwiseAND(low), F.shiftright(v, width)))
    rows = nodes.select("node", "fp", values).select("node", "fp", F.explode(halves).alias("_at")).select("_at.spot", "_at.other", "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = tuple(np.zeros(shape, np.int64) for shape in (0, 0, 0, (0, words)))
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                fps = np.asarray(batch.column("fp").flatten()).reshape(-1, words)
                kept = tuple(np.concatenate(p) for p in zip(kept, (*(np.asarray(batch.column(c)) for c in ("spot", "other", "node")), fps)))
                if len(kept[0]) < ROWS:
                    continue
            spot, other, node, fps = kept
            end = np.searchsorted(spot, spot[-1]) if batch is not None else len(spot)  # the last spot may go on
            for a, b in _met(spot[:end], other[:end], fps[:end].view(np.uint64), bits, segments, max_bits, most):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])
            # of a bucket that is too large no more rows are kept than tell that it is
            left = np.arange(end, len(spot))
            left = left[(left < end + most + 1) | (spot[left] != spot[left - most - 1]) | (other[left] != other[left - most - 1])]
            kept = spot[left], other[left], node[left], fps[left]

    pairs = rows.repartition("spot").sortWithinPartitions("spot", "other").mapInArrow(run, "a long, b long")
    if hot.isEmpty():
        return pairs, None
    around = hot.select("key", F.explode(F.array(*map(F.lit, _masks(bits, 1).tolist()))).alias("_m")).select("key", F.col("key").bitwiseXOR(F.col("_m")).alias("_from"), (F.col("key").bitwiseAND(F.col("_m")) != 0).alias("_set"))
    around = around.join(hot.select(F.col("key").alias("_from"), F.lit(True).alias("_hot")), "_from", "left").where(~F.col("_set") | F.col("_hot").isNull())
    return pairs, table.withColumnRenamed("key", "_from").join(around, "_from").select("key", "node")



def links(nodes: DataFrame, words: int, max_bits: int, segment_bits: int, segments: int, radius: int) -> DataFrame:
    """(a, b) links between different nodes (node long, fp array<long> of ``words`` items) whose fingerprints differ in ``max_bits`` or
    fewer and meet in some segment within ``radius``. For max_bits < segments * (radius + 1) that is every such pair; a
    crowded bucket gives a spanning forest of its links in place of all of them."""
    pairs, members = candidates(nodes, words, max_bits, segment_bits, segments, radius)
    if members is None:
        return pairs
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(stage(sizes, "blocks"), "key").join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets every block j >= i in a task of its own: a row goes to (min, max) of its block with each other one.
    meet = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meet = meet.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "fp")

    def compare(group: pa.Table) -> pa.Table:
        rows = np.asarray(group.column("fp").combine_chunks().flatten()).reshape(group.num_rows, -1)
        ids, block = np.asarray(group.column("node")), np.asarray(group.column("block"))
        edges = _forest(rows, ids, block == block.min(), max_bits)
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})

    return pairs.unionByName(meet.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())


def _sets(docs: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles): the sorted hashes of the distinct shingles of the documents that ``nodes`` names; ids that texts
    share have a row for each text."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle_words, True)).astype("<u8").tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = id_text(docs).join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("doc_id", "text")
    return stage(texts.mapInArrow(run, "node long, shingles binary"), "sets")


def _jaccard(x: bytes, y: bytes) -> float:
    both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
    return both / max(1, (len(x) + len(y)) // 8 - both)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the shingle sets have the similarity. An ``a`` of many pairs is spread over parts of
    BLOCK pairs, so that no task meets them all."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    left = parts.join(sets.withColumnRenamed("node", "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select("a", "part", F.col("shingles").alias("x"))
    right = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = right.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                keep = [_jaccard(x, y) >= similarity - 1e-9 for x, y in zip(some.column("x").to_pylist(), some.column("y").to_pylist())]
                yield some.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return right.join(left, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, shingle_words: int, similarity: float, words: int, segment_bits: int, segments: int, max_bits: int) -> DataFrame:
    """(a, b): verified links that connect what the proposed pairs of Jaccard ``similarity`` or more connect.

    First every node is verified against one partner: its least, and the least member of its largest crowded bucket.
    What hangs together then needs no more pairs inside: only pairs between different groups are verified next, those of
    large buckets in blocks inside tasks, where blocks of a bucket's largest group do not meet each other."""
    pairs, members = proposed(nodes, words, max_bits, segment_bits, segments)
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    if members is not None:
        members = stage(members, "members")
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"))
        chosen = members.join(sizes, "key").groupBy(F.col("node").alias("b")).agg(F.max_by("a", F.struct("n", "key")).alias("a"))
        one = one.unionByName(_close(chosen.where("a <> b").select("a", "b"), nodes, max_bits)).distinct()
    one = stage(one, "one_partner")
    sets = _sets(docs, pairs.unionByName(one).select(F.explode(F.array("a", "b")).alias("node")), shingle_words)
    found = stage(_alike(one, sets, similarity), "verified")
    group = stage(connected_components(found), "groups")
    group_of = lambda df, c: df.join(group.toDF(c, f"{c}_group"), c, "left").withColumn(f"{c}_group", F.coalesce(f"{c}_group", c))
    rest = stage(group_of(group_of(pairs, "a"), "b").where("a_group <> b_group").select("a", "b"), "rest")
    found = found.unionByName(_alike(rest, sets, similarity))
    if members is None:
        return found
    placed = group_of(members, "node").join(nodes, "node")
    kinds = placed.groupBy("key", "node_group").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("key").agg(F.max_by("node_group", F.struct("n", "node_group")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")).where("n > n_main")
    kinds = stage(kinds.select("key", "main", F.ceil(F.col("n_main") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("n_main")) / BLOCK).cast("int").alias("others")), "kinds")
    of = F.when(F.col("node_group") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others")))
    meet = placed.join(kinds, "key").withColumn("block", of.cast("int"))
    meet = meet.withColumn("other", F.explode(F.sequence(F.when(F.col("block") < F.col("mains"), F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    meet = meet.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "node_group", "fp")

    def close(group: pa.Table) -> np.ndarray:
        """Pairs of rows of the group that may link: close, of different groups, and across the two blocks if there are two."""
        rows = np.asarray(group.column("fp").combine_chunks().flatten()).reshape(group.num_rows, -1).view(np.uint64)
        block, of = np.asarray(group.column("block")), np.asarray(group.column("node_group"))
        alone, out = block.min() == block.max(), []
        for i in np.flatnonzero(block == block.min()):
            near = (np.bitwise_count(rows[i] ^ rows).sum(axis=1, dtype=np.int32) <= max_bits) & (of != of[i])
            near &= (np.arange(len(rows)) > i) if alone else block != block[i]
            out += [(i, j) for j in np.flatnonzero(near)]
        return np.array(out, np.int64).reshape(-1, 2)

    def partnered(group: pa.Table) -> pa.Table:
        return group.take(pa.array(np.unique(close(group))))

    def verify(group: pa.Table) -> pa.Table:
        sets, ids = group.column("shingles").to_pylist(), group.column("node").to_pylist()
        parent = {g: g for g in group.column("node_group").to_pylist()}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        of, out = group.column("node_group").to_pylist(), []
        for i, j in close(group).tolist():
            if (x := root(of[i])) != (y := root(of[j])) and _jaccard(sets[i], sets[j]) >= similarity - 1e-9:
                parent[x] = y
                out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    shape = "key long, i int, j int, block int, node long, node_group long, fp array<long>"
    open_rows = stage(meet.groupBy("key", "i", "j").applyInArrow(partnered, shape), "open")
    if open_rows.isEmpty():
        return found
    more = open_rows.join(_sets(docs, open_rows.select("node"), shingle_words), "node")
    return found.unionByName(more.groupBy("key", "i", "j").applyInArrow(verify, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, max_bits: int | None = None, distinct: bool = True, layout: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text).

    With ``max_bits`` fingerprints of 64 bits link at that distance, all of them. Else documents link whose shingle sets
    have a Jaccard similarity of ``similarity`` or more: pairs below it never do, of those at it RECALL or more do, and
    the more of those above it; documents of one fingerprint, as long as ``plan`` says, count as alike. Null or empty
    texts: fingerprint zero, linked with each other. Rows of equal text link; a row whose doc_id is null gets the
    component of its fingerprint, null if only such rows have it. Repeated rows stay as rows of one component; texts that
    share a doc_id are one node. An empty table gives no rows.

    Which pairs at the border are found hangs on ``layout`` (see ``plan``); by default it follows the number of documents, so
    give it where tables of different sizes are to agree: ``plan(n, similarity)`` for the largest serves all smaller ones.
    """
    words, bits, segments, limit = (layout or plan(docs.count(), similarity)) if max_bits is None else (1, 32, 2, max_bits)
    fps = stage(fingerprints(docs, shingle_words, words, distinct), "fingerprints")
    classes = stage(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    if max_bits is None:
        found = similar_links(docs, classes, shingle_words, similarity, words, bits, segments, limit)
    else:
        found = links(classes, words, limit, bits, segments, limit // segments)
    component = connected_components(found)
    labels = stage(classes.join(component, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "labels")
    return fps.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: shingles of three words, repeats included; fingerprints link at two differing bits or fewer."""
    out = near_duplicates(read(spark, sf_dir, "documents"), shingle_words=3, max_bits=2, distinct=False)
    return out.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")
