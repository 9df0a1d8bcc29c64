"""Resharding by minimum-cost flow.

What old shards hold beyond their new capacity flows to shards with room; a byte that stays costs nothing, a byte that
moves costs one, so the cheapest flow moves the surplus and no more. The flow is solved over shards, whose number is
bounded. Rows of equal text stay together: large texts, a bounded number, are placed one by one, each at home where there is
room; blocks of the others, by the hash of the text, fill the transfers of the flow, the smallest blocks first to move. Only a
text that no shard has room for is spread, by the ids of its rows. Only the files of shards that give or receive are written anew.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, shared_dir, stage

#: Blocks of an old shard (64 for each new shard at least), parts of a text that is spread, and the share of the least shard from
#: which a text is placed by itself.
BLOCKS, SPREAD, LARGE = 4096, 256, 1 / 16


def transfers(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """{(from, to): bytes} of a cheapest flow, staying bytes included. By shortest augmenting paths: old shards send what
    they hold, new ones take what they may, the arc of a shard to itself costs 0 and any other 1."""
    n, m = len(sizes), len(capacities)
    left, room, flow = list(sizes), list(capacities), {}
    for cost in (0, 1):  # augmenting paths by cost: all of cost 0 first; after them no path of cost 1 turns one back
        for i in range(n):
            for j in range(m):
                if (i == j) == (cost == 0):
                    move = min(left[i], room[j])
                    if move:
                        flow[i, j] = flow.get((i, j), 0) + move
                        left[i] -= move
                        room[j] -= move
    if any(left):
        raise ValueError("the new capacities are too small")
    return flow


def _shares(total: int, weights: list[float]) -> list[int]:
    edges = [round(total * sum(weights[:k]) / sum(weights)) for k in range(len(weights) + 1)]
    return [b - a for a, b in zip(edges, edges[1:])]


def _placed(texts: list[tuple[int, int, int]], sizes: list[int], room: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """([(old, text, shard)], [(old, text)]) of the large texts (old, text, bytes): at home if there is room, else where
    there is most, and those that fit nowhere. What they take goes off sizes and room."""
    fixed, spread = [], []
    for old, text, n in sorted(texts, key=lambda t: (-t[2], t[0], t[1])):
        to = old if old < len(room) and room[old] >= n else max(range(len(room)), key=room.__getitem__)
        if room[to] < n:
            spread.append((old, text))
            continue
        fixed.append((old, text, to))
        sizes[old] -= n
        room[to] -= n
    return fixed, spread


def plan(docs: DataFrame, shards: int, old_shard: str = "old_shard", size: str = "size", block_key: str = "text_crc32", weights: list[float] | None = None) -> DataFrame:
    """docs with a column ``shard``: rows (doc_id, old shard, size, block key, more) placed by the cheapest flow; a column of
    that name is replaced.

    ``weights`` are the relative capacities of the new shards, equal by default. Null and negative sizes count as 0; old
    shards are numbered from 0, rows without one are new and go where there is room; shards beyond the new number are
    emptied. Rows of one block key and old shard share a shard unless none has room for them. Other columns can have
    any names. An empty table stays empty.
    """
    spark, count = docs.sparkSession, max(BLOCKS, 64 * shards)
    parts = F.pmod(F.xxhash64(F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)), F.lit(SPREAD)).cast("int")
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.coalesce(F.col(old_shard).cast("int"), F.lit(-1)).alias("old"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("bytes"),
        F.pmod(F.xxhash64(block_key), F.lit(count)).cast("int").alias("block"), F.xxhash64(block_key).alias("text"), parts.alias("part"),
    )
    out = lambda df: df.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns if c != "shard"), F.col("to").cast("int").alias("shard"))
    texts = stage(rows.groupBy("old", "block", "text").agg(F.sum("bytes").alias("bytes")), "texts")
    held = {r["old"]: r["bytes"] for r in texts.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}  # a row a shard
    if not held:
        return out(rows.withColumn("to", F.lit(None)))
    new = max(max(held) + 1, shards)  # the number by which rows without an old shard go
    sizes = [held.get(i, 0) for i in range(new)] + [held.get(-1, 0)]
    room = _shares(sum(sizes), weights or [1.0] * shards)
    texts, rows = (df.withColumn("old", F.when(F.col("old") < 0, new).otherwise(F.col("old"))) for df in (texts, rows))
    least = max(1.0, LARGE * min(c for c in room if c)) if any(room) else math.inf
    # At most sum(sizes) / least rows, 16 for each shard of equal capacities.
    fixed, spread = _placed([(r["old"], r["text"], r["bytes"]) for r in texts.where(F.col("bytes") >= least).select("old", "text", "bytes").collect()], sizes, room)
    flow = transfers(sizes, room)
    alone = spark.createDataFrame([(o, t, to) for o, t, to in fixed] + [(o, t, None) for o, t in spread], "old int, text long, at int")
    blocks = texts.join(F.broadcast(alone.select("old", "text")), ["old", "text"], "left_anti").groupBy("old", "block").agg(F.sum("bytes").alias("bytes"))
    pieces = rows.join(F.broadcast(alone.where("at is null").select("old", "text")), ["old", "text"]).groupBy("old", "text", "part").agg(F.sum("bytes").alias("bytes"))
    units = blocks.unionByName(pieces, allowMissingColumns=True)
    # Large units first: they stay, and the small ones at the end move.
    upto = F.sum("bytes").over(Window.partitionBy("old").orderBy(F.desc("bytes"), "block", "text", "part").rowsBetween(Window.unboundedPreceding, 0))
    units = units.withColumn("middle", upto - F.col("bytes") / 2)
    cut = [(i, j, float(sum(v for (a, b), v in flow.items() if a == i and _order(a, b) < _order(i, j))), float(v)) for (i, j), v in flow.items()]
    arcs = spark.createDataFrame(cut, "source int, to int, begin double, length double")  # a row a transfer
    inside = (F.col("old") == F.col("source")) & (F.col("middle") >= F.col("begin")) & (F.col("middle") < F.col("begin") + F.col("length"))
    stay = F.when(F.col("old") < shards, F.col("old")).otherwise(F.pmod("old", F.lit(shards)))  # of units without bytes
    place = stage(units.join(F.broadcast(arcs), inside, "left").select("old", "block", "text", "part", F.coalesce("to", stay).alias("to")), "place")
    # Large texts are few and known; the places of blocks are as many as blocks, and are sent to the tasks or not by their size.
    rows = rows.join(F.broadcast(alone.withColumn("alone", F.lit(True))), ["old", "text"], "left")
    whole = rows.where("alone is null").join(place.where("text is null").select("old", "block", "to"), ["old", "block"])
    at_once = rows.where("at is not null").withColumn("to", F.col("at"))
    torn = rows.where("alone and at is null").join(place.where("text is not null").select("old", "text", "part", "to"), ["old", "text", "part"])
    return out(whole).unionByName(out(at_once)).unionByName(out(torn))


def _order(i: int, j: int) -> tuple[int, int]:
    return (0 if i == j else 1, j)


def with_slots(placed: DataFrame) -> DataFrame:
    """placed (doc_id, text_crc32, shard, more) with ``slot``: 0, 1, 2 ... within each shard without gaps. Numbers run within parts of a
    shard, by hash of the id; each part starts where the parts before it end."""
    rows = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int"))
    counts = stage(rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n")), "counts")
    before = counts.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32")).cast("long") - 1
    numbered = rows.withColumn("_own", own)
    joined = numbered.join(before, (numbered["shard"] == before["_s"]) & (numbered["_part"] == before["_p"]))
    return joined.select(*(numbered[c] for c in placed.columns), (F.col("_own") + F.col("_before")).alias("slot"))


def rewrite(placed: DataFrame, out: str, old_shard: str = "old_shard") -> list[int]:
    """Write the shards that the plan changes to ``out``/shard=k: the rows of placed (old shard, shard, more) that stand in them
    now, whatever their ids. Returns the shards written or emptied; the files of others stay as they are."""
    moves = placed.where(F.col(old_shard) != F.col("shard")).select(F.explode(F.array(old_shard, "shard")).alias("shard")).distinct()
    changed = sorted(r["shard"] for r in moves.collect())  # at most a row a shard
    placed.where(F.col("shard").isin(changed)).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(out)
    return changed


def op5_reshard(spark: SparkSession, sf_dir: str, old: int = 6, shards: int = 8) -> DataFrame:
    """Every document, from ``old`` shards by the hash of the text to eight of near equal bytes: the old shards are laid out as
    files, those that the plan changes are written anew with their texts, and the rows are read from the files of both."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    top = f"{shared_dir(spark)}/solterra/{uuid.uuid4().hex}"
    laid = docs.withColumn("old_shard", F.pmod(crc, F.lit(old)).cast("int"))
    laid.write.option("compression", "zstd").partitionBy("old_shard").parquet(f"{top}/old")
    before = spark.read.schema(laid.schema).parquet(f"{top}/old")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    placed = plan(before.select("doc_id", "text", size, crc.alias("text_crc32"), "old_shard"), shards)
    changed = rewrite(placed.select("doc_id", "text", "old_shard", "shard"), f"{top}/new")
    columns = ["doc_id", "text", "old_shard", "shard"]
    new = spark.read.schema(placed.select(columns).schema).parquet(f"{top}/new").select(columns)
    same = before.where(~F.col("old_shard").isin(changed)).withColumn("shard", F.col("old_shard")).select(columns)
    rows = stage(new.unionByName(same).select("doc_id", size, crc.alias("text_crc32"), "shard", "old_shard"), "membership")
    out = with_slots(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
