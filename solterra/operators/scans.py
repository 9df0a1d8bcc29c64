"""Ranks, running sums and greedy cuts over tables of any length: range partitions with offsets, no window over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..checkpoints import rest

#: Rows of a block of ranks that one task folds.
BLOCK = 1 << 16


def ranked(rows: DataFrame, order: list, sums: list[str] | None = None) -> DataFrame:
    """rows with rank (from 0) in the given order, and for each of ``sums`` (whole numbers, null: 0) its sum over the rows before, as
    <name>_before. Rows are dealt out by range and sorted there; each partition counts its own, and what comes before it,
    a row for each partition, is added. Rows that the order doesn't tell apart come in any order: give one that does."""
    sums = sums or []
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = StructType([*ordered.schema.fields, StructField("_part", IntegerType()), StructField("rank", LongType()), *(StructField(f"{c}_before", LongType()) for c in sums)])
    names = schema.names

    def run(batches):
        part, at, so_far = TaskContext.get().partitionId(), 0, np.zeros(len(sums), np.int64)
        for batch in batches:
            n = batch.num_rows
            values = [np.nan_to_num(np.asarray(batch.column(c).cast(pa.float64()))).astype(np.int64) if batch.column(c).null_count else np.asarray(batch.column(c)).astype(np.int64) for c in sums]
            before = [np.cumsum(v) - v + s for v, s in zip(values, so_far)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *map(pa.array, before)], names)
            at, so_far = at + n, so_far + np.array([v.sum() for v in values], np.int64)

    held = rest(ordered.mapInArrow(run, schema))
    own = held.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in sums)).orderBy("_part").collect()  # a row for each partition
    offsets, total = [], [0] * (1 + len(sums))
    for row in own:
        offsets.append((row["_part"], *total))
        total = [a + row[c] for a, c in zip(total, ["n", *sums])]
    shape = "_part int, _o long" + "".join(f", _o{k} long" for k in range(len(sums)))
    moved = held.join(F.broadcast(held.sparkSession.createDataFrame(offsets, shape)), "_part")
    return moved.select(*rows.columns, (F.col("rank") + F.col("_o")).alias("rank"), *((F.col(f"{c}_before") + F.col(f"_o{k}")).alias(f"{c}_before") for k, c in enumerate(sums)))


def _next(rank: np.ndarray, first: np.ndarray, before: np.ndarray, upto: np.ndarray, most_rows: int, most: int) -> np.ndarray:
    """For each row of consecutive ranks the place of the first row that the chunk begun there doesn't take."""
    n = np.arange(len(rank))
    out = np.minimum(n + most_rows, len(rank))
    if most > 0:
        out = np.minimum(out, np.searchsorted(upto, before + most, "right"))
    starts = np.append(np.flatnonzero(first), len(rank))
    return np.minimum(np.maximum(out, n + 1), starts[np.searchsorted(starts, n, "right")])


def greedy_chunks(tasks: DataFrame, order: list[str], max_rows: int, max_sum: int, value: str, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """tasks with chunk: taken in order, a new chunk begins where one more row would pass ``max_rows`` or, with ``max_sum`` above 0,
    the sum of ``value`` (null or below 0: 0) would pass that; a row of more stands alone. Chunks are numbered from 0
    within ``by``. The same as a fold over all rows, however they are dealt out.

    From the running sums each row knows where a chunk begun there would end. A block of ranks tells for each of its first
    ``max_rows`` rows, one of which begins a chunk, where the first chunk beyond the block begins and how many chunks lie
    between. These jumps are joined with themselves, doubling, until the first row's way through all blocks is known;
    then each block folds from its own beginning."""
    by, most_rows = by or [], max(1, max_rows)
    block = max(block, most_rows)
    weighed = tasks.withColumn("_v", F.greatest(F.coalesce(F.col(value), F.lit(0)), F.lit(0)).cast("long"))
    rows = ranked(weighed, [*by, *order], ["_v"])
    if by:
        begun = rows.groupBy(*(F.col(c).alias(f"_k{c}") for c in by)).agg(F.min("rank").alias("_first"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k{c}"))
        rows = rows.join(begun, same).drop(*(f"_k{c}" for c in by))
    else:
        rows = rows.withColumn("_first", F.lit(0).cast("long"))
    rows = rest(rows.withColumn("_block", F.floor(F.col("rank") / block)))
    narrow = rows.select("_block", "rank", (F.col("rank") == F.col("_first")).alias("first"), "_v_before", (F.col("_v_before") + F.col("_v")).alias("upto"))
    ahead = narrow.where((F.col("_block") > 0) & (F.col("rank") % block <= most_rows)).withColumn("_block", F.col("_block") - 1)
    both = narrow.unionByName(ahead)

    def table(group: pa.Table):
        order_ = np.argsort(np.asarray(group.column("rank")), kind="stable")
        rank, first, before, upto = (np.asarray(group.column(c))[order_] for c in ("rank", "first", "_v_before", "upto"))
        return rank, np.minimum(_next(rank, first, before, upto, most_rows, max_sum), len(rank)), int(np.searchsorted(rank, (group.column("_block")[0].as_py() + 1) * block))

    def jumps(group: pa.Table) -> pa.Table:
        rank, after, own = table(group)
        end, count = np.arange(len(rank) + 1), np.zeros(len(rank) + 1, np.int64)
        for k in range(own - 1, -1, -1):
            end[k], count[k] = end[after[k]], count[after[k]] + 1
        entries = np.arange(min(most_rows, own))
        to = np.append(rank, rank[-1] + 1)[end[entries]]
        return pa.table({"a": rank[entries], "b": to, "n": count[entries]})

    step = rest(both.groupBy("_block").applyInArrow(jumps, "a long, b long, n long"))
    spark = tasks.sparkSession
    reached = spark.createDataFrame([(0, 0)], "a long, chunk long")
    blocks = step.select(F.max(F.floor(F.col("a") / block))).first()[0] or 0
    for _ in range(int(blocks).bit_length()):  # the way so far, and once more as far from each of its places
        more = reached.join(step, "a").select(F.col("b").alias("a"), (F.col("chunk") + F.col("n")).alias("chunk"))
        reached = rest(reached.unionByName(more).distinct())
        two = step.toDF("b", "c", "m")
        step = rest(step.join(two, "b").select("a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n")))
    entry = reached.select(F.floor(F.col("a") / block).alias("_block"), F.col("a"), "chunk").groupBy("_block").agg(F.min(F.struct("a", "chunk")).alias("entry"))

    def fold(group: pa.Table) -> pa.Table:
        """The chunks that begin in the block, with those of their rows that lie beyond it."""
        rank, after, own = table(group)
        start, chunk = group.column("entry")[0].as_py().values()
        first = at = int(np.searchsorted(rank, start))
        out = np.zeros(len(rank), np.int64)
        while at < own:
            out[at : after[at]] = chunk
            at, chunk = after[at], chunk + 1
        return pa.table({"rank": rank[first:at], "chunk": out[first:at]})

    folded = both.join(entry, "_block").groupBy("_block").applyInArrow(fold, "rank long, chunk long")
    out = rows.join(folded, "rank")
    if by:
        least = folded.join(rows.where("rank = _first").select("rank"), "rank").select(F.col("rank").alias("_first"), F.col("chunk").alias("_least"))
        out = out.join(least, "_first").withColumn("chunk", F.col("chunk") - F.col("_least"))
    return out.select(*tasks.columns, "chunk")
