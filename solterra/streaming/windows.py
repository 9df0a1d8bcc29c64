"""Minutes, sessions and late rows on streams; each operator takes a batch table as well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def minute_counts(rows: DataFrame, by: list[str], late: str = "10 minutes") -> DataFrame:
    """(by, minute start, n, total): rows (ts timestamp, value) by minute; state of a minute goes ``late`` after it. Rows without ts
    go; rows later than that are dropped by a stream, never by a batch."""
    window = F.window("ts", "1 minute")
    return rows.withWatermark("ts", late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(*by, F.col("window.start").alias("minute"), "n", "total")


def sessions(rows: DataFrame, by: str, max_gap: int = 600, late: str | None = "1 hour") -> DataFrame:
    """(by, start, last, n) of runs of rows (ts timestamp) no more than ``max_gap`` seconds apart: the session window ends a
    microsecond beyond the gap, so that a gap of just ``max_gap`` still joins. Times are those of the rows. A stream drops rows ``late`` or more after the latest one
    read, in any output mode; with None nothing is late and no session leaves the state, for a stream in complete mode, which keeps
    them all anyhow: then files may come in any order. Rows without ts go."""
    window = F.session_window("ts", f"{max_gap} seconds 1 microsecond")
    rows = rows.where("ts is not null") if late is None else rows.withWatermark("ts", late)
    grouped = rows.groupBy(window, by).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return grouped.select(by, "start", "last", "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run what there is of the stream into Parquet at ``path``: each batch overwrites its own folder and, in complete mode, the
    last one is the answer, so that a batch that is run again after a failure leaves no double rows."""

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def merge_late(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = versions.BUCKETS) -> StreamingQuery:
    """Rows of the stream replace those of the versioned table at ``path`` with the same keys (see ``merge_batch``): an older row never
    replaces a newer, and a batch that is run again after a failure, or a restart from ``checkpoint``, changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        versions.merge_batch(batch, path, keys, order, number, buckets)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
