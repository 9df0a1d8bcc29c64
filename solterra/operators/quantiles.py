"""Exact quantiles by radix selection: values are counted by sixteen bits at a time, and only what holds the rank is carried on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import rest


def _bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; -0.0 is 0.0."""
    raw = (values + 0.0).view(np.int64)
    return np.where(raw >= 0, raw, raw ^ np.int64(0x7FFFFFFFFFFFFFFF))


def _values(bits: np.ndarray) -> np.ndarray:
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64)


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, a column for each rank): values of each group, as doubles, at ranks that columns give from the group's number n of
    values (from 0, whole numbers). Nulls and NaN are no values; groups without any don't come; a null of ``by`` is a group.

    Four passes over the values count them by group and by the next sixteen bits of their doubles, in the order of the
    numbers, among those that share the bits found so far: a task and a pass hold 65,536 counts a group and rank at most, never
    a group's values."""
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    v = F.col(value).cast("double")
    there = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, group.alias("_g"), v.alias("_v"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_g"), pa.array(_bits(np.asarray(batch.column("_v"))))], ["_g", "_b"])

    held = rest(there.select("_g", "_v").mapInArrow(run, "_g string, _b long"))
    groups = rest(there.groupBy("_g", *by).agg(F.count(F.lit(1)).alias("n")))
    asked = F.explode(F.array(*(F.struct(F.lit(k).alias("tag"), r.cast("long").alias("k")) for k, r in ranks.items())))
    wanted = rest(groups.select("_g", asked.alias("t")).select("_g", "t.tag", "t.k", F.lit(0).cast("long").alias("_p")))
    for shift in (48, 32, 16, 0):
        digits = held.select("_g", F.shiftright("_b", shift).alias("_d"))
        digits = digits.withColumn("_p", F.lit(0).cast("long") if shift == 48 else F.shiftright("_d", 16))
        if shift < 48:
            digits = digits.join(wanted.select("_g", "_p").distinct(), ["_g", "_p"], "left_semi")
        counts = digits.groupBy("_g", "_p", "_d").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy("_g", "tag").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        found = wanted.join(counts, ["_g", "_p"]).withColumn("upto", upto).where(F.col("upto") > F.col("k"))
        found = found.groupBy("_g", "tag").agg(F.min(F.struct("_d", (F.col("k") - F.col("upto") + F.col("c")).alias("k"))).alias("f"))
        wanted = rest(found.select("_g", "tag", "f.k", F.col("f._d").alias("_p")))

    def back(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("tag"), pa.array(_values(np.asarray(batch.column("_p"))))], ["_g", "tag", "v"])

    told = wanted.select("_g", "tag", "_p").mapInArrow(back, "_g string, tag string, v double")
    wide = told.groupBy("_g").agg(*(F.max(F.when(F.col("tag") == k, F.col("v"))).alias(k) for k in ranks))
    return groups.join(wide, "_g").drop("_g")


def medians(rows: DataFrame, values: list[str]) -> DataFrame:
    """(value, median) of each of the columns that holds a value: the middle one, or the mean of the two in the middle."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("value"), F.col(c).cast("double").alias("v")) for c in values))).alias("x")).select("x.*")
    both = at_ranks(long, ["value"], "v", {"low": F.floor((F.col("n") - 1) / 2), "high": F.ceil((F.col("n") - 1) / 2)})
    return both.select("value", ((F.col("low") + F.col("high")) / 2).alias("median"))
