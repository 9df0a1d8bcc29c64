"""Files in Hilbert order: the curve itself, and how little of a table a small box reads."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from solterra.functions.geo import hilbert_key
from solterra.sources import files


def test_the_curve_visits_each_cell_once_and_steps_to_a_neighbour(spark):
    cells = spark.range(256).select((F.col("id") % 16 + 0.5).alias("x"), (F.floor(F.col("id") / 16) + 0.5).alias("y"))
    at = {r.h: (r.x, r.y) for r in cells.select("x", "y", hilbert_key(F.col("x"), F.col("y"), 0, 0, 16, 16, bits=4).alias("h")).collect()}
    assert sorted(at) == list(range(256))
    assert all(abs(at[k][0] - at[k + 1][0]) + abs(at[k][1] - at[k + 1][1]) == 1 for k in range(255))
    odd = spark.createDataFrame([(None, 1.0), (-5.0, 99.0), (16.0, 16.0)], "x double, y double").select(hilbert_key(F.col("x"), F.col("y"), 0, 0, 16, 16, bits=4).alias("h")).collect()
    assert odd[0].h is None and all(0 <= r.h < 256 for r in odd[1:])


def test_a_small_box_reads_few_row_groups_and_all_its_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, x := rng.randrange(100_000), x + rng.randrange(60), y := rng.randrange(100_000), y + rng.randrange(60), "x" * 80) for i in range(60_000)] + [(-1, None, None, None, None, "")]
    df = spark.createDataFrame(rows, "building_id long, x0 long, x1 long, y0 long, y1 long, note string")
    path = str(tmp_path / "curve")
    files.write_hilbert(df.repartition(4), path, 8, row_group_bytes=1 << 14)
    box = (42_000, 61_000, 52_000, 71_000)  # a hundredth of the area
    groups = [m.row_group(k) for m in map(pq.read_metadata, glob.glob(f"{path}/*.parquet")) for k in range(m.num_row_groups)]
    column = {groups[0].column(k).path_in_schema: k for k in range(groups[0].num_columns)}

    def touched(group):
        stats = {c: group.column(column[c]).statistics for c in ("x0", "x1", "y0", "y1")}
        if not all(s and s.has_min_max for s in stats.values()):
            return True
        return stats["x0"].min <= box[2] and stats["x1"].max >= box[0] and stats["y0"].min <= box[3] and stats["y1"].max >= box[1]

    assert len(groups) > 100 and sum(map(touched, groups)) < 0.05 * len(groups)
    got = sorted(r.building_id for r in files.boxed_parquet(spark, path, *box).collect())
    assert got == sorted(r[0] for r in rows if r[1] is not None and r[1] <= box[2] and r[2] >= box[0] and r[3] <= box[3] and r[4] >= box[1])
    assert "LessThanOrEqual(x0,52000)" in files.boxed_parquet(spark, path, *box)._jdf.queryExecution().executedPlan().toString()
    old = str(tmp_path / "old")
    df.limit(5).drop("x0", "x1", "y0", "y1").write.parquet(old)
    assert files.boxed_partitions(spark, [path, old, path], *box).count() == len(got) + 5
    assert files.boxed_partitions(spark, [], *box, "building_id long").count() == 0
    files.write_hilbert(df.limit(0), str(tmp_path / "none"), 2)
    assert files.boxed_partitions(spark, [str(tmp_path / "none")], *box, df.schema).count() == 0


def test_repaired_lines_keep_quoted_commas(spark):
    lines = ['a,"x,y",c', '"say ""no"", twice",b,c,d,e', "a", 'a,"open,b', "", "   "]
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "file string, line_no long, text string")
    got = {r.line_no: r.fields for r in files.repaired(rows, 3, 2).collect()}
    assert got == {0: ["a", '"x,y"', "c"], 1: ['"say ""no"", twice"', "b c d", "e"], 2: ["a", "", ""], 3: ["a", '"open', "b"]}


def test_empty_tables_leave_files_that_can_be_read(spark, tmp_path):
    none = spark.createDataFrame([], "k long, v long")
    assert files.write_partitions(none, "k", str(tmp_path / "parts")).count() == 0
    assert files.monthly(spark, f"{tmp_path}/%Y%m", ["2024-01"], schema="a long").count() == 0
    chunks = spark.createDataFrame([], "chunk long, task_id long")
    assert files.write_chunks(chunks, lambda todo: todo, str(tmp_path / "chunks")) == []
    assert files.parquet_at(spark, [str(tmp_path / "chunks/rows")], chunks.schema).count() == 0
