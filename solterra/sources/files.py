"""Files in and out: CSV folders, manifests, catalogs, features, map exports, weather cubes; Parquet and CSV sinks with
manifests, a folder a user, and chunks that a broken run takes up again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import rest
from ..functions import text
from ..functions.geo import hilbert_key
from ..operators.shapes import CATALOG, catalog

#: Names under which columns of a trace come (fixed names of the file format), the first that is there counts.
TRACE_NAMES = {
    "id": ["id", "trace_id", "traceid", "user_id"], "time": ["time", "timestamp", "ts", "datetime"],
    "lng": ["lng", "lon", "longitude", "x"], "lat": ["lat", "latitude", "y"], "speed_kmh": ["speed_kmh", "speed", "speedkmh"],
}


def csv_rows(spark: SparkSession, *paths: str) -> DataFrame:
    """All CSV files below the paths, by header, every value as text, with file (its path). Blank rows go, missing values of short
    rows are empty text. Files may differ in columns only if they are read apart."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mode", "PERMISSIVE").csv(list(paths))
    names = rows.columns
    blank = F.lit(True)
    for c in names:
        blank = blank & (F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) == "")
    return rows.withColumn("file", F.col("_metadata.file_path")).where(~blank).select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names), "file")


def csv_typed(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """CSV files by header with the schema, or with types told from all their values: that reads them twice."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", 1.0)).csv(paths)


def manifest(spark: SparkSession, path: str, root: str, skip_missing: bool = False) -> list[str]:
    """Files that a list names below ``root``: a line each, blank ones and those that begin with # apart, in order, each once. A
    path that leaves the root is an error; a missing file too, unless it is to be skipped. The list comes to the driver: it
    names files, not rows."""
    lines = [r.value.strip() for r in spark.read.text(path).select("value").toLocalIterator()]
    names = list(dict.fromkeys(n for n in lines if n and not n.startswith("#")))
    base = root.rstrip("/")
    out = []
    for name in names:
        parts = name.removeprefix(f"{base}/").split("/")
        if ".." in parts or parts[0] == "" or ":" in parts[0]:
            raise ValueError(f"{name} lies outside {root}")
        full = "/".join([base, *(p for p in parts if p != ".")])
        target = spark._jvm.org.apache.hadoop.fs.Path(full)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            out.append(full)
        elif not skip_missing:
            raise FileNotFoundError(full)
    return out


def json_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rectangles (see ``shapes.catalog``)."""
    return catalog(spark.read.schema(CATALOG).option("multiLine", True).json(path))


def parquet_at(spark: SparkSession, paths: list[str], schema=None, base: str | None = None) -> DataFrame:
    """Parquet files at the paths; none at all is an empty table of the schema, or an error without one."""
    if not paths:
        if schema is None:
            raise FileNotFoundError("no file to read, and no schema of an empty table")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def partition_files(spark: SparkSession, manifest_csv: str, partitions: DataFrame | None = None, schema=None) -> DataFrame:
    """Rows of the Parquet files that a partition manifest (partition_id, path, more) names, of the wanted partitions alone where
    ``partitions`` (partition_id) is given: only their files are opened. Several rows may name one file. No file is an error, unless ``schema`` says what an empty table holds."""
    listed = spark.read.option("header", True).csv(manifest_csv)
    if partitions is not None:
        listed = listed.join(partitions.select("partition_id").distinct(), "partition_id", "left_semi")
    paths = [r.path for r in listed.select("path").distinct().orderBy("path").toLocalIterator()]  # names of files
    return parquet_at(spark, paths, schema)


def boxed_parquet(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows with bounds x0, x1, y0, y1 that touch the box; the four comparisons reach the files' statistics."""
    return spark.read.parquet(path).where((F.col("x0") <= east) & (F.col("x1") >= west) & (F.col("y0") <= north) & (F.col("y1") >= south))


def trace_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a trace file (text columns under any of TRACE_NAMES, source_row): id, timestamp (seconds), lng, lat,
    speed_kmh; and source_row with why: ``id``, ``time``, ``position``. Times are numbers (milliseconds above 10^12) or ISO
    text; positions must be on the globe; an unknown speed is null. A file without a column for one of the four is an error."""
    lower = {c.lower(): c for c in rows.columns}
    named = {k: next((lower[n] for n in v if n in lower), None) for k, v in TRACE_NAMES.items()}
    if missing := [k for k in ("id", "time", "lng", "lat") if not named[k]]:
        raise ValueError(f"no column for {missing}")
    of = lambda k: F.col(f"`{named[k]}`").cast("string")
    speed = text.number(of("speed_kmh")) if named["speed_kmh"] else F.lit(None).cast("double")
    lng, lat = text.number(of("lng")), text.number(of("lat"))
    out = rows.select("source_row", F.trim(of("id")).alias("id"), text.parse_epoch(of("time")).alias("timestamp"), lng.alias("lng"), lat.alias("lat"), speed.alias("speed_kmh"))
    on_globe = F.coalesce(F.col("lng").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    why = F.when(F.coalesce("id", F.lit("")) == "", "id").when(F.col("timestamp").isNull(), "time").when(~on_globe, "position")
    judged = out.withColumn("why", why)
    return judged.where("why is null").drop("why"), judged.where("why is not null").select("source_row", "why")


def ways_to_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, ring): closed rings of ways (way_id, nodes array<long>) over nodes (node_id, lon, lat). A way of which fewer than
    three vertices are known and on the globe gives none; others leave out the vertices they lack."""
    order = ways.select("way_id", F.posexplode("nodes").alias("k", "node_id"))
    there = nodes.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).dropDuplicates(["node_id"])
    listed = order.join(there, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("v"))
    from ..functions.geo import close_ring

    ring = F.transform("v", lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))
    open_ = listed.select("way_id", ring.alias("ring"))
    last, first = F.element_at("ring", -1), F.element_at("ring", 1)
    corners = F.size("ring") - F.when((F.size("ring") > 1) & (last.x == first.x) & (last.y == first.y), 1).otherwise(0)
    return open_.where(corners >= 3).select("way_id", close_ring(F.col("ring")).alias("ring"))


def monthly(spark: SparkSession, template: str, months: list[str], fallback: str | None = None, schema=None) -> DataFrame:
    """Parquet of the months (yyyy-MM) whose files a template with %Y and %m names, only those that there are; of ``fallback`` where
    there is none of them, else nothing where the schema is given."""
    conf = spark._jsc.hadoopConfiguration()
    exists = lambda p: (lambda h: h.getFileSystem(conf).exists(h))(spark._jvm.org.apache.hadoop.fs.Path(p))
    named = [template.replace("%Y", m[:4]).replace("%m", m[5:7]) for m in months]
    there = [p for p in dict.fromkeys(named) if exists(p)] or ([fallback] if fallback else [])
    return parquet_at(spark, there, schema)


def merged_cube(cubes: dict[str, DataFrame]) -> DataFrame:
    """One table (timestamp, lat, lon, a column a variable) of tables (timestamp, lat, lon, value) of the same grid. A key that one of
    them lacks is an error: the row fails the job when it is read. Keys must not repeat within a table."""
    keys, out = ["timestamp", "lat", "lon"], None
    for name, cube in cubes.items():
        one = cube.select(*keys, F.struct(F.col("value")).alias(name))
        out = one if out is None else out.join(one, keys, "full")
    whole = F.lit(True)
    for name in cubes:
        whole = whole & F.col(name).isNotNull()
    stop = F.raise_error(F.lit("the variables' grids differ"))
    return out.select(*keys, *(F.when(whole, F.col(name).value).otherwise(stop.cast("double")).alias(name) for name in cubes))


def plain(df: DataFrame) -> DataFrame:
    """df with floating numbers as text: whole ones without a point, null and NaN as null, text without line breaks."""

    def cell(field):
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("double", "float"):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            return F.when(c.isNull() | F.isnan(c), None).when(whole, c.cast("long").cast("string")).otherwise(c.cast("string")).alias(field.name)
        return (F.translate(c, "\r\n", "  ") if kind == "string" else c).alias(field.name)

    return df.select(*map(cell, df.schema.fields))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_hilbert(df: DataFrame, path: str, files: int, by: str | None = None, row_group_bytes: int = 1 << 20) -> None:
    """Rows with bounds x0, x1, y0, y1 as Parquet in the order of a Hilbert curve over their middles: dealt out by range of the curve and
    sorted by it, so that a file and a row group hold one patch of ground, and their statistics tell a reader of a box to
    leave out the others. With ``by`` each of its values is a folder below ``path``. Rows without bounds come first."""
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    at = df.withColumns({"_x": middle("x0", "x1"), "_y": middle("y0", "y1")})
    box = at.agg(*(f(c) for c in ("_x", "_y") for f in (F.min, F.max))).first()  # four numbers
    west, east, south, north = (0.0 if v is None else float(v) for v in box)
    placed = at.withColumn("_h", hilbert_key(F.col("_x"), F.col("_y"), west, south, east, north)).drop("_x", "_y")
    order = [*([by] if by else []), "_h"]
    writer = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_h").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    (writer.partitionBy(by) if by else writer).parquet(path)


def boxed_partitions(spark: SparkSession, paths: list[str], west: float, south: float, east: float, north: float, schema=None) -> DataFrame:
    """Rows of several stored partitions that touch the box (see ``boxed_parquet``), as one table. A partition without the columns of
    bounds can't be left out in part: it is read whole, its rows with null bounds."""
    out = None
    for path in dict.fromkeys(paths):
        rows = parquet_at(spark, [path], schema)
        if {"x0", "x1", "y0", "y1"} <= set(rows.columns):
            rows = rows.where((F.col("x0") <= east) & (F.col("x1") >= west) & (F.col("y0") <= north) & (F.col("y1") >= south))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return parquet_at(spark, [], schema) if out is None else out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, numbers as ``plain`` writes them; the folder is whole once it holds _SUCCESS."""
    plain(df).write.mode("overwrite").option("header", True).csv(path)


def replace_csv(df: DataFrame, path: str) -> None:
    """As ``write_csv``, but the rows stand beside ``path`` until they are whole, and one rename then puts them in its place: a reader finds
    the old table or the new one, and a run that breaks off leaves the old one."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write_csv(df, beside)
        store.delete(at(path), True)
        if not store.rename(at(beside), at(path)):
            raise OSError(f"{path} could not be replaced")
    finally:
        store.delete(at(beside), True)


def write_partitions(df: DataFrame, by: str, path: str) -> DataFrame:
    """Files below ``path``/by=value, and their manifest: (by, rows, bytes, files). Each task sorts its rows by ``by`` and a busy value is
    spread over tasks by the writer's input, so that no value must fit one task."""
    df.sortWithinPartitions(by).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)
    written = parquet_at(df.sparkSession, [path], df.schema, path)  # an empty table has no file to tell its columns
    per = written.groupBy(by, F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    return per.groupBy(by).agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))


def write_user_files(df: DataFrame, id_col: str, path: str) -> None:
    """A folder a user below the first two characters of the id; null and empty ids go to the writer's folder of nulls. A user's rows
    meet before they are written, so that files are as many as users, not as users by tasks; those of a large user may be split."""
    rows = df.withColumn("prefix", F.substring(F.col(id_col).cast("string"), 1, 2)).withColumn("user", F.col(id_col).cast("string"))
    plain(rows).hint("rebalance", "user").sortWithinPartitions("prefix", "user").write.mode("overwrite").option("header", True).partitionBy("prefix", "user").csv(path)


def write_chunks(chunks: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, id_col: str = "task_id") -> list[int]:
    """What ``work`` makes of the chunks (chunk, id, more) that aren't done: a chunk is done when ``path``/done lists it with the
    digest of its ids. Its rows overwrite their own folder below ``path``/rows, so that a run that broke off is taken up without
    double rows; without any chunk an empty ``rows`` is left, to be read by the schema of what ``work`` makes. Returns the
    chunks worked on: the work itself is found by a join, their numbers alone come to the driver."""
    spark = chunks.sparkSession
    digest = text.ids_digest(F.array_sort(F.collect_list(F.col(id_col).cast("string"))))
    now = chunks.groupBy("chunk").agg(digest.alias("digest"))
    exists = lambda p: (lambda h: h.getFileSystem(spark._jsc.hadoopConfiguration()).exists(h))(spark._jvm.org.apache.hadoop.fs.Path(p))
    if exists(f"{path}/done"):
        now = now.join(parquet_at(spark, [f"{path}/done"], now.schema), ["chunk", "digest"], "left_anti")
    todo = rest(now)
    numbers = sorted(r.chunk for r in todo.select("chunk").toLocalIterator())
    if not numbers and exists(f"{path}/rows"):
        return []
    made = work(chunks.join(todo.select("chunk"), "chunk", "left_semi"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/rows")
    todo.write.mode("append").parquet(f"{path}/done")
    return numbers


def width_of(line: Column) -> Column:
    """Fields of a CSV line: commas outside of double quotes, and one."""
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of text files: numbers follow the lines' order in their file. The window is one file's."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_k"), F.col("value").alias("text"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("_k"))).select("file", "line_no", "text")


def repaired(lines: DataFrame, width: int, overflow_at: int) -> DataFrame:
    """(file, line_no, fields): lines as ``width`` fields each. Where there are too many, those from ``overflow_at`` on that
    exceed are joined by spaces in that field; where there are too few, empty ones follow. Blank lines go. Commas within double
    quotes part nothing, and fields keep their quotes; a quote that nothing closes is a sign like any other."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), "text"), F.lit(r',((?:"[^"]*+"|[^,"]++|")*+)'), F.lit(1))
    out = lines.where(F.trim("text") != "").withColumn("_p", parts)
    extra = F.size("_p") - width
    joined = F.concat(F.slice("_p", 1, overflow_at - 1), F.array(F.array_join(F.slice("_p", overflow_at, extra + 1), " ")), F.slice("_p", F.lit(overflow_at + 1) + extra, F.lit(width - overflow_at)))
    padded = F.concat("_p", F.array_repeat(F.lit(""), F.greatest(F.lit(0), -extra)))
    return out.select("file", "line_no", F.when(extra > 0, joined).otherwise(padded).alias("fields"))
