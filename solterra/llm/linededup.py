"""Cross-site boilerplate lines, by the spread of each line over sites.

A HyperLogLog sketch of sites is kept for each line hash and merged by aggregation, so a line crosses the shuffle once a
task however often and on however many sites it stands. Lines whose estimate lies near the threshold get an exact count of
distinct sites. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage

MIN_SITES = 5
#: log2 of a sketch's registers, and the share around the threshold within which counts are taken exactly: over four
#: standard errors of such a sketch.
LOG_REGISTERS, NEAR = 12, 0.15
#: The share of a text's characters in lines of its own from which its other lines can be boilerplate rather than copied with it.
OWN = 0.2


def _line_key(line):
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"))


def _trimmed(line):
    return F.trim(line, F.lit(" \t\r"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2): keys of the lines, trimmed, that stand on ``min_sites`` sites or more. Blank lines have no key; rows
    without a site, or without a text, add nothing."""
    lines = docs.where(F.col(site_col).isNotNull()).select(F.col(site_col).alias("site"), F.explode(F.split(text_col, "\n")).alias("line"))
    lines = lines.select("site", _trimmed(F.col("line")).alias("line")).where("line <> ''").select("site", _line_key(F.col("line")).alias("key"))
    spread = lines.groupBy("key.h1", "key.h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(LOG_REGISTERS))).alias("sites"))
    spread = stage(spread.where(F.col("sites") >= (1 - NEAR) * min_sites), "spread")
    sure = spread.where(F.col("sites") > (1 + NEAR) * min_sites).select("h1", "h2")
    near = spread.where(F.col("sites") <= (1 + NEAR) * min_sites).select("h1", "h2")
    exact = lines.select("site", "key.h1", "key.h2").join(near, ["h1", "h2"], "left_semi").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2"))


def boilerplate_of_texts(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2) as ``boilerplate``, without the spread that copies of one document give: rows of equal text count on one
    site, and only texts count of which lines that stand on fewer sites make up OWN of the characters or more. Near copies
    share nearly all their lines, so that they are no evidence for them; nor are texts of nothing but boilerplate."""
    texts = [F.xxhash64(text_col).alias("t1"), F.xxhash64(F.col(text_col), F.lit(1)).alias("t2")]
    rows = docs.where(F.col(site_col).isNotNull() & F.col(text_col).isNotNull()).select(*texts, F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))
    copies = rows.groupBy("t1", "t2").agg(F.min_by("site", F.xxhash64("site", "t1")).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(stage(copies, "copies"), ["t1", "t2"], "left").select("t1", "t2", "text", F.coalesce("one", "site").alias("site"))
    hot = stage(boilerplate(rows, min_sites, "text", "site"), "hot")
    parts = F.transform(F.split("text", "\n"), _trimmed)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda n, line: n + F.length(line))
    rows = rows.select("t1", "t2", "site", total.alias("total"), parts.alias("parts"))  # once a text, before its lines part
    lines = rows.select("t1", "t2", "site", "total", F.posexplode("parts").alias("at", "line")).where("line <> ''")
    lines = lines.select("t1", "t2", "site", "total", "at", F.length("line").alias("n"), _line_key(F.col("line")).alias("key"))
    lines = stage(lines.select("t1", "t2", "site", "total", "at", "n", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2")).join(hot, ["h1", "h2"]).distinct(), "hot_lines")
    own = lines.groupBy("t1", "t2").agg(F.sum("n").alias("hot"), F.first("total").alias("total")).where(F.col("hot") <= (1 - OWN) * F.col("total"))
    spread = lines.join(own.select("t1", "t2"), ["t1", "t2"], "left_semi").select("site", "h1", "h2").distinct()
    return spread.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")


def _without(text, places):
    """The text without its lines at ``places`` (ascending, from 0): the stretches between them, each sliced once."""
    starts, ends = F.concat(F.array(F.lit(-1)), places), lambda n: F.concat(places, F.array(n))
    kept = lambda parts: F.flatten(F.zip_with(starts, ends(F.size(parts)), lambda a, b: F.slice(parts, a + 2, b - a - 1)))
    return F.array_join(F.transform(F.array(F.split(text, "\n")), kept)[0], "\n")  # the array of one makes split run once


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", keep_copies: bool = False, counts: bool = True, keep_last: bool = False) -> DataFrame:
    """docs with boilerplate lines cut from the text, all its columns, and with ``counts`` n_lines, n_removed (long), which
    take the place of columns of these names.

    Lines are parted by line feeds and compared without blanks, tabs and carriage returns around them; blank lines stay.
    A null text stays null with no lines; a text of which all lines go is empty. Rows are told apart by (id, hash of the
    text), a null id being one too: rows that share both lose the same lines. An empty table gives no rows. With
    ``keep_copies`` lines go by ``boilerplate_of_texts``; with ``keep_last`` a text that would be left without a word stays as it is.
    """
    gone = stage((boilerplate_of_texts if keep_copies else boilerplate)(docs, min_sites, text_col, site_col), "boilerplate")
    # All columns of docs travel as one, so that none can clash.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("body"))
    lines = rows.select("id", "hash", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    lines = lines.select("id", "hash", "at", _trimmed(F.col("line")).alias("line")).where("line <> ''").select("id", "hash", "at", _line_key(F.col("line")).alias("key"))
    lines = lines.select("id", "hash", "at", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"))
    places = lines.join(gone, ["h1", "h2"]).groupBy("id", "hash").agg(F.array_sort(F.collect_set("at")).alias("places"))
    places = places.select(F.col("id").alias("of"), F.col("hash").alias("of_hash"), "places")
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    left = _without(F.col("body"), F.col("places"))
    if keep_last:
        left = F.transform(F.array(left), lambda t: F.when(t.rlike(r"\S"), t).otherwise(F.col("body")))[0]  # worked out once
    text = F.when(F.col("places").isNull(), F.col("body")).otherwise(left)
    out = [(text if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    if counts:
        n = F.when(F.col("body").isNull(), 0).otherwise(F.size(F.split("body", "\n")))
        out += [n.cast("long").alias("n_lines"), F.coalesce(F.when(F.col("places").isNotNull(), F.size("places")), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
lines AS (SELECT r, source, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT r, source, string_split(text, chr(10)) AS parts FROM d WHERE text IS NOT NULL)),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
gone AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT keyed.*, gone.k IS NOT NULL AS dropped FROM keyed LEFT JOIN gone USING (k)),
texts AS (SELECT r, count(*) AS n_lines, count(*) FILTER (dropped) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS text FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, texts.text
FROM d LEFT JOIN texts USING (r)
"""
