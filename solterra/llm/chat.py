"""Chat formatting: reply trees to formatted conversations. Built-in functions only.

Paths are found by self-joins that double: table k holds each message's ancestor 2^k steps up. Branches are ranked by the
sum of scores from root to leaf, which doubles along with the steps; only then are the chosen paths enumerated, each step
once, so no path is expanded that is not formatted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stage


@dataclass(frozen=True)
class Template:
    """Control strings of a turn: ``opening role middle text closing``. All begin with ``mark``; inside texts and roles a
    backslash is doubled and ``mark`` gets a backslash after its first character, so no control string remains."""

    mark: str = "<|"
    opening: str = "<|start|>"
    middle: str = "<|text|>"
    closing: str = "<|end|>"
    answers: str = "assistant"

    def escape(self, text):
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(self.mark), F.lit(self.mark[0] + "\\" + self.mark[1:]))

    def unescape(self, text):
        return F.regexp_replace(text, r"\\([\\" + self.mark[1] + "])", "$1")


def linear(turns: DataFrame) -> DataFrame:
    """A reply tree from rows (conv_id, turn, role, text): each turn replies to the one before. Turns that tie are in
    order of role and text and each counts; a null turn comes first; rows without a conv_id are left out."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.where("conv_id is not null").select("conv_id", F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, node, up, depth, total) with up null once the root is passed, and the jump tables (conv_id, node, up) of
    1, 2, 4 ... steps. Messages of a cycle never end: they keep an ``up`` after as many doublings as there are messages."""
    known = nodes.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("known"))
    step = nodes.join(known, ["conv_id", "parent"], "left").select(
        "conv_id", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")
    )
    current, jumps = stage(step, "climb0"), []
    facts = current.agg(F.count("up").alias("open"), F.count(F.lit(1)).alias("n")).first()
    while facts["open"] and 1 << len(jumps) <= facts["n"]:
        still = current.where("up is not null")
        jumps.append(still.select("conv_id", "node", "up"))
        above = current.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        more = still.join(above, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"))
        more = more.unionByName(current.where("up is null"))
        current = stage(more, f"climb{len(jumps)}")
        facts = current.agg(F.count("up").alias("open"), F.lit(facts["n"]).alias("n")).first()
    return current, jumps


def paths(tree: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, place, role, text): root-to-leaf paths of reply trees (conv_id, node, parent, role, text, score).

    Branches rank by the sum of their scores, best first, then by leaf; ``branches`` keeps the first so many of each
    conversation, all by default. A parent that is null or missing makes a root; several roots give several trees of one
    conversation; messages of a cycle, or below one, are left out. Null scores count 0. (conv_id, node) must be unique.
    """
    nodes = stage(tree.select("conv_id", "node", "parent", "role", "text", "score"), "nodes")
    climbed, jumps = _climb(nodes)
    parents = nodes.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = climbed.where("up is null").join(parents, ["conv_id", "node"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    steps = ranked.select("conv_id", F.col("node").alias("leaf"), "rank", "node")
    for jump in reversed(jumps):  # each ancestor is reached once: its distance is one sum of powers of two
        wider = steps.join(jump, ["conv_id", "node"], "left")
        steps = wider.select("conv_id", "leaf", "rank", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    depth = climbed.select("conv_id", "node", F.col("depth").alias("place"))
    words = nodes.select("conv_id", "node", "role", "text")
    return steps.join(depth, ["conv_id", "node"]).join(words, ["conv_id", "node"]).select("conv_id", "leaf", "rank", "place", "role", "text")


def format_paths(chosen: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss): one conversation a path. ``loss`` lists spans (start, length) in code
    points of ``formatted`` that hold the answers' texts. Null roles and texts are empty."""
    t = template
    role, text = t.escape(F.coalesce("role", F.lit(""))), t.escape(F.coalesce("text", F.lit("")))
    turn = F.concat(F.lit(t.opening), role, F.lit(t.middle), text, F.lit(t.closing))
    before = Window.partitionBy("conv_id", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    parts = chosen.select("conv_id", "leaf", "rank", "place", turn.alias("turn"), F.length(text).cast("long").alias("n"), (F.col("role") == t.answers).alias("answers"))
    parts = parts.withColumn("end", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("turn"))
    start = F.col("end") - len(t.closing) - F.col("n")
    parts = parts.select("conv_id", "leaf", "rank", "place", "turn", F.when(F.col("answers"), F.struct(start.alias("start"), F.col("n").alias("length"))).alias("span"))
    whole = parts.groupBy("conv_id", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "span"))).alias("all"))
    return whole.select(
        "conv_id", "leaf", "rank", F.array_join(F.transform("all", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def parse(formatted, template: Template = Template()):
    """The turns of a formatted text: array<struct<role, text>>, unescaped."""
    t = template
    turns = F.filter(F.split(formatted, "\\Q" + t.opening + "\\E"), lambda x: x != "")

    def one(turn):
        whole = F.substring(turn, F.lit(1), F.length(turn) - len(t.closing))
        at = F.instr(whole, t.middle)
        return F.struct(
            t.unescape(F.substring(whole, F.lit(1), at - 1)).alias("role"),
            t.unescape(F.substring(whole, at + len(t.middle), F.length(whole))).alias("text"),
        )

    return F.transform(turns, one)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from what was formatted."""
    template = Template()
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).unionByName(extra)
    out = format_paths(paths(linear(turns)), template).withColumn("turns", parse(F.col("formatted"), template))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda x: template.unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, x["length"].cast("int")))), "")
    out = out.withColumn("loss_text", loss)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe, replace(replace(role, '\', '\\'), '<|', '<\|') AS safe_role FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|start|>' || safe_role || '<|text|>' || safe || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
