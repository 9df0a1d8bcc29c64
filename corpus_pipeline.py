"""A corpus pipeline in five stages: toxicity, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. Empty tables pass through every stage; rows with a null text stay until the last, which gives them no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solterra.llm import bpe, decontaminate, linededup, simhash, toxicity
from solterra.llm.common import read, stage


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as its text now is."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on five sources or more, over different documents and not copies of one, go from the texts; every
    document stays, and one of nothing but such lines stays as it is, for the next stage to compare."""
    return _counted(linededup.drop_boilerplate(docs, keep_copies=True, counts=False, keep_last=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.8 or more over shingles of five words, the one with the smallest
    doc_id stays; rows without a doc_id or without words stay, rows of one doc_id stay or go together."""
    groups = simhash.near_duplicates(docs.where(F.col("text").rlike(r"\S")), shingle_words=5, similarity=0.8)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items, ten words or more, are cut; documents that are mostly such passages, or items of
    fewer words, go."""
    return _counted(decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), cut_short=False))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document left."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: Learned scores, fingerprints and BPE merges are beyond SQL; the stages are tested in tests/llm: near-dedup by bands of similarity, decontamination and BPE against brute force, toxicity by held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
