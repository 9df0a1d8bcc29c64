"""Toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of words, one of toxic and one of ordinary text. Their highest order, ORDER bytes, is counted by
class: the documents of the class that hold a word count for each of its n-grams. All lower orders are shared: Kneser-Ney
continuation counts, the number of different n-grams of the whole corpus that end in a shorter one. So a rare or new word
that neither class knows moves the score little. A text's evidence is the difference of its two log-likelihoods divided by
its number of words, and the same of its distinct words divided by the root of their number; a logistic curve over the
two, fitted on a fold that the counts leave out, gives the score.

Words travel with chunk tables (see ``chunks``): a word meets its counts once for a chunk, all documents are counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import answered, chunk_table, pack, packs_of, unpack, unpack_words
from .common import read, stage
from .decontaminate import words_of

#: Of FOLDS folds by crc32 of the id: 0 is never learned from, 1 fits the curve, the others are counted, with what of 1 the curve leaves.
FOLDS = 5
#: Rows that fit the curve at most (those of the smallest hashes of their ids).
CURVE_ROWS = 20_000
ORDER, DISCOUNT = 5, 0.75


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def _bag(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, code, uses) of each distinct word of each document of a chunk."""
    lengths = np.array(row["lengths"], np.int64)
    steps, uses = unpack(row["codes"], "<u4")[0].astype(np.int64), unpack(row["uses"], "<u4")[0].astype(np.int64)
    total, starts = np.concatenate(([0], np.cumsum(steps))), np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return doc, total[1:] - total[starts][doc], uses


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, number of the word of each): ORDER bytes as an integer, over the word with its start and end marked."""
    pad = b"\x02" * (ORDER - 1)
    flat = np.frombuffer(pad + (b"\x03" + pad).join(words) + b"\x03", np.uint8).astype(np.int64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(n)
    at = np.arange(ends[-1]) + np.repeat(np.arange(len(words)) * (ORDER - 1), n)
    grams = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        grams = grams << 8 | flat[at + k]
    return grams, np.repeat(np.arange(len(words)), n)


def _tallies(table: DataFrame, known: DataFrame) -> DataFrame:
    """(part, word, toxic, ordinary) of every word of the corpus: toxic and ordinary documents of ``known`` that hold it."""
    ids = table.select("chunk", F.posexplode("doc_ids").alias("pos", "doc_id"))
    marks = ids.join(known, "doc_id").groupBy("chunk").agg(F.collect_list(F.struct("pos", "toxic")).alias("marks"))
    marked = table.join(marks, "chunk", "left").select("chunk", "lengths", "sizes", "codes", "uses", "packs", "marks")

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc, code, _ = _bag(row)
                kind = np.full(len(row["lengths"]), -1, np.int8)
                for mark in row["marks"] or []:
                    kind[mark["pos"]] = mark["toxic"]
                n, of = sum(row["sizes"]), kind[doc]
                toxic, ordinary = (np.bincount(code[of == k], minlength=n).astype("<u4") for k in (1, 0))
                ends = np.cumsum(row["sizes"]).tolist()
                at = [(p, a, b) for p, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in at], pa.int32()), pa.array([row["packs"][p] for p, _, _ in at], pa.binary()), pa.array([pack(toxic[a:b], ordinary[a:b]) for _, a, b in at], pa.binary())],
                    ["part", "words", "counts"],
                )

    def add(rows: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        sums = np.zeros((1024, 2), np.int64)
        for words, counts in zip(rows.column("words").to_pylist(), rows.column("counts").to_pylist()):
            at = np.array([place.setdefault(w, len(place)) for w in unpack_words(words)], np.int64)
            if len(place) > len(sums):
                sums = np.concatenate([sums, np.zeros((max(len(sums), len(place) - len(sums)), 2), np.int64)])
            sums[at] += np.stack(unpack(counts, "<u4", "<u4"), axis=1)  # a pack holds a word once
        part = np.full(len(place), rows.column("part")[0].as_py(), np.int32)
        return pa.table({"part": part, "word": pa.array(list(place), pa.binary()), "toxic": sums[: len(place), 0], "ordinary": sums[: len(place), 1]})

    counted = marked.mapInArrow(count, "part int, words binary, counts binary")
    return counted.groupBy("part").applyInArrow(add, "part int, word binary, toxic long, ordinary long")


def gram_evidence(tallies: DataFrame) -> DataFrame:
    """(gram, value) for the n-grams of the corpus that a class holds, or that follow a context that a class holds: the
    difference of the class models' log-probabilities of the last byte. For any other it is zero."""

    def explode(batches):
        for batch in batches:
            if batch.num_rows:
                grams, of = grams_of(batch.column("word").to_pylist())
                known, at = np.unique(grams, return_inverse=True)
                sums = [np.bincount(at, np.asarray(batch.column(c))[of], len(known)).astype(np.int64) for c in ("toxic", "ordinary")]
                yield pa.RecordBatch.from_arrays([pa.array(known), *map(pa.array, sums)], ["gram", "toxic", "ordinary"])

    grams = stage(tallies.mapInArrow(explode, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")
    types = [grams.select("gram")]  # of ORDER bytes, then ever fewer: what ends in a shorter one counts for it
    for k in range(ORDER - 1, 0, -1):
        cut = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        types.append(types[-1].groupBy(cut.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    shared = types[-1].select("gram", ((F.col("n") + 1) / (F.lit(grams.select(F.col("gram").bitwiseAND(F.lit(0xFFFF))).distinct().count()) + 256)).alias("p"))
    for k in range(2, ORDER):
        level = types[ORDER - k].withColumn("context", F.shiftright("gram", 8)).withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        after = level.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total")
        shared = stage(level.join(after, "context").join(shared.withColumnRenamed("gram", "shorter"), "shorter").select("gram", p.alias("p")), f"shared{k}")
    contexts = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(*(f(c).alias(f"{c}_{n}") for c in ("toxic", "ordinary") for n, f in (("n", F.sum), ("kinds", lambda x: F.count_if(F.col(x) > 0)))))
    contexts = stage(contexts.where("toxic_n + ordinary_n > 0"), "contexts")

    def left(c):  # the share of probability that a class leaves to the shared orders in a context
        return F.when(F.col(f"{c}_n") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_n")).otherwise(1.0)

    def p(c):
        return F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0) + left(c) * F.col("p")

    seen = grams.where("toxic + ordinary > 0").withColumn("context", F.shiftright("gram", 8)).withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * (ORDER - 1)) - 1)))
    seen = seen.join(contexts, "context").join(shared.withColumnRenamed("gram", "shorter"), "shorter")
    others = grams.where("toxic + ordinary = 0").select("gram", F.shiftright("gram", 8).alias("context")).join(contexts, "context")
    return seen.select("gram", F.log(p("toxic") / p("ordinary")).alias("value")).unionByName(others.select("gram", F.log(left("toxic") / left("ordinary")).alias("value")))


def _evidence(table: DataFrame, tallies: DataFrame) -> DataFrame:
    """(doc_id, by_word, by_kind) of every document. The words of a part meet the values of just their own n-grams."""

    def explode(batches):
        for batch in batches:
            part = np.asarray(batch.column("part"))
            for k in np.unique(part):
                grams = np.unique(grams_of(batch.filter(pa.array(part == k)).column("word").to_pylist())[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), k, np.int32)), pa.array(grams)], ["part", "gram"])

    values = tallies.select("part", "word").mapInArrow(explode, "part int, gram long").distinct().join(gram_evidence(tallies), "gram")

    def rate(packs: pa.Table, values: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        packed = [[known.setdefault(w, len(known)) for w in unpack_words(blob)] for blob in packs.column("words").to_pylist()]
        value = np.zeros(len(known), "<f4")
        if known and values.num_rows:
            grams, of = grams_of(list(known))
            keys, worth = np.asarray(values.column("gram")), np.asarray(values.column("value"))
            order = np.argsort(keys)
            keys, worth = keys[order], worth[order]
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            value = np.bincount(of, np.where(keys[at] == grams, worth[at], 0.0), len(known)).astype("<f4")
        out = [pack(value[np.array(words, np.int64)]) for words in packed]
        return pa.table({"chunk": packs.column("chunk"), "part": packs.column("part").cast(pa.int32()), "answer": pa.array(out, pa.binary())})

    rated = packs_of(table).groupBy("part").cogroup(values.groupBy("part")).applyInArrow(rate, "chunk long, part int, answer binary")

    def sum_up(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc, code, uses = _bag(row)
                value = np.concatenate([unpack(a["answer"], "<f4")[0] for a in row["answers"]]).astype(float)[code] if row["answers"] else np.zeros(0)
                n = len(row["lengths"])
                by_word = np.bincount(doc, uses * value, n) / np.maximum(np.bincount(doc, uses, n), 1)
                by_kind = np.bincount(doc, value, n) / np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(by_word), pa.array(by_kind)], ["doc_id", "by_word", "by_kind"])

    return answered(table, rated).mapInArrow(sum_up, "doc_id long, by_word double, by_kind double")


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(weights of the columns of x, offset) of the logistic curve by Newton steps, lightly regularised."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-12
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 0.05), 1e-9)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return np.append(w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum())


def _scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """``score`` of docs, and whether a curve could be fitted."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    table = chunk_table(docs, words_of, bags=True)
    present = known.where(fold(F.col("doc_id")) == 1).join(table.select(F.explode("doc_ids").alias("doc_id")), "doc_id", "left_semi")
    sample = stage(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS), "curve")
    counted = known.where(fold(F.col("doc_id")) > 0).join(sample.select("doc_id"), "doc_id", "left_anti").select("doc_id", "toxic")
    evidence = stage(_evidence(table, stage(_tallies(table, counted), "tallies")), "evidence")
    fit = evidence.join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.avg("by_word").alias("by_word"), F.avg("by_kind").alias("by_kind"))
    rows = fit.select("by_word", "by_kind", "toxic").toPandas()
    fitted = rows["toxic"].nunique() == 2
    if fitted:
        a, b, offset = _curve(rows[["by_word", "by_kind"]].to_numpy(), rows["toxic"].to_numpy()).tolist()
        value = 1 / (1 + F.exp(-(F.lit(a) * F.col("by_word") + F.lit(b) * F.col("by_kind") + F.lit(offset))))
    else:
        value = F.lit(known.where(fold(F.col("doc_id")) > 0).agg(F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("s")).first()["s"])
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    return evidence.select("doc_id", held.alias("held_out"), value.alias("score"), (value >= 0.5).cast("int").alias("predicted")), fitted


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, from labels (doc_id, toxic 0 or 1).

    Null and empty texts have no evidence and get the score of evidence 0. Labels that are null or name no document are
    ignored; a document labelled both ways counts as toxic. Fold 0 by crc32 of the id is never learned from. Without
    labels of both kinds in the fold that fits the curve, every score is the toxic share of the labels learned from (0
    without any). A null doc_id is held out. Repeated rows score alike; an empty table gives no rows.
    """
    return _scored(docs, labels)[0]


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic; rows without a doc_id stay. Where labels of one kind, or
    none, fit no curve, nothing tells toxic rows from others and all stay."""
    scored, fitted = _scored(docs, labels)
    if not fitted:
        return docs
    return docs.join(scored.where("predicted = 1").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
