"""Exact substring dedup over windows of words, by super-k-mers.

Consecutive windows of one document that share a minimiser (the least hash of their runs of ``GRAM`` words) travel as one packed
string, a super-k-mer, to their minimiser's bucket. Equal windows have equal minimisers, so each bucket settles its own:

1. Documents become chunks of word codes (see ``chunks``). Of each chunk only its distinct minimisers are counted over the corpus: a
   minimiser that stands once marks windows that repeat nowhere, and their words never travel.
2. Of equal super-k-mers, told by 128 bits of their words, the first over all documents leads its bucket: every window of
   the others stands earlier. Leaders alone in their bucket settle at once and never travel either.
3. The other leaders' words are packed and go to their bucket, which sorts its windows and tells which stand earlier. Buckets
   of more than ``BUCKET`` leaders are dealt out by window instead, so that no task holds one.
4. Chunks take back the runs of windows to remove, and drop the words that these cover.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunk_table, gather, unpack, unpack_words
from .common import read, stage

WINDOW, GRAM = 20, 8
#: Text of a chunk: its words' hashes and windows are arrays of some ten times that.
CHUNK_BYTES = 5 << 20
#: Different super-k-mers of a bucket that one task sorts.
BUCKET = 4096
#: Windows of a super-k-mer at most, so that a text of one word over and over gives strings of bounded length.
LONGEST = 256
_NULL_ID = -(1 << 63)


def _words(text: bytes) -> list[bytes]:
    return text.split()  # bytes part at the six ASCII white spaces alone


def super_kmers(hashes: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, minimiser, times) of the super-k-mers of documents whose words' hashes follow one another; times:
    how often the minimiser stands in it, more than once wherever a window repeats within it."""
    none = (np.zeros(0, np.int64),) * 5
    if len(hashes) < window:
        return none
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    least = grams[: len(hashes) - window + 1].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, grams[k : k + len(least)], out=least)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= ends[doc])  # windows within one document
    if not len(at):
        return none
    new = np.append(True, (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]))
    run = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(within % LONGEST == 0)
    many = np.diff(np.append(first, len(at)))
    start, spans = at[first], many + (window - gram)
    same = grams[gather(start, spans, np.arange(len(start)))] == np.repeat(least[start], spans)
    times = np.add.reduceat(same.astype(np.int64), np.cumsum(spans) - spans)
    return doc[start], start - (ends - lengths)[doc[start]], many, least[start].view(np.int64), times


class _Chunk:
    """A row of the chunk table, unpacked: words by code, codes, and where each document begins."""

    def __init__(self, row: dict):
        self.words = [w for blob in row["packs"] if blob is not None for w in unpack_words(blob)]
        self.codes = unpack(row["codes"], "<u4")[0]
        self.lengths = np.array(row["lengths"], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def hashed(self) -> np.ndarray:
        """128 bits of each word of the documents."""
        bits = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), np.uint64).reshape(-1, 2)
        return bits[self.codes]

    def text(self, a: int, b: int) -> bytes:
        return b" ".join(map(self.words.__getitem__, self.codes[a:b].tolist()))


_COLUMNS = ["doc_ids", "lengths", "codes", "packs"]


def _minimisers(chunks: DataFrame, window: int, gram: int) -> DataFrame:
    """(chunk, minimisers): those of each chunk that the corpus holds in more than one place."""

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                *_, h, times = super_kmers(chunk.hashed()[:, 0], chunk.lengths, window, gram)
                kinds, of = np.unique(h, return_inverse=True)
                n = np.bincount(of, times, len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), row["chunk"], np.int64)), pa.array(kinds, pa.int64()), pa.array(np.minimum(n, 2), pa.int64())], ["chunk", "h", "n"])

    held = chunks.select("chunk", *_COLUMNS).mapInArrow(count, "chunk long, h long, n long").repartition("h")
    often = held.groupBy("h").agg(F.sum("n").alias("times")).where("times > 1")
    return held.join(often, "h").groupBy("chunk").agg(F.collect_list("h").alias("minimisers"))


def _keyed(chunks: DataFrame, repeated: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, key, doc, chunk, at, start, n, times, own): the super-k-mers of repeated minimisers, each once a chunk at its first
    place there; own: places of the others, whose windows are repeats in any case."""
    schema = "h long, key binary, doc long, chunk long, at int, start long, n int, times int, own array<struct<at:int,start:long>>"
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("at", pa.int32()), ("start", pa.int64())]))]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.select(_COLUMNS).to_pylist()[0]
                chunk, ids = _Chunk(row), [_NULL_ID if i is None else i for i in row["doc_ids"]]
                bits = chunk.hashed()
                runs = super_kmers(bits[:, 0], chunk.lengths, window, gram)
                keep = np.isin(runs[3], np.asarray(one.column("minimisers").flatten()))
                doc, start, many, h, times = (x[keep] for x in runs)
                a = (chunk.begins[doc] + start).tolist()
                b = (chunk.begins[doc] + start + many + window - 1).tolist()
                number, places = one.column("chunk")[0].as_py(), {}
                for i, (x, y, d, s) in enumerate(zip(a, b, doc.tolist(), start.tolist())):
                    places.setdefault(xxhash.xxh3_128_digest(bits[x:y]), []).append((ids[d], d, s, i))
                many, h, times, out = many.tolist(), h.tolist(), times.tolist(), []
                for key, found in places.items():
                    (order, d, s, i), *rest = sorted(found) if len(found) > 1 else found
                    out.append((h[i], key, order, number, d, s, many[i], min(times[i], 2), [{"at": d2, "start": s2} for _, d2, s2, _ in rest]))
                for at in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out[at : at + 10_000]), kinds)], names)

    rows = chunks.select("chunk", *_COLUMNS).join(repeated.hint("merge"), "chunk")
    return stage(rows.mapInArrow(run, schema), "super_kmers")


def _packed(chunks: DataFrame, leaders: DataFrame, window: int) -> DataFrame:
    """(h, packed, doc, chunk, at, start, n): leaders (h, doc, chunk, at, start, n) with their words as one string."""
    wanted = leaders.groupBy("chunk").agg(F.collect_list(F.struct("h", "doc", "at", "start", "n")).alias("runs"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                chunk, number = _Chunk(one.select(_COLUMNS).to_pylist()[0]), one.column("chunk")[0]
                runs = one.column("runs").flatten()
                h, doc, at, start, n = runs.flatten()
                a = chunk.begins[np.asarray(at)] + np.asarray(start)
                b = a + np.asarray(n) + window - 1
                for x in range(0, len(a), 5000):
                    some = slice(x, x + 5000)
                    texts = pa.array([chunk.text(i, j) for i, j in zip(a[some].tolist(), b[some].tolist())], pa.binary())
                    cut = [c.slice(x, 5000) for c in (h, doc, at, start, n)]
                    yield pa.RecordBatch.from_arrays([cut[0], texts, cut[1], pa.array([number.as_py()] * len(texts), pa.int64()), *cut[2:]], ["h", "packed", "doc", "chunk", "at", "start", "n"])

    rows = chunks.select("chunk", *_COLUMNS).join(wanted.hint("merge"), "chunk")
    return stage(rows.mapInArrow(run, "h long, packed binary, doc long, chunk long, at int, start long, n int"), "packed")


_ORDER = ["doc", "chunk", "at", "start"]


def _sorted_buckets(rows: DataFrame, window: int) -> DataFrame:
    """(chunk, at, start, n): windows of rows that stand earlier among the rows of their bucket, a bucket in one task."""

    def told(rows: list[dict]) -> list[tuple]:
        found = []
        for row in rows:
            words = row["packed"].split(b" ")
            found += [(b" ".join(words[k : k + window]), row["doc"], row["chunk"], row["at"], row["start"] + k) for k in range(row["n"])]
        found.sort()
        return [b[2:] for a, b in itertools.pairwise(found) if a[0] == b[0]]

    def run(batches: Iterator[pa.RecordBatch]):
        def each():
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    yield from batch.slice(at, 1000).to_pylist()

        out: list[tuple] = []
        for _, group in itertools.groupby(each(), key=lambda r: r["h"]):
            out += told(list(group))
            if len(out) >= 10_000:
                yield _runs_batch(out)
                out = []
        yield _runs_batch(out)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "chunk long, at int, start long, n int")


def _runs_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int32()), pa.array(list(columns[2]), pa.int64()), pa.array([1] * len(rows), pa.int32())], ["chunk", "at", "start", "n"])


def _dealt_windows(rows: DataFrame, window: int) -> DataFrame:
    """As ``_sorted_buckets``, for buckets of any size: each window is a row of its own, counted where equal ones meet. The first of
    each is found by aggregation; the join that follows may be split on its left side."""

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                of, texts, starts = [], [], []
                for k, row in enumerate(part.select(["packed", "start", "n"]).to_pylist()):
                    words = row["packed"].split(b" ")
                    texts += [b" ".join(words[j : j + window]) for j in range(row["n"])]
                    starts += range(row["start"], row["start"] + row["n"])
                    of += [k] * row["n"]
                moved = part.select(["doc", "chunk", "at"]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), *moved.columns, pa.array(starts, pa.int64())], ["text", *_ORDER])

    windows = rows.mapInArrow(explode, "text binary, doc long, chunk long, at int, start long").withColumn("place", F.struct(*_ORDER))
    first = windows.groupBy("text").agg(F.min("place").alias("first"))
    return windows.join(first, "text").where("place > first").select("chunk", "at", "start", F.lit(1).alias("n"))


def repeated_windows(chunks: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int | None = None) -> DataFrame:
    """(chunk, at, start, n): runs of n windows from word ``start`` of the chunk's document number ``at`` whose words all stand
    earlier, by doc_id, chunk, place in the chunk and start."""
    keyed = _keyed(chunks, _minimisers(chunks, window, gram), window, gram)
    dealt = keyed.select("h", "key", *_ORDER, "n", "times", F.struct(*_ORDER).alias("place")).repartition("key")
    first = dealt.groupBy("key").agg(F.min("place").alias("first"))
    placed = stage(dealt.join(first, "key").select("h", *_ORDER, "n", "times", (F.col("place") == F.col("first")).alias("leads")), "placed")
    own = keyed.select("chunk", "n", F.explode("own").alias("x")).select("chunk", "x.at", "x.start", "n")
    follow = placed.where("not leads").select("chunk", "at", "start", "n")
    members = placed.where("leads").groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.max("times").alias("times")).where("members > 1 or times > 1")
    packed = _packed(chunks, placed.where("leads").drop("times", "leads").join(members.select("h"), "h", "left_semi"), window)
    large = members.where(F.col("members") > (bucket or BUCKET)).select("h")
    small = _sorted_buckets(packed.join(large, "h", "left_anti"), window)
    return own.unionByName(follow).unionByName(small).unionByName(_dealt_windows(packed.join(large, "h", "left_semi"), window))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket: int | None = None, text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs (doc_id, text), and with ``text`` the kept words.

    Words are parted by ASCII white space; each word that a window of ``window`` words covers goes if the same words also start
    earlier: in a document of smaller id (a null id is smallest; rows of one id count in the order in which they are read), or
    before in the same one. Windows are judged on the input. Kept words are joined by one space. Null and empty texts, and texts
    shorter than a window, lose nothing; an empty table gives no rows.
    """
    chunks = chunk_table(docs, _words, parts=1, chunk_bytes=CHUNK_BYTES)
    runs = repeated_windows(chunks, window, gram, bucket)
    runs = runs.groupBy("chunk").agg(F.collect_list(F.struct("at", "start", "n")).alias("runs"))

    def write(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.select(_COLUMNS).to_pylist()[0]
                chunk = _Chunk(row)
                words, codes, lengths, begins = chunk.words, chunk.codes, chunk.lengths, chunk.begins
                edge = np.zeros(len(codes) + 1, np.int64)
                found = one.column("runs").flatten()
                if len(found):
                    at, start, n = (np.asarray(c).astype(np.int64) for c in found.flatten())
                    a = begins[at] + start
                    np.add.at(edge, a, 1)
                    np.add.at(edge, a + n + window - 1, -1)
                kept = np.cumsum(edge[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(kept)))
                digests, texts = [], []
                for a, n in zip(begins.tolist(), lengths.tolist()):
                    body = b" ".join(map(words.__getitem__, codes[a : a + n][kept[a : a + n]].tolist()))
                    digests.append(hashlib.sha256(body).hexdigest())
                    if text:
                        texts.append(body.decode())
                removed = lengths - (left[begins + lengths] - left[begins])
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(lengths), pa.array(removed), pa.array(digests, pa.string())] + [pa.array(texts, pa.string())] * text
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * text)

    rows = chunks.select("chunk", *_COLUMNS).join(runs.hint("merge"), "chunk", "left")
    return rows.mapInArrow(write, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that stand earlier in the corpus."""
    return dedup(read(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(len(words) - {WINDOW - 1})) AS start, words FROM d WHERE len(words) >= {WINDOW}),
marked AS (SELECT doc_id, start, row_number() OVER (PARTITION BY array_to_string(words[start + 1 : start + {WINDOW}], ' ') ORDER BY doc_id, start) > 1 AS again FROM w),
spans AS (SELECT doc_id, list(start) AS starts FROM marked WHERE again GROUP BY doc_id),
each AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM d),
gone AS (SELECT DISTINCT doc_id, s + k AS pos FROM (SELECT doc_id, unnest(starts) AS s FROM spans), range({WINDOW}) AS r(k)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
