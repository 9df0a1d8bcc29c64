"""Chunk tables: documents as codes of distinct words, so that a word crosses the network once for a chunk, not for each use.

A chunk is a run of documents of one scan task, about ``CHUNK_BYTES`` of text. Its row holds the ids of its documents, how
many words each has, and the sequence of word codes (the word's number within the chunk, by position). The distinct words
go out as ``parts`` packs, one for each hash part of the vocabulary; within a pack a word's place is its code less the
codes of the packs before it. So answers for a pack come back as an array in the same order, and a chunk's
documents are put together again by position. The chunk table is written once to the shared folder, in buckets by chunk, so that answers come to it: what follows never
depends on the order in which a task reads its rows a second time.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, id_text, partitions, stage_bucketed

CHUNK_BYTES = 12 << 20

SCHEMA = "chunk long, doc_ids array<long>, lengths array<int>, sizes array<int>, codes binary, uses binary, packs array<binary>"


def pack(*arrays: np.ndarray) -> bytes:
    """zstd of the arrays' bytes, those of wider items by plane (all low bytes first), each with its item size and length."""
    out = []
    for a in arrays:
        width = a.dtype.itemsize
        out.append(np.array([width, len(a)], "<u4").tobytes())
        out.append(a.view(np.uint8).reshape(-1, width).T.tobytes() if width > 1 else a.tobytes())
    return zstandard.compress(b"".join(out), 3)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, []
    for kind in kinds:
        width, n = np.frombuffer(data, "<u4", 2, at).tolist()
        planes = np.frombuffer(data, np.uint8, n * width, at + 8)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n) if width > 1 else planes.view(kind))
        at += 8 + n * width
    return out


def pack_words(words: list[bytes]) -> bytes:
    return pack(np.fromiter(map(len, words), "<u4", len(words)), np.frombuffer(b"".join(words), np.uint8))


def unpack_words(blob: bytes) -> list[bytes]:
    lengths, flat = unpack(blob, "<u4", "u1")
    data, ends = flat.tobytes(), np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def gather(starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Indices of the items of the runs ``which``, one run after the other."""
    n = lengths[which]
    ends = np.cumsum(n)
    return np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def rows_of(batches: Iterable[pa.RecordBatch], step: int = 100):
    """(doc_id, text bytes) of the rows, few texts at a time as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text")))


def chunk_table(docs: DataFrame, split: Callable[[bytes], Iterable], parts: int | None = None, bags: bool = False, chunk_bytes: int | None = None) -> DataFrame:
    """The staged chunk table of docs (doc_id, text). ``split`` gives a text's words, as bytes or str. With ``bags`` a
    document has its distinct codes in ascending order, as differences, and how often it uses each, in place of the sequence."""
    parts, full = parts or partitions(docs.sparkSession), chunk_bytes or CHUNK_BYTES

    def close(task: int, seq: int, ids: list, lengths: list, codes: list, words: dict) -> pa.RecordBatch:
        known = [w.encode() if isinstance(w, str) else w for w in words]
        part = np.fromiter((zlib.crc32(w) % parts for w in known), np.int64, len(known))
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(known), np.uint32)
        rank[order] = np.arange(len(known), dtype=np.uint32)
        bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
        packs = [pack_words([known[i] for i in order[a:b].tolist()]) if b > a else None for a, b in zip(bounds, bounds[1:])]
        uses = None
        if bags:
            pairs = [np.unique(rank[c], return_counts=True) for c in codes]
            lengths = [len(c) for c, _ in pairs]
            flat = np.concatenate([np.diff(c, prepend=np.uint32(0)) for c, _ in pairs])
            uses = pack(np.concatenate([n for _, n in pairs]).astype("<u4"))
        else:
            flat = rank[np.concatenate(codes)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task << 32 | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([np.diff(bounds).tolist()], pa.list_(pa.int32())), pa.array([pack(flat.astype("<u4"))], pa.binary()), pa.array([uses], pa.binary()), pa.array([packs], pa.list_(pa.binary())),
            ],
            ["chunk", "doc_ids", "lengths", "sizes", "codes", "uses", "packs"],
        )

    def run(batches):
        task, seq, size = TaskContext.get().partitionId(), 0, 0
        ids, lengths, codes, words = [], [], [], defaultdict()
        words.default_factory = words.__len__
        for doc, text in rows_of(batches):
            mine = np.fromiter(map(words.__getitem__, split(text)), np.uint32)
            ids.append(doc)
            lengths.append(len(mine))
            codes.append(mine)
            size += len(text)
            if size >= full:
                yield close(task, seq, ids, lengths, codes, words)
                ids, lengths, codes, words, size, seq = [], [], [], defaultdict(), 0, seq + 1
                words.default_factory = words.__len__
        if ids:
            yield close(task, seq, ids, lengths, codes, words)

    return stage_bucketed(id_text(docs).mapInArrow(run, SCHEMA), "chunks", "chunk")


def packs_of(table: DataFrame) -> DataFrame:
    """(part, chunk, words): a row for each pack that holds words."""
    return table.select("chunk", F.posexplode("packs").alias("part", "words")).where("words is not null").select("part", "chunk", "words")


def answered(table: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with its packs' answers (chunk, part, answer binary) in order of part; the packs themselves are left out."""
    told = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "answer"))).alias("answers"))
    return table.drop("packs").join(told.hint("merge"), "chunk", "left")
