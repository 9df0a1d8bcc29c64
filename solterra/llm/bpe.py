"""Byte-level BPE by distinct words: each distinct word of the corpus is encoded once, its ids joined back by position."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import answered, chunk_table, gather, pack, packs_of, unpack, unpack_words
from .common import as_bytes, id_text, read
from .units import units

RANKS = "byte_bpe_50k.tiktoken"


def ranks_path() -> str:
    return public_tokenizers.path(RANKS)


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def _coder(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, bytes) of the token-byte table by id; the vocabulary's size bounds it."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    lengths = np.fromiter(map(len, table), np.int64, len(table))
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(table), np.uint8)


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id int, bytes binary) of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in _ranks(path or ranks_path()).items()], "id int, bytes binary")


def _answers(table: DataFrame, path: str) -> DataFrame:
    """(chunk, part, answer): for each word of a pack its number of ids, then all ids; a part's distinct words are encoded once."""

    def encode(packs: pa.Table) -> pa.Table:
        coder, known, out = _coder(path), {}, []
        for blob in packs.column("words").to_pylist():
            words = unpack_words(blob)
            for w in words:
                if w not in known:
                    known[w] = np.array(coder.encode_ordinary(w.decode()), "<u4").tobytes()
            got = [known[w] for w in words]
            out.append(pack(np.fromiter(map(len, got), "<u4", len(got)) // 4, np.frombuffer(b"".join(got), "<u4")))
        return pa.table({"chunk": packs.column("chunk"), "part": packs.column("part").cast(pa.int32()), "answer": pa.array(out, pa.binary())})

    return packs_of(table).groupBy("part").applyInArrow(encode, "chunk long, part int, answer binary")


def encoded_chunks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The chunk table of docs with the ids of its words."""
    table = chunk_table(docs, units)
    return answered(table, _answers(table, path or ranks_path()))


def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids uint32) of each document of answered chunks, put together by position."""
    for batch in batches:
        for row in batch.to_pylist():
            pieces = [unpack(a["answer"], "<u4", "<u4") for a in row["answers"] or []]
            counts = np.concatenate([p[0] for p in pieces]).astype(np.int64) if pieces else np.zeros(0, np.int64)
            ids = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, np.uint32)
            starts = np.cumsum(counts) - counts
            codes, at = unpack(row["codes"], "<u4")[0], 0
            del pieces
            for doc, n in zip(row["doc_ids"], row["lengths"]):
                yield doc, ids[gather(starts, counts, codes[at : at + n])]
                at += n


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for every row of docs (doc_id, text); null and empty texts have no ids. Repeated rows and
    null doc_ids stay rows of their own; an empty table gives no rows."""

    def run(batches):
        for doc, ids in documents_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return encoded_chunks(docs, path).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: np.ndarray, path: str) -> bytes:
    starts, lengths, flat = _token_bytes(path)
    return b"".join(flat[gather(starts, lengths, ids[at : at + 65536].astype(np.int64))].tobytes() for at in range(0, len(ids), 65536))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids): each id joins the token-byte table by its place there. Null ids: no bytes;
    an id outside the vocabulary is an error."""
    where = path or ranks_path()

    def run(batches):
        for batch in batches:
            out = [decoded(np.array(ids or [], np.int64), where) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if asked for: every text encoded, and its ids decoded again."""
    where = path or ranks_path()
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        out: list[tuple] = []

        def batch():
            columns = list(zip(*out)) or [[]] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, schema)], [name for name, _ in schema])

        for doc, ids in documents_of(batches):
            row = doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded(ids, where)).hexdigest()
            out.append(row + (ids.astype(np.int32),) * with_ids)
            if len(out) == 1000:
                yield batch()
        yield batch()

    return encoded_chunks(docs, where).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank file and decoded again."""
    return round_trip(read(spark, sf_dir, "documents"))
