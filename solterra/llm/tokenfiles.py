"""Token ids as Parquet list columns: one row a document in ascending id order, small row groups, dictionary or delta
encoded pages with page indexes, so that readers fetch the ids of some documents, or lengths alone, without the rest."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import gather
from .common import id_text, partitions, read, shared_dir

TOKENIZER, END = "byte_bpe_50k.json", 0
#: White space other than single spaces and line feeds; texts that hold it are encoded whole.
RARE_BYTES = "  |\n\n| \n|\n |[\\t\\v\\f\\r\\x1c-\\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Bytes of text that a task encodes at a time, each distinct word of them once.
GROUP_BYTES = 18 << 20

FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",  # ids of a large vocabulary outgrow a page's dictionary:
    "parquet.writer.version": "PARQUET_2_0",  # this version's delta encoding takes integers in its place
}


class _Coder:
    """Ids of many texts at once: their distinct words go through the tokenizers library, the texts are gathered from them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([RARE_BYTES, *added])  # the library cuts added tokens out before all else: such texts go whole
        self.line = self.tokenizer.token_to_id("Ċ")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words without white space but a space before. Line feeds part them: no such word holds their id."""
        parts = []
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            parts += [np.array(x, np.int32) for x in self._encode(["\n".join(some[k : k + 200]) + "\n" for k in range(0, len(some), 200)])]
        ids = np.concatenate([*parts, np.zeros(0, np.int32)])
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(words):
            raise RuntimeError("words did not come back one by one")
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends)

    def plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of texts in which each space and line feed stands alone and there is no other white space."""
        lines = pc.split_pattern(texts, "\n")
        per_text = np.diff(np.asarray(lines.offsets))
        words = pc.split_pattern(lines.flatten(), " ")
        at = np.asarray(words.offsets).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        codes, n = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
        first = np.zeros(len(codes), bool)
        first[at[:-1]] = True  # a line's first word has no space before it
        codes[first] += n
        table, lengths, ids = coded.dictionary.to_pylist(), np.zeros(2 * n + 1, np.int64), []
        used = np.bincount(codes, minlength=2 * n) > 0
        places = np.flatnonzero(used).tolist()
        words = [table[k - n] if k >= n else " " + table[k] for k in places]
        named = [(k, w) for k, w in zip(places, words) if w and w != " "]
        order = np.array([k for k, _ in named], np.int64)
        lengths[order], got = self.words([w for _, w in named])
        ids.append((order, got))
        if " " in words:  # at the end of a text
            space = np.array(self._encode([" "])[0], np.int32)
            at_space = places[words.index(" ")]
            lengths[at_space] = len(space)
            ids.append((np.array([at_space]), space))
        lengths[2 * n] = 1
        ids.append((np.array([2 * n]), np.array([self.line], np.int32)))
        flat = np.concatenate([x for _, x in ids])
        order = np.concatenate([k for k, _ in ids])
        starts = np.zeros(2 * n + 1, np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        # Between the lines of a text goes a line feed's code: after every line but a text's last.
        last = np.zeros(len(at) - 1, bool)
        last[np.cumsum(per_text) - 1] = True
        feeds = at[1:][~last]
        codes = np.insert(codes, feeds, 2 * n)
        line_end = at[1:] + np.cumsum(~last)
        ends = line_end[np.cumsum(per_text) - 1]
        totals = np.concatenate(([0], np.cumsum(lengths[codes])))
        ids = [flat[gather(starts, lengths, codes[at : at + 300_000])] for at in range(0, len(codes), 300_000)]
        return np.diff(totals[np.concatenate(([0], ends))]), np.concatenate(ids) if ids else np.zeros(0, np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of texts, one after the other."""
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        if not odd.any():
            return self.plain(texts)
        lengths = np.zeros(len(texts), np.int64)
        ids = self._encode(texts.filter(pa.array(odd)).to_pylist())
        lengths[odd] = [len(x) for x in ids]
        lengths[~odd], plain = self.plain(texts.filter(pa.array(~odd))) if not odd.all() else ([], np.zeros(0, np.int32))
        flat = np.zeros(int(lengths.sum()), np.int32)
        whose = np.repeat(odd, lengths)
        flat[~whose] = plain
        flat[whose] = np.concatenate([np.array(x, np.int32) for x in ids])
        return lengths, flat


@lru_cache(1)
def _coder(path: str) -> _Coder:
    return _Coder(path)


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end: int = END, files: int | None = None) -> None:
    """Write docs (doc_id, text) to ``out``: doc_id, shard (number of the file in id order), start (ids before it in its
    file), n_tokens, ids (each text's ids and the end id). Null and empty texts have the end id alone; null doc_ids come
    first; rows that share a doc_id are in order of their texts; an empty table writes no rows."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def encode(batches):
        shard, start = TaskContext.get().partitionId(), 0
        group, size = [], 0

        def coded():
            table = pa.Table.from_batches(group).combine_chunks()
            lengths, ids = _coder(path)(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
            ends = np.cumsum(lengths + 1)
            flat = np.insert(ids, np.cumsum(lengths), np.int32(end))
            for at in range(0, len(lengths), 1000):
                of = slice(at, at + 1000)
                a, b = int(ends[at] - lengths[at] - 1), int(ends[of][-1])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends[of] - a)).astype(np.int32)), pa.array(flat[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [table.column("doc_id").combine_chunks()[of], pa.array(np.full(len(lists), shard, np.int32)), pa.array(start + ends[of] - lengths[of] - 1), pa.array(lengths[of] + 1), lists],
                    ["doc_id", "shard", "start", "n_tokens", "ids"],
                )
            coded.ids = int(ends[-1])
            pa.default_memory_pool().release_unused()

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                group.append(batch.slice(at, 1000))
                size += group[-1].column("text").nbytes
                if size >= GROUP_BYTES:
                    yield from coded()
                    start += coded.ids
                    group, size = [], 0
        if group:
            yield from coded()

    n = files or partitions(docs.sparkSession)
    rows = id_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, "doc_id long, shard int, start long, n_tokens long, ids array<int>").write.options(**FILE_OPTIONS).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of written token files; start counts the ids of all documents before. Where ids are not
    asked for, the scan reads the narrow columns alone."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each file: small enough to send to all
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as token files, then read back."""
    out = f"{shared_dir(spark)}/solterra/{uuid.uuid4().hex}/tokens"
    write_tokens(read(spark, sf_dir, "documents"), out)

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            values, at = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, out).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
