"""Alignment of two tokenizers: byte-level BPE ids (A) against pieces (B) of the same text.

Elementary intervals: the union of both arrays of token ends cuts a text's bytes into stretches, each owned by one token of A
and one of B, so each stretch is one overlap; ends that both share close groups. Neither tokenizer merges across a single
space or line feed, so a chunk of documents is aligned by its distinct words (texts with other white space as one word each)
and documents are put together from them. What goes through the shuffle is a row for each pair of ids and chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import gather, pack, rows_of, unpack
from .common import id_text, read, stage
from .tokenfiles import _Coder

#: Text of a chunk: its documents' words and links are arrays of some twenty times that.
CHUNK_BYTES = 8 << 20
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: White space other than single spaces and line feeds, a space at an end, or controls: such a text is one word.
_WHOLE = re.compile("[^\\S \n]|\\s\\s|\\A\\s| \\Z|[\x00-\x09\x0b-\x1f\x85\u180e\u200b\u2581\ufeff]")


class _Tokens:
    """Bytes of each id of a vocabulary, and ids of words."""

    def __init__(self, table: list[bytes]):
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(table), np.uint8)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all), words being texts after a space or a line feed or whole texts."""
        many = np.zeros(len(words), np.int64)
        single = np.fromiter((w != "\n" and not _WHOLE.search(w[1:]) and "\n" not in w and w[:1] not in ("\t", "") for w in words), bool, len(words))
        many[single], plain = self.lines([w for w, s in zip(words, single) if s])
        rest = [np.array(self.whole(w), np.int64) for w, s in zip(words, single) if not s]
        many[~single] = [len(x) for x in rest]
        ids, whose = np.zeros(int(many.sum()), np.int64), np.repeat(single, many)
        ids[whose], ids[~whose] = plain, np.concatenate([*rest, np.zeros(0, np.int64)])
        return many, ids


class _ByteTokens(_Tokens):
    def __init__(self, path: str):
        self.coder = _Coder(path)
        self.coder.tokenizer.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.coder.tokenizer.get_vocab()
        table = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            table[i] = bytes(byte_of[c] for c in token)
        super().__init__(table)

    def lines(self, words):
        return self.coder.words(words)

    def whole(self, word):
        return self.coder._encode([word])[0]


class _PieceTokens(_Tokens):
    def __init__(self, path: str):
        self.pieces = p = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__([bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("\u2581", " ").encode() for i in range(p.get_piece_size())])
        self.line = p.encode("\n")[-1]

    def lines(self, words):
        joined = ["\n" + "\n".join(words[k : k + 200]) + "\n" for k in range(0, len(words), 200)]
        parts = [np.array(x[2:], np.int64) for x in self.pieces.encode(joined, num_threads=1)]  # the added space and the first line feed go
        ids = np.concatenate([*parts, np.zeros(0, np.int64)])
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(words):
            raise RuntimeError("words did not come back one by one")
        return np.diff(ends, prepend=-1) - 1, np.delete(ids, ends)

    def whole(self, word):
        """A line feed that stands alone, or a text behind its space, which the library adds itself."""
        return self.pieces.encode("\n", num_threads=1)[1:] if word == "\n" else self.pieces.encode(word[1:], num_threads=1)


@lru_cache(1)
def _tokenizers(a: str, b: str) -> tuple[_ByteTokens, _PieceTokens]:
    return _ByteTokens(a), _PieceTokens(b)


def words_of(text: str) -> list[str]:
    """A space and the text, cut where neither tokenizer merges; the words join to it."""
    if _WHOLE.search(text):
        return [" " + text]
    out: list[str] = []
    for k, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        out += ["\n", first] if k else [" " + first]
        out += [" " + w for w in rest]
    return [w for w in out if w]


def intervals(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, A owner, B owner, whether both end there) of the elementary intervals of two rows of tokens over the same bytes."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    ends = np.union1d(a_end, b_end)
    a, b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    return ends, a, b, a_end[a] == b_end[b]


class _Aligned:
    """Distinct words aligned at once: of each, whether both tokenizers give its bytes back, counts, groups as text, and the
    places of its links' id pairs in ``pairs`` (A id * B size + B id)."""

    def __init__(self, words: list[str], a: _ByteTokens, b: _PieceTokens):
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.right = np.ones(len(raw), bool)
        coded = []
        for t in (a, b):
            many, ids = t.encode(words)
            of = np.repeat(np.arange(len(raw)), many)
            self.right &= np.bincount(of, t.lengths[ids], len(raw)).astype(np.int64) == size
            coded.append((many, ids, of))
        for t, (_, ids, of) in zip((a, b), coded):  # equal lengths: compare the bytes
            mine, fits = ids[self.right[of]], np.flatnonzero(self.right)
            got = t.flat[gather(t.starts, t.lengths, mine)] if len(mine) else np.zeros(0, np.uint8)
            told = np.frombuffer(b"".join(raw[k] for k in fits.tolist()), np.uint8)
            self.right[np.unique(np.repeat(fits, size[fits])[got != told])] = False
        (a_many, a_ids, a_of), (b_many, b_ids, b_of) = [(many * self.right, ids[self.right[of]], of[self.right[of]]) for many, ids, of in coded]
        n = len(raw)
        if not len(a_ids):
            self.counts, self.groups, self.pairs, self.links, self.link_many = np.zeros((4, n), np.int64), [""] * n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
            return
        ends, a_at, b_at, both = intervals(a.lengths[a_ids], b.lengths[b_ids])
        of = a_of[a_at]
        self.link_many = np.bincount(of, minlength=n)
        self.counts = np.stack([a_many, b_many, np.bincount(of[both], minlength=n), self.link_many])
        self.pairs, self.links = np.unique(a_ids[a_at] * len(b.lengths) + b_ids[b_at], return_inverse=True)
        # Groups as text: the ids of A, then of B, of one group after the other; each id with what comes after it.
        shared = ends[both]
        group = np.concatenate([np.searchsorted(shared, np.cumsum(t.lengths[i])) for t, i in ((a, a_ids), (b, b_ids))])
        side = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.argsort(group * 2 + side, kind="stable")
        group, side, ids, of = group[order], side[order], np.concatenate([a_ids, b_ids])[order].tolist(), np.concatenate([a_of, b_of])[order]
        mark = np.where(np.append(group[1:] != group[:-1], True), 2, np.where(np.append(side[1:] != side[:-1], True), 1, 0)).tolist()
        texts = [f"{i}{',|;'[m]}" for i, m in zip(ids, mark)]
        bounds = np.searchsorted(of, np.arange(n + 1)).tolist()
        self.groups = ["".join(texts[x:y]) for x, y in zip(bounds, bounds[1:])]


_CHUNK = "chunk long, doc_ids array<long>, counts array<array<long>>, groups array<string>, bag binary, links binary, pairs array<long>, docs array<long>"


def _chunks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Documents by chunk: (doc_ids, counts, groups) of each; bag: words of each document, uses; links: pairs of each word,
    as places in pairs; docs: documents of the chunk that hold the pair linked."""

    def close(chunk: int, ids: list, texts: list, words: dict) -> pa.RecordBatch:
        aligned = _Aligned(list(words), *_tokenizers(a, b))
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        codes, of = np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.int64), np.repeat(np.arange(len(ids)), length)
        wrong = np.bincount(of, ~aligned.right[codes], len(ids)) > 0
        hashes = [
            None if bad or not len(mine) else hashlib.sha256("".join(map(aligned.groups.__getitem__, mine.tolist()))[:-1].encode()).hexdigest() for bad, mine in zip(wrong.tolist(), texts)
        ]
        codes, of = codes[~wrong[of]], of[~wrong[of]]
        counts = np.stack([np.bincount(of, c[codes], len(ids)).astype(np.int64) for c in aligned.counts], axis=1)
        held, uses = np.unique(of * len(words) + codes, return_counts=True)
        of, codes = held // max(len(words), 1), held % max(len(words), 1)
        starts = np.cumsum(aligned.link_many) - aligned.link_many
        at = gather(starts, aligned.link_many, codes)
        known = np.unique(np.repeat(of, aligned.link_many[codes]) * max(len(aligned.pairs), 1) + aligned.links[at]) % max(len(aligned.pairs), 1)
        tallies = np.bincount(known, minlength=len(aligned.pairs))
        kept = tallies > 0  # pairs of documents without tokens are none
        place = np.cumsum(kept) - 1
        used = np.repeat(np.isin(np.arange(len(words)), codes), aligned.link_many)
        many = np.where(np.isin(np.arange(len(words)), codes), aligned.link_many, 0)
        lists = [
            pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.list_(pa.int64()))), pa.array([hashes], pa.list_(pa.string())),
            pa.array([pack(np.bincount(of, minlength=len(ids)).astype("<u4"), codes.astype("<u4"), uses.astype("<u4"))], pa.binary()),
            pa.array([pack(many.astype("<u4"), place[aligned.links[used]].astype("<u4"))], pa.binary()),
            pa.array([aligned.pairs[kept]], pa.list_(pa.int64())), pa.array([tallies[kept]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(lists, ["chunk", "doc_ids", "counts", "groups", "bag", "links", "pairs", "docs"])

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0

        def fresh():
            words = defaultdict()
            words.default_factory = words.__len__
            return [], [], words, 0

        ids, texts, words, size = fresh()
        for doc, text in rows_of(batches):
            ids.append(doc)
            texts.append(np.fromiter(map(words.__getitem__, words_of(text.decode()) if text else ()), np.uint32))
            size += len(text)
            if size >= CHUNK_BYTES:
                yield close(task << 32 | seq, ids, texts, words)
                (ids, texts, words, size), seq = fresh(), seq + 1
        if ids:
            yield close(task << 32 | seq, ids, texts, words)

    return stage(id_text(docs).mapInArrow(run, _CHUNK), "aligned")


def pair_counts(chunks: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair of ids linked, and whether none of its A id has more."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))
    counts = stage(counts.withColumn("a", F.floor(F.col("pair") / b_size)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    A encodes a space and the text, B the text, which it begins with a space itself; both take special strings as text. Texts
    that are null, empty, or not given back byte by byte by both have no tokens: zeros and an empty text. Repeated rows and
    null doc_ids are documents of their own; an empty table gives no rows.
    """
    a, b = a or public_tokenizers.path(A_FILE), b or public_tokenizers.path(B_FILE)
    chunks = _chunks(docs, a, b)
    b_size = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    told = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(chunks, b_size), "pair")
    told = told.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"), F.collect_list(F.col("best").cast("int")).alias("best"))

    def add_up(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, counts, groups = (row.column(c).flatten() for c in ("doc_ids", "counts", "groups"))
                at, n, best = (np.asarray(row.column(c).flatten()).astype(np.int64) for c in ("at", "n", "best"))
                worth = np.zeros((2, len(at)), np.int64)
                worth[0, at], worth[1, at] = best, n
                many, links = (x.astype(np.int64) for x in unpack(row.column("links")[0].as_py(), "<u4", "<u4"))
                held, codes, uses = (x.astype(np.int64) for x in unpack(row.column("bag")[0].as_py(), "<u4", "<u4", "<u4"))
                word, doc = np.repeat(np.arange(len(many)), many), np.repeat(np.arange(len(held)), held)
                sums = []
                for kind in worth:
                    by_word = np.zeros(len(many), np.int64)
                    np.add.at(by_word, word, kind[links])
                    total = np.zeros(len(held), np.int64)
                    np.add.at(total, doc, uses * by_word[codes])
                    sums.append(pa.array(total))
                four = np.asarray(counts.flatten()).reshape(-1, 4)
                digest = pa.array([x or "" for x in groups.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, np.ascontiguousarray(four.T)), *sums, digest], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    rows = chunks.drop("pairs", "docs").join(told, "chunk", "left")
    return rows.mapInArrow(add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both vocabularies, aligned."""
    return align(read(spark, sf_dir, "documents"))
