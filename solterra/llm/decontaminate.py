"""Benchmark decontamination with a generalised suffix automaton over word ids.

The words of the test items form one automaton for each block of items. Items longer than a piece are cut into pieces that
overlap by a window less a word, so that a block holds about ``BLOCK_WORDS`` words whatever the benchmark's size. Blocks are
built in tasks and met one after the other: driver and workers hold one of them at a time. Documents stream through it:
after each word it knows the longest run of words ending there that some item holds.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, id_text, read, stage

#: Words of a block, about, and of a piece of an item at most.
BLOCK_WORDS, PIECE_WORDS = 100_000, 20_000

#: Bytes of words, A-Z lowered: digits, letters and every byte of a non-ASCII character; all else becomes a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences. ``window``: words in a window; a shorter item is one window itself."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.len, ends = [{}], [-1], [0], [set()]
        self.short: dict[int, set] = {}
        shorts = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            last = 0
            for c in ids:
                last = self._extend(last, c, ends)
                ends[last].add(item)
            if 0 < len(ids) < window:
                shorts.append((ids, item))
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):  # items flow up the links
            if self.len[self.link[state]] >= window:
                ends[self.link[state]] |= ends[state]
        # of a state that is the class of some run of ``window`` words: the items that hold that run
        self.items = {s: frozenset(ends[s]) for s in range(1, len(self.len)) if self.len[self.link[s]] < window <= self.len[s]}
        for ids, item in shorts:
            state = 0
            for c in ids:
                state = self.next[state][c]
            self.short.setdefault(state, set()).add(item)
        self.shortest = min([window, *(len(ids) for ids, _ in shorts)])
        # Of each state: the ancestor that is the class of its last ``window`` words, and its nearest ancestor (itself too) that is
        # a short item; -1 for none. So no word climbs the links by itself.
        n = len(self.len)
        self.top, self.near = [-1] * n, [-1] * n
        for state in sorted(range(1, n), key=self.len.__getitem__):
            if self.len[state] >= window:
                self.top[state] = state if self.len[self.link[state]] < window else self.top[self.link[state]]
            self.near[state] = state if state in self.short else self.near[self.link[state]]

    def _extend(self, last: int, c: int, ends: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q, ends)
        new = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, ends)
        return new

    def _clone(self, p: int, c: int, q: int, ends: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append(set())
        link[q] = copy
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def matches(self, words: list[bytes], short: bool = True) -> tuple[list[tuple[int, int]], set]:
        """Hit stretches [from, to) of word positions in order, joined where they touch, and the items behind them; without
        ``short`` only those of whole windows."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids != 0).view(np.int8), [0]))))
        stretches, seen, ends = [], set(), set()
        for begin, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - begin < self.shortest:
                continue
            state = length = 0
            for i, c in enumerate(ids[begin:end].tolist(), begin + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    length = self.len[state]
                if c in self.next[state]:
                    state = self.next[state][c]
                    length += 1
                hit = 0
                if length >= self.window:
                    hit = self.window
                    seen.add(self.top[state])
                if short and (s := self.near[state]) > 0:
                    if self.len[s] > length:
                        s = self.near[self.link[s]]
                    if s > 0:
                        hit = max(hit, self.len[s])  # the longest; shorter ones inside it follow below
                        ends.add(s)
                if hit:
                    if stretches and i - hit <= stretches[-1][1]:
                        while stretches and i - hit <= stretches[-1][1]:
                            hit = max(hit, i - stretches.pop()[0])
                    stretches.append((i - hit, i))
        items = set().union(*(self.items[s] for s in seen))
        for s in ends:  # a short item and all short items at its end: fewer than ``window``, their lengths differ
            while s > 0:
                items |= self.short[s]
                s = self.near[self.link[s]]
        return stretches, items


def automata(items: DataFrame, window: int) -> tuple[DataFrame, int]:
    """((block, model binary), number of blocks): pickled automata of the items (item_id, text)."""
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    piece = max(PIECE_WORDS, window)

    def cut_up(batches):
        step = piece - window + 1
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch.column("text"))):
                words = words_of(text)
                rows += [(item, b" ".join(words[at : at + piece]), len(words[at : at + piece])) for at in range(0, max(len(words) - window + 1, 1), step) if words]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "words", "n"])

    pieces = stage(sized.mapInArrow(cut_up, "item_id string, words binary, n long").distinct(), "pieces")
    n = math.ceil(pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] / BLOCK_WORDS)

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("item_id").to_pylist(), group.column("words").to_pylist()), key=lambda r: (r[0] or "", r[1]))
        model = pickle.dumps(Automaton([(item, words.split(b" ")) for item, words in rows], window), pickle.HIGHEST_PROTOCOL)
        return pa.table({"block": group.column("block")[:1], "model": pa.array([model], pa.binary())})

    blocks = pieces.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(n, 1))).cast("int"))
    return stage(blocks.groupBy("block").applyInArrow(build, "block int, model binary"), "automata"), n


_loaded: dict[str, Automaton] = {}  # the one automaton that a worker holds


def _automaton(key: str, blob: bytes) -> Automaton:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = pickle.loads(blob)
    return _loaded[key]


_SPAN = pa.struct([("from", pa.int32()), ("to", pa.int32())])
_SPANS = "array<struct<from:int,to:int>>"


def _matched(rows: DataFrame, items: DataFrame, window: int, finish, schema: str) -> DataFrame:
    """What ``finish(batch, words of each row, hits, hits of whole windows, item ids)`` makes of rows (text, more) after
    they met every block of items; between blocks they rest in a staged table with what they hit so far."""
    context, names = rows.sparkSession.sparkContext, rows.columns
    models, n = automata(items, window)
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("hits", _SPANS), ("wholes", _SPANS), ("found", "array<string>"))]
    state = rows.select(*names, *empty)
    for k in range(max(n, 1)):
        one = models.where(F.col("block") == k).select("model").first()  # of bounded size, one at a time
        blob = context.broadcast(one["model"] if one else pickle.dumps(Automaton([], window)))
        name, final = f"{context.applicationId}-{models.staged_path}-{k}", k >= n - 1

        def run(batches, blob=blob, name=name, final=final):
            model = _automaton(name, blob.value)
            for batch in batches:
                texts = [words_of(t or b"") for t in as_bytes(batch.column("text"))]
                before = [[[(s["from"], s["to"]) for s in x or []] for x in batch.column(c).to_pylist()] for c in ("hits", "wholes")]
                hits, wholes, found = [], [], []
                for words, hit, whole, ids in zip(texts, *before, batch.column("found").to_pylist()):
                    more, of = model.matches(words)
                    hits.append(_joined(hit + more))
                    wholes.append(_joined(whole + (model.matches(words, short=False)[0] if more and model.short else more)))
                    found.append(set(ids or []) | of)
                if final:
                    yield finish(batch, texts, hits, wholes, found)
                else:
                    spans = [pa.array([[{"from": a, "to": b} for a, b in x] for x in column], pa.list_(_SPAN)) for column in (hits, wholes)]
                    kept = [batch.column(c) for c in names]
                    yield pa.RecordBatch.from_arrays([*kept, *spans, pa.array([list(x) for x in found], pa.list_(pa.string()))], [*names, "hits", "wholes", "found"])

        state = state.mapInArrow(run, schema) if final else stage(state.mapInArrow(run, state.schema), "met")
    return state


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (array of [from, to) word positions in order), item_ids (sorted).

    A document word is hit if it lies in an occurrence of a window: ``window`` consecutive words of an item, or all of an
    item that has fewer. Null and empty texts have no words and no spans; items without words match nothing; items that
    repeat count once by id; a null item_id counts as no item, its windows still hit. An empty benchmark hits nothing.
    """

    def finish(batch, texts, hits, wholes, found):
        spans = [[{"from": a, "to": b} for a, b in x] for x in hits]
        ids = [sorted(i for i in x if i is not None) for x in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "item_ids"])

    return _matched(id_text(docs), items, window, finish, f"doc_id long, n_words long, spans {_SPANS}, item_ids array<string>")


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them; one space stays where words meet."""
    flat = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flat.view(np.int8), [0]))))
    begins, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : begins[a]].rstrip(b" "))
        at = int(ends[b - 1])
    out.append(text[at:].lstrip(b" ") if out and out[-1] == b"" else text[at:])
    return b"".join(out)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, cut_short: bool = True) -> DataFrame:
    """docs without contaminated spans: all its columns and rows, the hit words cut from ``text``. Rows of which more
    than ``max_coverage`` of the words are hit go whole. Rows without hits pass unchanged, null texts too. Without
    ``cut_short`` hits of items shorter than the window stay in the text, but count for the coverage."""
    names = docs.columns
    others = [c for c in names if c != "text"]

    def finish(batch, texts, hits, wholes, found):
        keep, out = [], []
        for text, words, all_hits, long_hits in zip(as_bytes(batch.column("text")), texts, hits, wholes):
            keep.append(sum(b - a for a, b in all_hits) <= max_coverage * len(words))
            gone = all_hits if cut_short else long_hits
            out.append(cut(text, gone) if gone else text)
        columns = dict(zip(others, batch.column("doc").flatten())) | {"text": pa.array(out, pa.binary()).cast(batch.column("text").type)}
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in others), F.lit(0).alias("more")).alias("doc"), F.col("text"))
    return _matched(rows, items, window, finish, docs.schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item, windows of ten words."""
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, 10 AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT DISTINCT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9),
lengths AS (SELECT DISTINCT k FROM windows),
runs AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
hits AS (SELECT runs.r, runs.k, runs.i, windows.item_id FROM runs JOIN windows ON runs.k = windows.k AND runs.s = windows.s),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""
