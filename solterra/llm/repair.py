"""Conversation repair by A* on the edit lattice.

Rows are range-partitioned by conversation and turn and cut into segments of at most ``SEGMENT`` rows, so that a conversation
of any length is spread over tasks. For each segment A* finds the cheapest edits from each state of the role pattern before
it to each state after it; the few answers of a conversation's segments are then joined in order, and the repaired rows
are hashed as a stream. A row crosses the network with its text three times, a segment's answers once.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import pickle
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage

SEGMENT, SEGMENT_BYTES = 256, 4 << 20
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; from each, the role initials that may follow. 0 and 3 may end it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}
#: What a row costs at least, by its fault: blank, duplicate, truncated, none.
AT_LEAST = {"b": DELETE, "d": DELETE, "t": min(KEEP + TRUNCATED, DELETE), "-": KEEP}


@lru_cache(1 << 16)
def cheapest(rows: str, entry: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from state ``entry`` to each state after ``rows``, two letters a row: its role's initial (s, u, a
    or another) and its fault. A* over (rows done, state), keyed by cost plus what the rows left must cost, then by
    audit; two audits of one cost and end are never one the start of the other, so the order of starts is that of wholes."""
    n = len(rows) // 2
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + AT_LEAST[rows[2 * i + 1]]
    heap, done, out = [(rest[0], "", 0, entry)], set(), {}
    ends = {0, 2, 3} | ({1} if "s-" in rows or "st" in rows else set()) if entry == 0 else {entry, 2, 3}
    while heap and len(out) < len(ends):
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = key - rest[i]
        if i == n:
            out[state] = cost, audit
        for letter, to in NEXT[state].items():
            if letter in NAMES:
                heapq.heappush(heap, (cost + INSERT + rest[i], audit + "I", i, to))
        if i < n:
            letter, fault = rows[2 * i], rows[2 * i + 1]
            heapq.heappush(heap, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state))
            if fault in "-t":
                cost += TRUNCATED * (fault == "t") + rest[i + 1]
                if letter in NEXT[state]:
                    heapq.heappush(heap, (cost + KEEP, audit + "K", i + 1, NEXT[state][letter]))
                for new in NAMES.keys() & NEXT[state].keys():
                    heapq.heappush(heap, (cost + REROLE, audit + "R", i + 1, NEXT[state][new]))
    return out


def repaired_lines(rows: str, kept: Iterable[dict], audit: str, state: int) -> list[str]:
    """``role:text`` of a segment's rows after the edits; ``kept`` are its rows without blanks and duplicates."""
    out, i, lines = [], 0, iter(kept)
    for edit in audit:
        line = None
        if edit != "I":
            line = next(lines) if rows[2 * i + 1] in "-t" else None
            i += 1
        if edit == "D":
            continue
        letter = rows[2 * i - 2] if edit == "K" else next(x for x in NEXT[state] if x in NAMES)
        out.append(f"{line['role'] if edit == 'K' else NAMES[letter]}:{line['text'] if line else ''}")
        state = NEXT[state][letter]
    return out


def _faults(turns: DataFrame, copies: Column) -> DataFrame:
    """(conv_id, turn, role, text, n, letter, fault, again): equal rows as one of n, and the faults of its first and other copies."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("n"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    said = [F.xxhash64(F.col("conv_id").isNull(), "conv_id", F.length("role"), "role", "text", F.lit(k)).alias(f"h{k}") for k in (1, 2)]
    rows = rows.select("*", F.struct(F.col("turn").isNotNull().alias("known"), "turn").alias("place"), *said)
    first = rows.groupBy("h1", "h2").agg(F.min("place").alias("first"))
    rows = rows.join(first, ["h1", "h2"])
    bare = F.rtrim("text", F.lit(WHITE))
    blank, truncated = bare == "", ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, "b").when(F.col("place") > F.col("first"), "d").when(truncated, "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    return rows.select(
        "conv_id", "turn", "role", "text", "n", F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("letter"), fault.alias("fault"), F.when(blank, "b").otherwise("d").alias("again")
    )


_SEGMENT = "conv_id long, part int, seq int, rows string, turns array<long>, kept array<struct<role:string,text:string>>"


def _segments(faults: DataFrame) -> DataFrame:
    """Runs of at most SEGMENT rows of one conversation, in order by (part, seq); turns are its different turns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, kind = TaskContext.get().partitionId(), itertools.count(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        conv, rows, turns, kept, size = None, [], [], [], 0

        def close():
            columns = [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([next(seq)], pa.int32()), pa.array(["".join(rows)]), pa.array([turns], pa.list_(pa.int64())), pa.array([kept], kind)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seq", "rows", "turns", "kept"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    left, fault = row["n"], row["fault"]
                    while left:
                        if rows and (row["conv_id"] != conv or len(rows) >= SEGMENT or size >= SEGMENT_BYTES):
                            yield close()
                            rows, turns, kept, size = [], [], [], 0
                        conv = row["conv_id"]
                        if row["turn"] is not None and turns[-1:] != [row["turn"]]:
                            turns.append(row["turn"])
                        if fault in "-t":
                            kept.append({"role": row["role"], "text": row["text"]})
                            size += len(row["text"])
                        rows.append(row["letter"] + fault)
                        left, fault = left - 1, row["again"]
        if rows:
            yield close()

    placed = faults.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stage(placed.mapInArrow(cut, _SEGMENT), "segments")


def _solve(segments: DataFrame) -> DataFrame:
    """(conv_id, part, seq, answer): each segment's counts and, by the state before and after it, its cheapest edits."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rows, turns = row["rows"], row["turns"]
                faults, letters = rows[1::2], rows[::2]
                illegal = sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(letters, letters[1:])))
                counts = [faults.count("b"), faults.count("d"), faults.count("t"), illegal]
                out.append(pickle.dumps((counts, letters[0], letters[-1], turns[:1], turns[-1:], len(turns), [cheapest(rows, q) for q in range(4)])))
            yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "part", "seq"]).columns, pa.array(out, pa.binary())], ["conv_id", "part", "seq", "answer"])

    return segments.select("conv_id", "part", "seq", "rows", "turns").mapInArrow(run, "conv_id long, part int, seq int, answer binary")


_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _total(answers: list[tuple]) -> tuple[list, list[tuple[int, str]]]:
    """_TOTALS of a conversation from its segments' answers, and (state before, audit) of each segment."""
    counts, turns, last, end = [0, 0, 0, 0], [], None, None
    best = {0: (0, "", ())}  # state: cost, audit, states before its segments
    for tally, head, tail, low, high, different, moves in answers:
        counts = [a + b for a, b in zip(counts, tally)]
        counts[3] += last is not None and last + head not in ("su", "ua", "au")
        last = tail
        if low:
            turns.append((low[0], high[0], different - (end == low[0])))
            end = high[0]
        after: dict = {}
        for state, (cost, audit, path) in best.items():
            for to, (more, edits) in moves[state].items():
                found = cost + more, audit + edits, (path, state, edits)
                after[to] = min(after.get(to, found), found, key=lambda x: x[:2])
        best = after
    cost, audit, path = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    gaps = turns[-1][1] - turns[0][0] + 1 - sum(t[2] for t in turns) if turns else 0
    pieces = []
    while path:
        path, state, edits = path
        pieces.append((state, edits))
    return [gaps, *counts, cost, audit], pieces[::-1]


def _decide(solved: DataFrame) -> DataFrame:
    """(part, seq, state, edits) of every segment, with _TOTALS on a conversation's last one. A conversation's answers, sixteen
    short strings a segment at most, meet in order in one task."""
    schema = "part int, seq int, state int, edits string, last boolean, " + _TOTALS

    def run(batches):
        def rows():
            for batch in batches:
                yield from batch.to_pylist()

        def told(out):
            return pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()), ("edits", pa.string()), ("last", pa.bool_()), *((c, pa.string() if c == "audit" else pa.int64()) for c in names)]))

        names, out = [x.split()[0] for x in _TOTALS.split(", ")], []
        for _, group in itertools.groupby(rows(), key=lambda r: r["conv_id"]):
            group = list(group)
            totals, pieces = _total([pickle.loads(r["answer"]) for r in group])
            for k, (row, (state, edits)) in enumerate(zip(group, pieces)):
                last = k == len(group) - 1
                out.append({"part": row["part"], "seq": row["seq"], "state": state, "edits": edits, "last": last, **(dict(zip(names, totals)) if last else {})})
            if len(out) >= 1000:
                yield told(out)
                out = []
        yield told(out)

    return solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def _hashes(written: DataFrame) -> DataFrame:
    """A row for each conversation, its repaired text hashed as its segments stream by in order."""
    names = [x.split()[0] for x in _TOTALS.split(", ")]

    def run(batches):
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["piece"] is not None:
                    digest.update((b"\n" if begun else b"") + row["piece"].encode())
                    begun = True
                if row["last"]:
                    out.append({"conv_id": row["conv_id"], **{c: row[c] for c in names}, "repaired_sha256": digest.hexdigest()})
                    digest, begun = hashlib.sha256(), False
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), *((c, pa.string() if c == "audit" else pa.int64()) for c in names), ("repaired_sha256", pa.string())]))

    return written.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, f"conv_id long, {_TOTALS}, repaired_sha256 string")


def repair(turns: DataFrame, copies: Column | None = None, text: bool = False) -> DataFrame:
    """What is wrong with each conversation of turns (conv_id, turn, role, text), the cheapest edits that mend it, and its mended rows.

    Rows are taken by turn, nulls first, then role and text; a null role or text is one space, ``copies`` repeats a row in place.
    A row's first fault counts: blank, duplicate (its role and text stand earlier), truncated (ends without . ! or ?). Edits:
    keep, give it role user or assistant, delete (blanks and duplicates always), insert an empty row; the cheapest that give
    roles of initials (s?(ua)+)? are taken, of equal cost those of the least audit. A null conv_id is a conversation of its own; an empty role has no
    initial and fits nowhere. Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; with
    ``text`` instead (conv_id, part, seq, piece): the repaired rows, newline-joined, piece by piece. No rows give none.
    """
    segments = _segments(_faults(turns, F.lit(1) if copies is None else copies))
    decided = _decide(_solve(segments))

    def write(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lines = [repaired_lines(r["rows"], r["kept"], r["edits"], r["state"]) for r in part.select(["rows", "kept", "edits", "state"]).to_pylist()]
                pieces = pa.array(["\n".join(x) if x else None for x in lines], pa.string())
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pieces], [*keep, "piece"])

    keep = ["conv_id", "part", "seq", "last", *(x.split()[0] for x in _TOTALS.split(", "))]
    written = segments.join(decided, ["part", "seq"]).mapInArrow(write, f"conv_id long, part int, seq int, last boolean, {_TOTALS}, piece string")
    return written.select("conv_id", "part", "seq", "piece") if text else _hashes(written)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """turns with known damage by the checksum of ``conv_id:turn`` (nulls: one space), and how often each row stands."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    lot = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    out = turns.select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(lot == 3, 2).otherwise(1).alias("copies"), lot.alias("lot"),
    )
    return out.where("lot <> 0"), F.col("copies")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; those that lose all rows count nothing."""
    turns = read(spark, sf_dir, "conversations")
    mended = repair(*damaged(turns)).withColumnRenamed("conv_id", "of")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(mended, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
