"""Operators 11 to 13 against plain Python on whole small tables and odd rows; a filter without a fitted model."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from solterra.llm import align, language, linededup, repair, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, h long, chunk long, n long"
#: Columns whose names the operators use inside come with every odd table.
EXTRA = (1, 2, 3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, 0 if v is None else v) for v in t))


def sorted_rows(rows):
    return sorted(rows, key=lambda t: tuple((v is None, 0 if v is None else v) for v in t))


# Operator 11

TEXTS = [
    None, "", " ", "\n", "a", "a ", "a\n", " a", "\na", "a  b", "a\n\nb", "a \nb", "a\n b", "tab\tx", "</s> <s> <unk> <|endoftext|> <0x0A>", "x<|endoftext|>y\nz", "日本語 😀 é x", "▁x a▁b", "x\x00y \x01 z", "﻿bom x",
    "x​y z", "long " * 30_000 + "end", "á ﬁ ①Ａ", "　wide", "don't we'll\nit's 12345 000 $%^&*() \\n", "  ", "a\r\nb\r\n", "  x", "é" * 500, "x y", "\x1cq", "<s>\n</s>", "[INST] ok", "[INST] ok",
]


@cache
def vocabularies():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in shown]
    return a, b, {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(rest)}


def aligned(text):
    """(n_a, n_b, groups, links, digest) by walking both rows of tokens, or None."""
    if not text:
        return None
    a, b, byte_of = vocabularies()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    at, end, links, groups, open_ = [0, 0], [len(parts[0][0]), len(parts[1][0])], [], [], ([], [])
    while at[0] < len(ids[0]):
        links.append((ids[0][at[0]], ids[1][at[1]]))
        closes = [end[0] <= end[1], end[1] <= end[0]]
        for k in (0, 1):
            if closes[k]:
                open_[k].append(ids[k][at[k]])
        if all(closes):
            groups.append("|".join(",".join(map(str, x)) for x in open_))
            open_ = ([], [])
        for k in (0, 1):
            if closes[k]:
                at[k] += 1
                end[k] += len(parts[k][at[k]]) if at[k] < len(ids[k]) else 0
    return len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def all_aligned(rows):
    told = [(i, aligned(t)) for i, t in rows]
    counts, most = Counter(), Counter()
    for _, x in told:
        counts.update(set(x[3]) if x else ())
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    zero = (0,) * 6 + ("",)
    return [(i, *((x[0], x[1], x[2], len(x[3]), sum(counts[k] == most[k[0]] for k in x[3]), sum(counts[k] for k in x[3]), x[4]) if x else zero)) for i, x in told]


def test_alignment_of_the_table_is_that_of_a_walk(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(align.op11_align(spark, SF)) == sorted_rows(all_aligned(rows))


def test_alignment_of_odd_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], ROW)
    wanted = sorted_rows(all_aligned(rows))
    assert rows_of(align.align(docs)) == wanted and sum(r[1] > 0 for r in wanted) > 20
    monkeypatch.setattr(align, "CHUNK_BYTES", 10)
    assert rows_of(align.align(docs)) == wanted
    assert align.align(docs.limit(0)).count() == 0
    assert rows_of(align.align(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# Operator 12


def deduped(rows, window=20):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    return sorted_rows(out)


def odd_documents():
    rng = random.Random(5)
    base = [f"w{rng.randrange(4)}" for _ in range(300)]
    rows = [(None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "long " * 30_000), (5, "long " * 50), (6, " ".join(base)), (7, "x " + " ".join(base[50:120]) + " y"), (8, " ".join(base)), (8, " ".join(base)), (None, " ".join(base[:40]))]
    rows += [(9, "日本 語 é x " * 30), (10, "日本 語 é x " * 30), (11, " ".join(f"k{i % 7}" for i in range(400))), (12, "\x1c".join(base[:30])), (13, "\x1c".join(base[:30]))]
    alone = lambda i, c: " ".join(f"{c}{i}_{j}" for j in range(15))
    return rows + [(100 + i, f"{alone(i, 'u')} {' '.join(base[:60])} {alone(i, 'v')}") for i in range(60)]


@pytest.mark.parametrize("window, gram, bucket", [(20, 8, None), (20, 8, 2), (5, 2, 10)])
def test_substrings_are_brute_force(spark, window, gram, bucket):
    rows = odd_documents()
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], ROW).repartition(3)
    assert rows_of(substrings.dedup(docs, window, gram, bucket)) == deduped(rows, window)
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_substrings_of_the_table(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    wanted = deduped(rows)
    assert rows_of(substrings.op12_substrings(spark, SF)) == wanted and sum(r[2] for r in wanted) > 5000
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted_rows(duckdb.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({substrings.OP12_SQL})").fetchall()) == wanted
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 20_000)  # chunks that see few documents each
    kept = {r.doc_id: r for r in substrings.dedup(spark.read.parquet(f"{SF}/documents.parquet"), text=True).collect()}
    assert sorted_rows((i, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for i, r in kept.items()) == wanted


# Operator 13

NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def cheapest(rows):
    """(cost, audit, [(role or None to keep, row or None)]) by trying all edits, at most three inserted rows at a place."""
    names = {"u": "user", "a": "assistant"}

    @cache
    def go(i, state, run):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []

        def add(cost, edit, what, then):
            if then:
                found.append((cost + then[0], edit + then[1], what + then[2]))

        for letter in NEXT[state].keys() & names.keys() if run < 3 else ():
            add(3, "I", ((names[letter], None),), go(i, NEXT[state][letter], run + 1))
        if i < len(rows):
            letter, fault = rows[i]
            add(4, "D", (), go(i + 1, state, 0))
            if fault in "-t":
                more = 3 * (fault == "t")
                if letter in NEXT[state]:
                    add(more, "K", ((None, i),), go(i + 1, NEXT[state][letter], 0))
                for new in NEXT[state].keys() & names.keys():
                    add(3 + more, "R", ((names[new], i),), go(i + 1, NEXT[state][new], 0))
        return min(found, key=lambda x: x[:2]) if found else None

    return go(0, 0, 0)


def repaired(rows, damage=True):
    shown = lambda v: " " if v is None else str(v)
    conversations = {}
    for conv, turn, role, text in rows:
        mine, lot = conversations.setdefault(conv, []), zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20 if damage else 9
        text = "" if lot == 1 else re.sub("[.!?]", "", shown(text)) if lot == 2 else shown(text)
        mine += [(turn, "user" if lot == 4 else shown(role), text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    out = []
    for conv, mine in conversations.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        letters = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "?" for r in mine]
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(list(zip(letters, faults)))
        body = "\n".join(f"{role or mine[i][1]}:{'' if i is None else mine[i][2]}" for role, i in lines)
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit, hashlib.sha256(body.encode()).hexdigest()))
    return sorted_rows(out)


def test_repair_of_the_table_is_brute_force(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert rows_of(repair.op13_repair(spark, SF)) == repaired(rows)


@pytest.mark.parametrize("segment", [256, 3])
def test_repair_of_odd_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(3)
    pick = rng.choice
    texts = [None, "", " \t", "ok.", "ok", "hm!", "yes?  \n", " ", "x" * 100_000, *(f"text {i}." for i in range(30))]
    rows = [(pick([None, 1, 2, 3, 4, 5, 6, 7, 8]), pick([None, *range(60)]), pick([None, "", "user", "assistant", "system", "tool", "user", "assistant"]), pick(texts)) for _ in range(400)]
    rows += [(50, 0, "user", "same.")] * 200 + [(51, i, "user" if i % 2 == 0 else "assistant", f"t{i}" + "." * (i % 3 > 0)) for i in range(200)] + [(52, -5, "assistant", "hi.")]
    turns = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, n long, part long, rows long")
    assert rows_of(repair.repair(turns)) == repaired(rows, damage=False)
    mended, copies = repair.damaged(turns)
    lost = {r[0] for r in rows} - {r.conv_id for r in mended.collect()}
    assert rows_of(repair.repair(mended, copies)) == [r for r in repaired(rows) if r[0] not in lost]
    pieces = sorted((r.part, r.seq, r.piece) for r in repair.repair(turns, text=True).where("conv_id = 51").collect())
    whole = "\n".join(p for *_, p in pieces if p is not None)
    assert hashlib.sha256(whole.encode()).hexdigest() == next(r[-1] for r in repaired(rows, damage=False) if r[0] == 51)
    assert repair.repair(turns.limit(0)).count() == 0


def test_repair_orders_equal_costs_by_audit():
    assert repair.cheapest("", 0) == {0: (0, ""), 2: (3, "I"), 3: (6, "II")}
    assert repair.cheapest("u-", 0)[3] == (3, "KI") and repair.cheapest("a-", 0)[3] == (3, "IK") and repair.cheapest("s-", 0)[0] == (4, "D")


# Operator 4 as a filter


@pytest.mark.parametrize("labels", [[], [(0, 1), (1, 1), (2, 1)], [(i, 0) for i in range(40)], [(2, 1)]])
def test_no_document_goes_without_a_fitted_curve(spark, labels):
    docs = spark.createDataFrame([(i, f"clean text number {i}") for i in range(40)], "doc_id long, text string")
    assert toxicity.keep_ordinary(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 40


def test_each_trigram_counts_by_itself(spark, monkeypatch):
    monkeypatch.setattr(language, "HELD", 5)  # counts are handed on in the middle of a table
    docs = spark.createDataFrame([("de", "abc  ABC"), ("de", None), (None, "abc"), ("en", "abd\n")], "lang string, text string")
    got = {(r.lang, r.gram.to_bytes(3)): r.n for r in language.text_model(docs).collect()}
    assert got == {("de", b" ab"): 2, ("de", b"abc"): 2, ("de", b"bc "): 2, ("de", b"c a"): 1, ("en", b" ab"): 1, ("en", b"abd"): 1, ("en", b"bd "): 1}


def test_a_text_of_boilerplate_alone_stays_if_asked(spark):
    rows = [(i, f"own words of number {i} that are many more than the rest\nshared line", f"s{i}") for i in range(8)] + [(90, "shared line", "x"), (91, " shared line \n\n", "y"), (92, None, "z"), (93, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.drop_boilerplate(docs, keep_copies=True, keep_last=True).collect()}
    assert got[90] == "shared line" and got[91] == " shared line \n\n" and got[0] == "own words of number 0 that are many more than the rest" and got[92] is None and got[93] == ""
    assert {r.doc_id: r.text for r in linededup.drop_boilerplate(docs, keep_copies=True).collect()}[90] == ""


def test_a_given_layout_holds_at_any_size(spark):
    texts = [" ".join(f"w{k}" for k in range(40)), " ".join(f"w{k}" for k in range(41)), "quite another text of a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    layout = simhash.plan(1 << 30, 0.8)
    assert {r.doc_id: (len(r.fp), r.component_id) for r in simhash.near_duplicates(docs, layout=layout).collect()} == {0: (layout[0], 0), 1: (layout[0], 0), 2: (layout[0], 2)}
