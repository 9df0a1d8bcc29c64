"""Small cases of every operator: brute force, round trips, nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from solterra.llm import bpe, chat, components, decontaminate, embeddings, language, linededup, reshard, simhash, tokenfiles, toxicity
from solterra.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
EXTRA = ", h1 long, _id long, key long, node long"
ODD = [None, "", "a b c", "a b c", "long " * 30_000, "  tab\t x\n\n y ", "日本語 😀 é"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", "en", 0, 1, 2, 3, 4) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, 1, 2, 3, 4), (2, "a b c", "s", "en", 0, 1, 2, 3, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long" + EXTRA)


def tables():
    for name in ("documents", "benchmark", "conversations"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS FROM '{SF}/{name}.parquet'")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    tables()
    wanted = duckdb.sql(SQL[name])
    columns = list(wanted.columns)
    assert sorted(tuple(str(r[c]) for c in columns) for r in QUERIES[name](spark, SF).collect()) == sorted(tuple(map(str, r)) for r in wanted.fetchall())


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [64, 1])
def test_simhash_is_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    wanted = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", wanted[i]) for i in fps}


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd, shingle_words=3, max_bits=2, distinct=False).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (2, 3)} == {2} and {r.component_id for r in rows if r.doc_id in (0, 1)} == {0}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_chains_stars_and_nulls(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (1, 2)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}}


def test_line_dedup_near_and_far_from_the_threshold(spark):
    rows = [(i, f"own {i}\nfour\nfive \n\nmany" if i < 4 else f"own {i}\nfive\nmany" if i == 4 else f"own {i}\n many", f"s{i}", 1) for i in range(40)] + [(90, None, "x", 1), (91, "many", None, 1), (91, "many", None, 1)]
    got = linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, h1 long")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[0].text == "own 0\nfour\n" and by[4].text == "own 4" and by[9].n_removed == 1
    assert by[90].text is None and by[91].text == ""
    assert linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, h1 long").limit(0)).count() == 0


def test_chat_tree_ranks_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0, 9), (1, 2, 1, "assistant", "a <|end|> \\ |", 1.0, 9), (1, 3, 1, "assistant", "b", 2.0, 9), (1, 4, 2, "user", None, None, 9), (2, 5, 6, "user", "x", 0.0, 9), (2, 6, 5, "user", "y", 0.0, 9)]
    tree = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double, up long")
    out = chat.format_paths(chat.paths(tree)).withColumn("turns", chat.parse(chat.F.col("formatted"))).orderBy("rank").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in out] == [[("user", "q"), ("assistant", "b")], [("user", "q"), ("assistant", "a <|end|> \\ |"), ("user", "")]]
    assert [r.formatted[s.start : s.start + s.length] for r in out for s in r.loss] == ["b", "a <\\|end|> \\\\ |"]
    assert [r.leaf for r in chat.paths(tree, 1).select("leaf").distinct().collect()] == [3]
    assert chat.format_paths(chat.paths(tree.limit(0))).count() == 0


def test_chat_long_chain(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(300)] + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    row = chat.format_paths(chat.paths(chat.linear(turns))).select(chat.parse(chat.F.col("formatted")).alias("t")).collect()
    assert len(row) == 1 and [t.text for t in row[0].t] == [f"t{i}" for i in range(300)]


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice("sun moon river stone cloud grass winter summer".split()) for _ in range(30)]
        if toxic := i % 4 == 0:
            words[3] = words[9] = rng.choice(["scumbag", "scumbags", "scumbagly"])
        rows.append((i, " ".join(words), 5))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame([*rows, (None, None, 5), (5000, "", 5)], "doc_id long, text string, score long"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert len(got) == 1502 and {r.doc_id for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), marks).count() == 0 and {r.score for r in toxicity.score(docs, marks.limit(0)).collect()} == {0.0}


def test_reshard_balances_and_numbers(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = reshard.op5_reshard(spark, SF).collect()
    sizes, slots, shard_of = {}, {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard_of.setdefault(r.text_crc32, r.shard) == r.shard
    assert len(got) == len(rows) and sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.15 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert reshard.transfers([10, 0, 5], [5, 5, 5]) == {(0, 0): 5, (0, 1): 5, (2, 2): 5}
    hot = spark.createDataFrame([(i, 0, 10, 1 if i < 600 else i, 7) for i in range(1000)], "doc_id long, old_shard int, size long, text_crc32 long, _key long")
    assert len({r.shard for r in reshard.plan(hot, 4).collect()}) == 4
    assert reshard.plan(hot.limit(0), 4).count() == 0


def test_token_files_are_the_library_s(spark, odd, tmp_path):
    tokenfiles.write_tokens(odd, f"file://{tmp_path}/t", files=3)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))
    got = tokenfiles.read_tokens(spark, f"file://{tmp_path}/t").collect()
    assert sorted(r.ids for r in got) == sorted([*t.encode(x or "", add_special_tokens=False).ids, 0] for x in [*ODD, "no id", "a b c"])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)


def test_bpe_round_trip(spark, odd):
    coder = bpe._coder(bpe.ranks_path())
    rng = random.Random(3)
    texts = [*ODD, *("".join(rng.choice("ab  \n.'s1é😀\t") for _ in range(rng.randint(0, 30))) for _ in range(500))]
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(odd).count() == odd.count() and bpe.round_trip(odd.limit(0)).count() == 0
    assert sorted(bytes(r.bytes).decode() for r in bpe.decode(bpe.encode(odd)).collect()) == sorted([*(t or "" for t in ODD), "no id", "a b c"])


def test_decontaminate_cuts_spans(spark, odd):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("i", item), ("short", "red blue"), ("none", None), ("none", "!!")], "item_id string, text string")
    text = f"Start here. {item.upper()}, and red, blue end"
    docs = spark.createDataFrame([(1, text), (2, "one two three"), (3, item), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert [tuple(s) for s in got[1].spans] == [(2, 13), (14, 16)] and got[1].item_ids == ["i", "short"] and not got[2].spans and not got[4].spans
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {2, 4}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, max_coverage=0.9).collect()}[1] == "Start here., and end"
    assert decontaminate.contamination(odd, items.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.decontaminate(odd, items).count() == odd.count() and decontaminate.decontaminate(odd.limit(0), items).count() == 0


def test_automaton_is_brute_force():
    rng = random.Random(5)
    items = [(k, [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))]) for k in range(12)]
    model = decontaminate.Automaton(items, 4)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 30))]
        hit, found = set(), set()
        for k, item in items:
            n = min(4, len(item))
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(k)
        spans, ids = model.matches(words)
        assert {p for a, b in spans for p in range(a, b)} == hit and ids == found


def test_language_of_pages(spark):
    got = language.op8_language(spark, SF).collect()
    assert np.mean([f"/{r.lang}" == f"/{r.suffix.split('/')[1]}" for r in got]) > 0.95
    docs = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "x"), ("en", None)], "lang string, text string")
    pages = spark.createDataFrame([(1, None, None, 0), (2, "http://a.example.de/x", "<html lang='DE'>der hund und", 0), (2, "http://a.example.de/x", "<html lang='DE'>der hund und", 0)], "page_id long, url string, html string, text long")
    rows = language.identify(pages, docs).collect()
    assert len(rows) == 3 and {r.lang for r in rows if r.page_id == 2} == {"de"}
    assert language.identify(pages.limit(0), docs).count() == 0 and language.identify(pages, docs.limit(0)).where("lang is null").count() == 3


@pytest.mark.parametrize("leaf", [256, 16])
def test_embeddings_recall_and_odd_vectors(spark, monkeypatch, leaf):
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base + 0.02 * rng.standard_normal(base.shape) for _ in range(6)])
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(900, 0, None), (901, 0, [0.0] * 16), (902, None, x[0].tolist()), (903, 0, [None] + [1.0] * 15), (904, 1, [float("nan")] * 16), (0, 0, x[0].tolist())]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.arange(360)[:, None] % 2 == np.arange(360) % 2) & ~np.eye(360, dtype=bool)
    assert len(got) == 365 and all(got[k].n_links == 0 and got[k].kept for k in (900, 901, 902, 903, 904))
    assert sum(got[i].n_links for i in range(360)) >= 0.98 * near.sum() > 0 and all(got[i].n_links <= near[i].sum() for i in range(360))
    assert embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_odd_rows(spark, odd):
    docs = odd
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == odd.columns, name
        assert corpus_pipeline.STAGES and step(spark, odd.limit(0), SF).count() == 0
    assert {r.text for r in docs.collect()} >= {"no id", "日本語 😀 é"}
    assert corpus_pipeline.run(spark, SF).count() > 100
