"""Odd inputs, bounds and contracts of operators 1, 5, 6, 7 and 10."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from solterra.llm import decontaminate, embeddings, linededup, reshard, tokenfiles


def test_line_dedup_keeps_columns_of_any_name_and_takes_rows_without_id(spark):
    rows = [(i, f"own {i}\nfoot", f"s{i}", "p", 7, 8, 9) for i in range(6)] + [(None, "x\n foot \ny\nfoot", "t", "p", 7, 8, 9), (None, "foot", "t", "p", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _places string, n_lines long, doc long, `a.b` long")
    got = linededup.drop_boilerplate(docs).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "_places", "doc", "a.b", "n_lines", "n_removed"}
    assert sorted((r.text, r.n_lines, r.n_removed, r.doc, r["a.b"]) for r in got if r.doc_id is None) == [("", 1, 1, 8, 9), ("x\ny", 4, 2, 8, 9)]
    same = linededup.drop_boilerplate(docs, counts=False)
    assert same.columns == docs.columns and {r.n_lines for r in same.collect()} == {7}
    long = spark.createDataFrame([(i, "\n".join(f"a{k}" if k % 2 else f"{i} b{k}" for k in range(20_000)), f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    began = time.time()
    assert {(r.n_lines, r.n_removed) for r in linededup.drop_boilerplate(long).select("n_lines", "n_removed").collect()} == {(20_000, 10_000)}
    assert time.time() - began < 60


def _plan(spark, rows, shards, **more):
    docs = spark.createDataFrame(rows, "doc_id long, old_shard int, size long, text_crc32 long, _key long, _part long, doc long")
    got = reshard.plan(docs, shards, **more).collect()
    assert sorted((r.doc_id, r._key, r._part, r.doc) for r in got) == sorted((r[0], r[4], r[5], r[6]) for r in rows)
    return got


def _moved(got):
    return sum(r["size"] for r in got if r.old_shard != r.shard)


def _totals(got, shards):
    out = [0] * shards
    for r in got:
        out[r.shard] += r["size"]
    return out


def test_reshard_moves_about_what_the_flow_moves_and_keeps_equal_texts_together(spark):
    rng = random.Random(2)
    rows = [(i, i % 6, rng.randint(1, 400), i // 6 % 900 * 6 + i % 6, i, 2 * i, 3 * i) for i in range(12_000)]
    got = _plan(spark, rows, 8)
    held = [sum(r[2] for r in rows if r[1] == k) for k in range(6)]
    least = sum(max(0, h - sum(held) / 8) for h in held)
    assert 0.98 * least <= _moved(got) and _moved(got) < 1.1 * least
    totals = _totals(got, 8)
    assert max(totals) - min(totals) < 0.05 * max(totals)
    homes = {}
    assert all(homes.setdefault((r.old_shard, r.text_crc32), r.shard) == r.shard for r in got)


def test_reshard_spreads_only_a_text_without_room(spark):
    rows = [(i, 0, 10, 5 if i < 700 else 1000 + i, 1, 2, 3) for i in range(1000)] + [(2000 + i, 1, 10, 77, 1, 2, 3) for i in range(120)]
    got = _plan(spark, rows, 4)
    shards = lambda text: {r.shard for r in got if r.text_crc32 == text}
    assert len(shards(5)) > 1 and len(shards(77)) == 1 and all(len(shards(1000 + i)) == 1 for i in range(700, 1000))
    totals = _totals(got, 4)
    assert max(totals) - min(totals) < 0.1 * max(totals)


def test_reshard_of_rows_without_shard_and_of_fewer_shards(spark):
    rows = [(i, None if i % 3 == 0 else i % 5, 0 if i % 50 == 0 else 10, i, 1, 2, 3) for i in range(1000)]
    for shards in (1, 3, 9):
        got = _plan(spark, rows, shards)
        totals = _totals(got, shards)
        assert all(0 <= r.shard < shards for r in got) and max(totals) - min(totals) <= 0.2 * max(totals) + 20
    zeros = _plan(spark, [(i, i, 0, i, 1, 2, 3) for i in range(4)], 2)
    assert {r.shard for r in zeros} == {0, 1}
    weighted = _totals(_plan(spark, rows, 2, weights=[3.0, 1.0]), 2)
    assert 2.5 < weighted[0] / weighted[1] < 3.5


def test_token_files_cut_special_strings_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))
    special = next(iter(t.get_added_tokens_decoder().values())).content
    texts = [f"hi {special} there", special, f"a{special}\nb", "hi  there", "plain words", "", None, "plain words"]
    docs = spark.createDataFrame([(i if i != 6 else None, x) for i, x in enumerate(texts)], "doc_id long, text string")
    tokenfiles.write_tokens(docs, f"file://{tmp_path}/t", files=2)
    got = {r.doc_id: r for r in tokenfiles.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    want = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    assert all(got[i if i != 6 else None].ids == want(x) for i, x in enumerate(texts)) and got[None].start == 0
    at = 1
    for i in (0, 1, 2, 3, 4, 5, 7):  # in ascending order of ids, null first
        assert got[i].start == at
        at += len(got[i].ids)
    assert t.token_to_id(special) in got[0].ids


def test_token_files_have_delta_pages_small_row_groups_and_page_indexes(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["sun", "moon", "sea"]) for _ in range(rng.randint(200, 600)))) for i in range(3000)], "doc_id long, text string")
    tokenfiles.write_tokens(docs, f"file://{tmp_path}/t", files=1)
    [file] = (tmp_path / "t").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = columns["ids.list.element"] if "ids.list.element" in columns else columns["ids.element"]
    assert "DELTA_BINARY_PACKED" in ids.encodings and not ids.has_dictionary_page and ids.has_offset_index and columns["doc_id"].has_column_index
    assert all(meta.row_group(k).total_byte_size <= 17 << 20 for k in range(meta.num_row_groups))
    narrow = tokenfiles.read_tokens(spark, f"file://{tmp_path}/t").select("doc_id", "start")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert all("ids" not in line for line in plan.splitlines() if "ReadSchema" in line)
    few = spark.read.parquet(f"file://{tmp_path}/t").where("doc_id = 1234")
    assert few.count() == 1 and "EqualTo(doc_id,1234)" in few._jdf.queryExecution().executedPlan().toString()


def test_ids_crc32_is_of_the_library_s_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))
    texts = {3: "a b", 1: "", 2: None, 7: "x\ty  z"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in tokenfiles.op6_token_files(spark, f"file://{tmp_path}").collect()}
    for i, x in texts.items():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i].ids_crc32 == zlib.crc32(ids.tobytes()) and got[i].n_tokens == len(ids)


@pytest.mark.parametrize("block, piece", [(100_000, 20_000), (60, 25)])
def test_blocks_and_pieces_change_nothing(spark, monkeypatch, block, piece):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", piece)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh")
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([2, 3, 9, 10, 11, 70])))) for k in range(25)] + [("i0", "z z z"), (None, "q q"), ("n", None)]
    docs = [(k, " ".join(rng.choice([" ".join(word() for _ in range(rng.randint(1, 30))), items[rng.randrange(25)][1], "q q", "z z z"]) for _ in range(4))) for k in range(60)] + [(None, None)]
    split = lambda t: (t or "").split()
    windows = [(i, tuple(w[a : a + min(10, len(w))])) for i, t in items for w in [split(t)] for a in range(max(1, len(w) - 9)) if w]
    wanted = {}
    for k, t in docs:
        w, hit, found = split(t), set(), set()
        for i, x in windows:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    found |= {i} - {None}
        wanted[k] = (len(w), hit, sorted(found))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.automata(bench, 10)[1] == (1 if block > 1000 else decontaminate.automata(bench, 10)[0].count())
    got = decontaminate.contamination(frame, bench).collect()
    assert {r.doc_id: (r.n_words, {p for s in r.spans for p in range(s["from"], s["to"])}, r.item_ids) for r in got} == wanted
    kept = decontaminate.decontaminate(frame.selectExpr("doc_id as hits", "text", "doc_id as doc"), bench, max_coverage=0.6)
    assert kept.columns == ["hits", "text", "doc"] and {r.doc for r in kept.collect()} == {k for k, (n, hit, _) in wanted.items() if len(hit) <= 0.6 * n}


def test_a_repetitive_item_takes_time_in_proportion():
    model = decontaminate.Automaton([("a", [b"x"] * 6000), ("b", [b"x"] * 3)], 10)
    took = []
    for n in (4000, 16_000):
        began = time.perf_counter()
        spans, items = model.matches([b"x"] * n)
        took.append(time.perf_counter() - began)
        assert spans == [(0, n)] and items == {"a", "b"}
    assert took[1] < 12 * took[0] + 0.05


def test_embeddings_of_unequal_length_equal_and_tied_vectors(spark):
    rng = np.random.default_rng(5)
    base = [rng.standard_normal(d).tolist() for d in (2, 3, 4, 8)]
    rows = [(k, 0, base[k % 4]) for k in range(40)] + [(100 + k, k % 2, (rng.standard_normal(8) * 0.02 + base[3]).tolist()) for k in range(30)] + [(200, 0, [])]
    rows += [(300, 0, base[0]), (300, 0, base[0]), (None, 0, base[0])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    vec = {i: (label, v) for i, label, v in rows if i is not None}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, (_, v) in vec.items() if v}
    near = {i: {j for j in unit if j != i and vec[i][0] == vec[j][0] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98} for i in unit} | {200: set()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in near.items()}
    for i in vec:
        seen, front = {i}, [i]
        while front:
            new = near[front.pop()] - seen
            seen |= new
            front += new
        assert got[i].component_id == min(seen) and got[i].kept == (i == min(seen))


def test_embedding_copies_grow_by_the_share_alone_and_recall_holds(spark):
    rng = np.random.default_rng(6)
    half = rng.standard_normal((3000, 32))
    x = np.concatenate([half, half + 0.17 * rng.standard_normal(half.shape)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(u @ u.T >= 0.98, 1)
    frame = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = embeddings.near_duplicates(frame).agg({"n_links": "sum"}).first()[0]
    assert near.sum() > 500 and 0.9 * 2 * near.sum() <= got <= 2 * near.sum()
    vectors = embeddings.usable(frame).withColumn("m", embeddings.F.lit(1).cast("long"))
    copies = embeddings.forest(vectors).count() / (embeddings.TREES * len(x))
    assert copies <= (1 + 2 * embeddings.SPILL + 0.02) ** np.ceil(np.log2(len(x) / embeddings.LEAF) + 1)
