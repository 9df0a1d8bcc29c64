"""Cases in which the code once did less than the whole job."""

import random
import zlib

import corpus_pipeline
from solterra.llm import linededup, reshard, toxicity

COLUMNS = "doc_id long, text string, source string"


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_pipeline_keeps_one_of_copies_on_many_sites(spark, tmp_path):
    body = [words(f"line{k}w", 12) for k in range(10)]
    exact = [(i, "\n".join(body), f"s{i}") for i in range(8)]
    near = [(100 + i, "\n".join(words(f"near{k}w", 12) if k != i else words(f"edit{i}w", 12) for k in range(30)), f"s{i}") for i in range(8)]
    site = [(200 + i, f"{words(f'own{i}w', 30)}\nshared footer of many sites", f"s{i}") for i in range(8)]
    empty = [(300, "", "a"), (301, " \n ", "b"), (302, None, "c")]
    docs = spark.createDataFrame([*exact, *near, *site, *empty], COLUMNS)
    lines = corpus_pipeline.drop_lines(spark, docs, "")
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert all(texts[i] == t for i, t, _ in exact + near + empty) and all(texts[200 + i] == words(f"own{i}w", 30) for i in range(8))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, lines, "").collect()} == {0, 100, *range(200, 208), 300, 301, 302}
    assert {r.n_removed for r in linededup.drop_boilerplate(docs.where("doc_id < 100")).collect()} == {10}


def test_pipeline_cuts_no_items_shorter_than_ten_words(spark, tmp_path):
    item = words("item", 12)
    spark.createDataFrame([("a", "of the"), ("b", item), ("c", words("nine", 9))], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean, mixed = f"one of the {words('own', 20)} of the end", f"{words('own', 30)} {item} of the end of the day"
    docs = spark.createDataFrame([(1, clean, "s"), (2, mixed, "s"), (3, f"now {words('nine', 9)}", "s")], COLUMNS)
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_benchmark(spark, docs, f"file://{tmp_path}").collect()}
    assert got == {1: clean, 2: f"{words('own', 30)} of the end of the day"}


def test_reshard_writes_every_text_of_the_shards_it_changes(spark, tmp_path, monkeypatch):
    rows = [(None if i % 7 == 0 else i // 3, None if i % 50 == 0 else words(f"t{i}w", i % 20)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    written, real = [], reshard.rewrite
    monkeypatch.setattr(reshard, "rewrite", lambda placed, out: written.append((out, changed := real(placed, out))) or changed)
    got = reshard.op5_reshard(spark, f"file://{tmp_path}").collect()
    [(out, changed)] = written
    files = [(r.doc_id, r.text) for r in spark.read.parquet(out).collect()]
    assert changed == list(range(8)) and sorted(files, key=str) == sorted(rows, key=str)
    assert len(got) == 400 and sorted(r["size"] for r in got) == sorted(len(t or "") + 1 for _, t in rows) and len({(r.shard, r.slot) for r in got}) == 400


def test_toxicity_knows_each_n_gram_by_itself_and_counts_what_the_curve_leaves(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLOTS", 7, raising=False)  # once the places of a table that n-grams shared
    monkeypatch.setattr(toxicity, "CURVE_ROWS", 100)
    held, real = [], toxicity._tallies
    monkeypatch.setattr(toxicity, "_tallies", lambda table, known: held.append(real(table, known)) or held[-1])
    rng, rows = random.Random(1), []
    for i in range(1500):
        text = ["every", *(rng.choice("sun moon river stone cloud grass winter summer".split()) for _ in range(30))]
        rows.append((i, " ".join([*text, *["scumbag"] * 2] if i % 4 == 0 else text), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(docs.drop("toxic"), docs.drop("text")).where("held_out").collect()
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got) > 0.97 * len(got) > 0
    counts = {bytes(r.word): r.toxic + r.ordinary for r in held[0].collect()}
    assert counts[b"every"] == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(1500)) - 100
