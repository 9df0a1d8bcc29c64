"""Similarity by verified candidates: recall by band of Jaccard similarity, no link below the border, hot buckets, odd rows."""

import math
import random

import pytest

from solterra.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def edited(rng, words, share):
    return " ".join(rng.choice("qwertyuiop") + str(rng.random()) if rng.random() < share else w for w in words)


def corpus(seed, bases, copies, shares):
    rng, texts = random.Random(seed), []
    for _ in range(bases):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 200))]
        texts += [" ".join(words), *(edited(rng, words, rng.choice(shares)) for _ in range(copies))]
    return dict(enumerate(texts))


def brute(texts):
    """(pairs by similarity, components) of all pairs that share a shingle."""
    sets, by = {i: shingles(t) for i, t in texts.items()}, {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, b in enumerate(ids) for a in ids[:k]}
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), j in near.items():
        if j >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return near, {i: root(i) for i in texts}


@pytest.mark.parametrize("bucket, block", [(8, 1024), (1, 16)])
def test_recall_by_band_and_no_link_below_the_border(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = corpus(7, 700, 1, [0.006, 0.012, 0.018, 0.022, 0.024, 0.026]) | {10_000 + i: t for i, t in corpus(8, 2, 60, [0.004, 0.02]).items()}
    near, wanted = brute(texts)
    alone = {(a, b): j for (a, b), j in near.items() if b < 10_000}  # pairs of different texts: each its own trial
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.83), (0.83, 0.86), (0.86, 0.9), (0.9, 1.0)):
        band = [(a, b) for (a, b), j in alone.items() if low <= j < high]
        assert len(band) > 30 and sum(got[a] == got[b] for a, b in band) >= 0.95 * len(band), (low, len(band))
    assert all(wanted[i] == wanted[c] for i, c in got.items())  # nothing joined that links of 0.8 do not join
    assert sum(got[a] == got[b] for a, b in near) >= 0.95 * sum(wanted[a] == wanted[b] for a, b in near)


def test_plan_finds_the_border_at_every_size():
    p = math.acos(1.6 / 1.8) / math.pi
    for e in range(0, 37):
        words, bits, segments, limit = simhash.plan(2**e, 0.8)
        found = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
        assert 1 - (1 - found) ** segments >= simhash.RECALL - 0.005 and 64 * words - segments * bits < bits
        assert limit > 64 * words * p and 2.0**e / 2**bits <= 4
    assert simhash.plan(0, 0.8) == simhash.plan(1, 0.8)


def test_odd_rows_of_similar_texts(spark):
    long = " ".join(f"x{i % 977}y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A b"), (6, "a b c"), (7, long), (8, long + " tail"), (9, "same id one " * 3), (9, "other text of nine here " * 4), (10, "other text of nine here " * 4), (None, "a b"), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key long, node long")
    got = simhash.near_duplicates(docs).collect()
    by = {r.doc_id: r.component_id for r in got if r.doc_id not in (9, None)}
    assert len(got) == len(rows) and by == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 10: 9}
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [4, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def of_values(spark, rows):
    """Nodes of one-word fingerprints: (value of the lowest 16 bits, the other 48)."""
    rows = [(i, [(value | other << 16) - (1 << 64 if other >> 47 else 0)]) for i, (value, other) in enumerate(rows)]
    return spark.createDataFrame(rows, "node long, fp array<long>"), [fp[0] for _, fp in rows]


def test_a_small_bucket_that_a_crowd_looks_up_makes_no_rows_of_pairs(spark):
    for crowd in (300, 600):
        rng = random.Random(crowd)
        nodes, _ = of_values(spark, [(0, rng.getrandbits(48)) for _ in range(20)] + [(1, rng.getrandbits(48)) for _ in range(crowd)])
        pairs, members = simhash.candidates(nodes, 1, 64, 16, 4, 1)
        assert pairs.count() == 0 and members.where("key = 0").count() == crowd + 20
    alone, members = simhash.candidates(nodes.where("node < 21"), 1, 64, 16, 4, 1)
    assert alone.count() == 21 * 20 / 2 and members is None  # no crowd: rows of pairs, each once


def test_links_between_a_crowd_and_a_small_bucket_are_those_of_all_pairs(spark):
    rng, centres = random.Random(3), [random.Random(4).getrandbits(48) for _ in range(12)]
    near = lambda: rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(48), rng.randint(0, 4)))
    nodes, fps = of_values(spark, [(0, near()) for _ in range(20)] + [(1, near()) for _ in range(300)])
    found = simhash.links(nodes, 1, 3, 16, 4, 1)
    assert all(((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 3 for a, b in found.select("a", "b").collect())
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if ((a ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    got = {r.node: r.component for r in simhash.connected_components(found).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == [root(i) for i in range(len(fps))]


def test_a_short_fingerprint_travels_whole(spark):
    nodes = lambda words: spark.createDataFrame([(i, [7] * (words - 1) + [2**i - 1]) for i in range(20)], "node long, fp array<long>")
    for words, joined in ((3, False), (4, True)):
        pairs, members = simhash.candidates(nodes(words), words, 5, 16, 4 * words, 1)
        assert members is None and ("fp_a" in pairs._jdf.queryExecution().optimizedPlan().toString()) == joined
        assert sorted((min(p), max(p)) for p in pairs.distinct().collect()) == [(a, b) for a in range(20) for b in range(a + 1, min(20, a + 6))]


def test_long_fingerprints_meet_by_halves_and_only_close_pairs_become_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 100)
    rng, words, bits, segments, limit = random.Random(5), *simhash.plan(1 << 21, 0.8)
    noisy = lambda f, share: f ^ sum(1 << b for b in range(64 * words) if rng.random() < share)
    bases = [rng.getrandbits(64 * words) for _ in range(150)]
    fps = bases + [noisy(rng.choice(bases), rng.choice([0.01, 0.08, 0.15])) for _ in range(150)] + [noisy(bases[0], rng.choice([0.005, 0.03])) for _ in range(150)]
    signed = lambda f: [(f >> 64 * w & (1 << 64) - 1) - (1 << 64 if f >> 64 * w + 63 & 1 else 0) for w in range(words)]
    nodes = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "node long, fp array<long>")
    pairs, members = simhash.proposed(nodes, words, limit, bits, segments)
    got = [tuple(sorted(r)) for r in pairs.collect()]
    values = [[f >> s * bits & (1 << bits) - 1 for s in range(segments)] for f in fps]
    sizes, keys = {}, {}
    for v in values:
        for k in enumerate(v):
            sizes[k] = sizes.get(k, 0) + 1
    for key, node in members.collect():
        assert key not in keys.setdefault(node, set())
        keys[node].add(key)
    met = set()  # close pairs of which neither value is crowded in the first segment that they share
    for i, j in ((i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= limit):
        for k, (x, y) in enumerate(zip(values[i], values[j])):
            if (x ^ y).bit_count() <= 1:
                if max(sizes[k, x], sizes[k, y]) <= simhash.BUCKET:
                    met.add((i, j))
                else:  # all others are members of one crowded bucket
                    assert keys[i] & keys[j]
                break
    assert len(got) == len(met) > 100 and set(got) == met and keys
    rows = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [spot" in rows and "Join" not in rows  # two rows a segment travel, no pair before it is close


def test_more_documents_than_short_fingerprints_serve_make_no_rows_of_chance_pairs(spark, monkeypatch):
    def never(*_):
        raise AssertionError("values around each value are not to travel")

    monkeypatch.setattr(simhash, "_probes", never)
    texts = corpus(9, 60, 1, [0.004])
    got = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), layout=simhash.plan(1 << 21, 0.8))
    near, wanted = brute(texts)
    assert all(wanted[r.doc_id] == wanted[r.component_id] for r in got.collect()) and any(j >= 0.8 for j in near.values())
