"""The learned operators against models counted in plain Python: Kneser-Ney evidence (4), Bayesian fusion (8)."""

import math
import random
from collections import Counter, defaultdict

import pytest

from solterra.llm import language, toxicity
from solterra.llm.chunks import chunk_table
from solterra.llm.common import stage
from solterra.llm.decontaminate import words_of


def grams(word):
    data = b"\x02" * 4 + word + b"\x03"
    return [data[i : i + 5] for i in range(len(data) - 4)]


def kneser_ney(texts, label):
    """{5-gram: difference of the classes' log-probabilities of its last byte} by the definition, over documents' distinct words."""
    counts = {k: Counter() for k in (1, 0)}
    kinds = set()
    for i, t in texts.items():
        for w in set(words_of(t.encode())):
            kinds.update(grams(w))
            if i in label:
                counts[label[i]].update(grams(w))
    types = {5: {g: None for g in kinds}}
    for k in (4, 3, 2, 1):  # how many different longer ones end in it
        types[k] = Counter(g[-k:] for g in types[k + 1])
    p = {g: (n + 1) / (len(types[2]) + 256) for g, n in types[1].items()}
    for k in (2, 3, 4):
        after = defaultdict(list)
        for g, n in types[k].items():
            after[g[:-1]].append(n)
        p = {g: (n - 0.75 + 0.75 * len(after[g[:-1]]) * p[g[1:]]) / sum(after[g[:-1]]) for g, n in types[k].items()}
    context = {k: defaultdict(list) for k in (1, 0)}
    for k in (1, 0):
        for g, n in counts[k].items():
            context[k][g[:-1]].append(n)

    def of(k, g):
        seen = context[k].get(g[:-1])
        return p[g[1:]] if not seen else (max(counts[k][g] - 0.75, 0) + 0.75 * len(seen) * p[g[1:]]) / sum(seen)

    return {g: math.log(of(1, g) / of(0, g)) for g in kinds}


def test_evidence_is_kneser_ney_by_the_definition(spark):
    rng = random.Random(3)
    texts = {i: " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 12))) for i in range(50)}
    label = {i: i % 3 == 0 for i in range(50) if i % 7}
    label = {i: int(x) for i, x in label.items()}
    table = chunk_table(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words_of, bags=True)
    known = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    tallies = stage(toxicity._tallies(table, known), "tallies")
    got = {r.gram.to_bytes(5, "big"): r.value for r in toxicity.gram_evidence(tallies).collect()}
    wanted = kneser_ney(texts, label)
    assert len(wanted) > 300 and got.keys() <= wanted.keys()
    assert all(got.get(g, 0.0) == pytest.approx(v, abs=1e-9) for g, v in wanted.items())
    evidence = {r.doc_id: r for r in toxicity._evidence(table, tallies).collect()}
    for i, t in texts.items():
        uses = Counter(words_of(t.encode()))
        value = {w: sum(wanted[g] for g in grams(w)) for w in uses}
        assert evidence[i].by_word == pytest.approx(sum(n * value[w] for w, n in uses.items()) / max(sum(uses.values()), 1), abs=1e-5)
        assert evidence[i].by_kind == pytest.approx(sum(value.values()) / math.sqrt(max(len(uses), 1)), abs=1e-5)


def test_labels_both_ways_count_as_toxic_and_held_out_labels_are_not_read(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["sun", "moon"] + [rng.choice(["scum", "rose"]) for _ in range(1)] * 3)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = {i: int("scum" in t) for i, t in rows}
    labels = spark.createDataFrame([(i, x) for i, x in truth.items()] + [(i, 0) for i, x in truth.items() if x], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.predicted == truth[i] for i, r in got.items())
    lied = spark.createDataFrame([(i, 1 - x if got[i].held_out else x) for i, x in truth.items()], "doc_id long, toxic int")
    assert {r.doc_id: round(r.score, 9) for r in toxicity.score(docs, lied).collect()} == {r.doc_id: round(r.score, 9) for r in toxicity.score(docs, labels.where("toxic = 1").unionByName(labels.where("toxic = 0")).groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "toxic")).collect()}


def test_fusion_is_bayes_by_hand(spark):
    docs = [("de", "der hund und die katze und der hund"), ("en", "the dog and the cat and the dog"), ("fr", "le chien et le chat et le chien")]
    pages = [
        (1, "http://a.x.de/", "<html lang='de'><p>der hund und die katze"), (2, "http://a.x.de/q", "<html lang=de>und die"), (3, "http://b.x.de/", "<html>the dog"), (4, "http://y.com/en/", "the cat and"),
        (5, "http://y.com/fr/", "<html lang='fr'>le chat"), (6, None, None), (7, "http://a.x.de/z", "the dog and the cat and the dog"), (8, "no url", "le chien"),
    ]
    rows = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "lang string, text string")).collect()
    langs = ["de", "en", "fr"]

    def grams(t):
        return language.trigrams(t.encode()).tolist()

    counts = {k: Counter(grams(t)) for k, t in docs}
    kinds = len(set().union(*counts.values())) + 1  # and one for all that none has
    log = lambda k, s: math.log((counts[k][s] + 0.5) / (sum(counts[k].values()) + 0.5 * kinds))
    text = {}
    for i, _, html in pages:
        got = grams(language._MARKUP.sub(b" ", (html or "").encode()).decode())
        raw = [sum(log(k, s) for s in got) * min(1.0, language.FULL / len(got)) if len(got) > 1 else 0.0 for k in langs]
        norm = math.log(sum(math.exp(x - max(raw)) for x in raw)) + max(raw)
        text[i] = [math.exp(x - norm) for x in raw]
    tags = {r.page_id: {"declared": r.declared, "suffix": r.suffix or None, "host": r.host, "domain": r.host and ".".join(r.host.split(".")[-2:])} for r in rows}
    total = [sum(p[j] for p in text.values()) for j in range(3)]
    everyone = [(t + 1) / (sum(total) + 3) for t in total]
    for r in rows:
        i = r.page_id

        def others(by, j):
            return sum(p[j] for k, p in text.items() if k != i and tags[k][by] == tags[i][by]) if tags[i][by] is not None else 0.0

        score = []
        for j in range(3):
            domain = (others("domain", j) + 2 * everyone[j]) / (sum(others("domain", k) for k in range(3)) + 2)
            prior = (others("host", j) + 2 * domain) / (sum(others("host", k) for k in range(3)) + 2)
            said = lambda by: (others(by, j) + 2 * everyone[j]) / (total[j] - text[i][j] + 2)  # noqa: B023, E731
            score.append(math.log(text[i][j]) + math.log(prior) + math.log(said("declared")) + (math.log(said("suffix")) if tags[i]["suffix"] is not None else 0.0))
        best = max(score)
        assert r.lang == langs[score.index(best)] and r.confidence == pytest.approx(1 / sum(math.exp(s - best) for s in score), rel=1e-4), i
