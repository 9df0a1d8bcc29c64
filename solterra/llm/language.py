"""Language of web pages by Bayesian evidence fusion.

Text likelihoods come from byte trigrams counted over all documents by their language. Pages add what they declare in
their markup, the suffix of their address and their host. What a declaration or a suffix says about a language, and
the priors of hosts, are grouped aggregates of the text posteriors of all pages; a host's prior is smoothed by that of its domain,
a domain's by that of all pages. A page's own posterior is taken out of every aggregate it meets.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, read, stage

#: Trigrams of a page that count in full, smoothing; trigrams that a task counts at a time.
FULL, SMOOTH, HELD = 60, 2.0, 1 << 22

_MARKUP = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", re.S | re.I)


def trigrams(text: bytes) -> np.ndarray:
    """The byte trigrams of the text in lower case, white space as one space, as whole numbers."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.int32)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


def text_model(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): trigram counts of all documents (lang, text) by language; null languages and texts add nothing. There are
    2^24 trigrams a language at most, each counted by itself."""

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def told():
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
                for at in range(0, len(text), 1 << 20):
                    held.setdefault(lang, []).append(trigrams(text[at : at + (1 << 20)]))
                    size += len(held[lang][-1])
                    if size >= HELD:
                        yield from told()
                        held, size = {}, 0
        yield from told()

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    return rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _log_table(model: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, their trigrams in order, logarithms by language and trigram, the last for trigrams that no language has)."""
    rows = model.toArrow()  # at most 2^24 rows a language
    if not rows.num_rows:
        return [], np.zeros(0, np.int32), np.zeros((0, 1), np.float32)
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    grams, at = np.unique(np.asarray(rows.column("gram")), return_inverse=True)
    counts = np.zeros((len(langs), len(grams) + 1))
    counts[np.array([langs.index(x) for x in names])[np.asarray(coded.indices)], at] = np.asarray(rows.column("n"))
    return langs, grams, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])).astype(np.float32)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, confidence, text_lang, declared, suffix, host) for every row of pages (page_id, url, html).

    Null or empty html has even text evidence; a null url has no host and no suffix, and such evidence is left out; a page
    that declares nothing, or no language code, counts as declaring none. Ties go to the first language in alphabetical order. Without labelled documents
    lang is null. Repeated rows stay; an empty table gives no rows.
    """
    langs, *table = _log_table(text_model(docs))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    code = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1))
    rows = pages.select("page_id", host.alias("host"), F.nullif(F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), code), F.lit("")).alias("suffix"), declared.alias("declared"), F.coalesce("html", F.lit("")).alias("html"))
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"), "declared", "suffix", "host")
    model = pages.sparkSession.sparkContext.broadcast(table)

    def weigh(batches):
        known, logs = model.value
        for batch in batches:
            scores = np.zeros((batch.num_rows, len(langs)))
            for k, html in enumerate(as_bytes(batch.column("html"))):
                grams = trigrams(_MARKUP.sub(b" ", html))
                if len(grams) > 1:
                    at = np.searchsorted(known, grams)
                    at[known[np.minimum(at, len(known) - 1)] != grams] = len(known)
                    scores[k] = logs[:, at].sum(axis=1, dtype=float) * min(1.0, FULL / len(grams))
            scores -= np.logaddexp.reduce(scores, axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, len(langs), dtype=np.int32)), pa.array(scores.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "suffix", "declared")), lists], ["page_id", "host", "suffix", "declared", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = stage(rows.mapInArrow(weigh, f"page_id {kind}, host string, suffix string, declared string, text array<double>"), "scored")
    scored = scored.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    n = len(langs)
    p = [F.exp(F.col("text")[i]) for i in range(n)]
    whole = scored.agg(*(F.sum(x).alias(f"t{i}") for i, x in enumerate(p))).first()
    total = [whole[f"t{i}"] or 0.0 for i in range(n)]
    everyone = [(t + 1.0) / (sum(total) + n) for t in total]
    out = scored
    for by in ("declared", "suffix", "domain", "host"):
        sums = scored.where(F.col(by).isNotNull()).groupBy(F.col(by).alias(f"_{by}")).agg(*(F.sum(x).alias(f"{by}{i}") for i, x in enumerate(p)))
        out = out.join(sums, F.col(by) == F.col(f"_{by}"), "left")

    def others(by, i):  # of the other pages
        return F.greatest(F.coalesce(F.col(f"{by}{i}"), p[i]) - p[i], F.lit(0.0))

    def all_others(by):
        return sum((others(by, j) for j in range(n)), F.lit(0.0))

    scores = []
    for i in range(n):
        domain = (others("domain", i) + SMOOTH * everyone[i]) / (all_others("domain") + SMOOTH)
        prior = (others("host", i) + SMOOTH * domain) / (all_others("host") + SMOOTH)
        said = [(others(by, i) + SMOOTH * everyone[i]) / (F.greatest(F.lit(total[i]) - p[i], F.lit(0.0)) + SMOOTH) for by in ("declared", "suffix")]
        likely = [F.when(F.col("_suffix").isNull(), 0.0).otherwise(F.log(said[1])), F.log(said[0])]
        scores.append(F.col("text")[i] + F.log(prior) + likely[0] + likely[1])
    out = out.withColumn("scores", F.array(*scores)).withColumn("best", F.array_max("scores"))
    names = F.array(*(F.lit(x) for x in langs))
    weight = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    return out.select(
        "page_id", F.element_at(names, F.array_position("scores", F.col("best")).cast("int")).alias("lang"), (1 / weight).alias("confidence"),
        F.element_at(names, F.array_position("text", F.array_max("text")).cast("int")).alias("text_lang"), "declared", "suffix", "host",
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, with trigrams of every document."""
    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))
