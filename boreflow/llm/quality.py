"""Quality rules and an importance score: a hashed n-gram log-likelihood ratio between trusted and raw text.

Words are runs of characters other than ASCII white space.  Word unigrams and bigrams are hashed to ``BUCKETS`` buckets;
two multinomials are counted, one over the trusted documents and one over the whole raw corpus.  A document's score is
the mean of log p_trusted - log p_raw over its n-grams, and it passes at ``THRESHOLD`` or more.  Both the trusted count of
a bucket and the count that the raw corpus lets expect are raised by ``PRIOR``, so that buckets with few counts say
little.  Trusted text scores slightly above zero, junk far below.

Null and empty texts have no words and score 0. Without any trusted document every score is 0, so only the base rules
decide. Repeated rows are judged alike; further columns are kept, and a column that has the name of a result gives way.
Texts of any length are read whole; an empty table gives an empty result. Repeated 3-word windows are told by 64-bit hashes.
Only built-in functions run here.  Both counts cover all their documents; the trusted ids are joined by shuffle at every
size, so that the plan does not turn over where they outgrow a broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.shared import fresh

BUCKETS = 1 << 14
THRESHOLD = -0.06
PRIOR = 20

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _from(c: str, first: int, less: int) -> Column:
    return F.slice(c, F.lit(first), F.greatest(F.size(c) - less, F.lit(0)))


def _ngrams(words: str) -> Column:
    """Buckets of all unigrams and bigrams."""
    of = lambda *w: F.pmod(F.xxhash64(*w), F.lit(BUCKETS)).cast("int")
    single = F.transform(words, lambda w: of(w))
    pairs = F.zip_with(_from(words, 1, 1), _from(words, 2, 1), lambda a, b: of(a, b))
    return F.concat(single, pairs)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the ``BASE`` counts and ``base_failed``: under 50 words, or over half of them in repeated 3-word windows."""
    counted, w = _counted(docs, text)
    return counted.drop(w)


def _counted(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """``base_counts`` with the words themselves, and the name of their column."""
    w, runs, rep, body = fresh(docs, "words", "runs", "repeated", "body")
    own = [c for c in docs.columns if c not in (*BASE, "base_failed")]
    full = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias(body))
    full = full.withColumn(w, words_of(F.col(body)))
    windows = F.transform(
        F.arrays_zip(_from(w, 1, 2).alias("a"), _from(w, 2, 2).alias("b"), _from(w, 3, 2).alias("c")),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")),
    )
    full = full.withColumn(runs, F.sort_array(windows))
    # equal windows are neighbours now; positions of all that have an equal neighbour
    twins = F.zip_with(
        _from(runs, 1, 1), _from(runs, 2, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
    )
    full = full.withColumn(rep, F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    covered = F.aggregate(
        F.zip_with(F.col(rep), _from(rep, 2, 1), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda s, x: s + x,
    )
    lines = F.filter(F.split(F.col(body), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line = fresh(full, "lines")[0]
    full = full.withColumn(line, lines)
    counted = full.select(
        *own,
        w,
        F.size(w).cast("bigint").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("word_chars"),
        (F.length(body) - F.length(F.translate(F.col(body), "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        (F.size(line) - F.size(F.array_distinct(line))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed), w


def ratio_model(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[float]:
    """log p_trusted - log p_raw for each bucket; ``trusted`` has the ids of trusted documents. A fixed-size table."""
    ids = trusted.select(F.col(doc_id).alias("id")).where("id is not null").distinct()
    # texts are shorter than their words, so the words are made after the join
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    rows = rows.join(ids.withColumn("t", F.lit(1)).hint("merge"), "id", "left").select("t", words_of(F.col("body")).alias("w"))
    grams = rows.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(_ngrams("w")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    share = sum(good) / max(1, sum(raw))
    return [math.log((g + PRIOR) / (r * share + PRIOR)) if share else 0.0 for g, r in zip(good, raw, strict=True)]


def judge(docs: DataFrame, model: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base counts, ``base_failed``, ``score`` and ``kept``."""
    counted, w = _counted(docs.drop("score", "kept"), text)
    table = F.from_json(F.lit("[" + ",".join(map(repr, model)) + "]"), "array<double>")
    total = F.aggregate(_ngrams(w), F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
    n = F.greatest(F.lit(1), 2 * F.size(w) - 1)
    scored = counted.withColumn("score", total / n).drop(w)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
