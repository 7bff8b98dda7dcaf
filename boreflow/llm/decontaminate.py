"""Benchmark decontamination with a positional inverted index.

A test item is cut to windows of ``WINDOW`` consecutive words (a shorter item is one window).  Term counts over all
training text tell the rarest and the second rarest term of each window.  The index holds the training postings of those
terms, (term, doc_id, version, pos); those of rarest terms keep the words around them.  An exact phrase is found by
intersecting the stored list of the rarest term, shifted by the distance of both in the window, with the stored list of the
second rarest; what is left is confirmed word by word on the words kept in the posting, so that the matched run of words is
known without reading the text again.  A proximity match is an item one of whose windows has its two rarest terms within a
given distance, at any offset: the same two lists, joined by cells of positions.

Null texts and items have no words: such documents have no hits, such items no windows. Items without an id are found like
others, but have no name to give. Repeated document rows are all returned; rows that share an id but not a text are judged
apart. Items that share an id count once. Texts of any length are read whole. Further columns are ignored, whatever their
names. Empty tables give empty results, or documents without hits.  Only built-in functions run here.  Test terms are broadcast
in blocks of ``BLOCK`` rows, each against all documents, so any number of items works; all intersections are semi joins, so
repeated rows multiply nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.shared import Scratch, lower_ascii

WINDOW = 10
#: Rows of test terms (under 1 kB each) that are broadcast at once.
BLOCK = 20_000
#: Window starts of one stretch of a test item; a word carries its stretch along, not its item.
STRETCH = 64


def words_of(text: Column) -> Column:
    """Lower-case runs of digits, letters and everything beyond ASCII."""
    lowered = lower_ascii(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _blocks(table: DataFrame, key: str) -> list[DataFrame]:
    n = -(-table.count() // BLOCK)
    return [table.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [table]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, version, words, n_words); version tells apart texts that share an id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), words_of(F.col(text)).alias("words"))
    return rows.withColumn("n_words", F.size("words").cast("bigint"))


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w"))
    return items.where(F.size("w") > 0).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows (term, n): how often each of ``terms`` stands in all training text."""
    tokens = docs.select(F.explode("words").alias("term"))
    return _all([tokens.join(F.broadcast(t), "term").groupBy("term").agg(F.count("*").alias("n")) for t in _blocks(terms, "term")])


def stretches(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Items cut so that each window lies in one piece of at most ``STRETCH + window - 1`` words; shorter items stay whole."""
    last = F.floor(F.greatest(F.size("w") - window, F.lit(0)) / STRETCH).cast("int")
    piece = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(F.col("w"), k * STRETCH + 1, STRETCH + window - 1))
    return items.select("item_id", F.explode(piece).alias("w")).distinct()


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rarest and second rarest term of each window: (term, delta, second) and the item around the term.

    ``before`` and ``after`` hold up to window - 1 item words next to the term, nearest first, as far as the window's stretch
    goes; ``least`` is the length of the item's windows.
    """
    pieces = stretches(items, window)
    at = pieces.select("item_id", "w", F.posexplode("w").alias("i", "term")).join(counts, "term", "left")
    ranked = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "i")
    lists = at.groupBy("item_id", "w").agg(F.collect_list(F.struct("i", ranked.alias("r"))).alias("rs"))
    lists = lists.withColumn("rs", F.transform(F.sort_array("rs"), lambda x: x["r"]))
    lists = lists.withColumn("least", F.least(F.lit(window), F.size("w")))
    starts = lists.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("least"))).alias("s"))
    best = F.sort_array(F.slice("rs", F.col("s") + 1, F.col("least")))
    picked = starts.withColumn("best", best).where("best[0].n > 0")
    picked = picked.select(
        "item_id", "w", "least", F.col("best")[0]["i"].alias("a"), F.col("best")[0]["term"].alias("term"),
        (F.try_element_at("best", F.lit(2))["i"] - F.col("best")[0]["i"]).alias("delta"),
        F.try_element_at("best", F.lit(2))["term"].alias("second"),
    ).distinct()
    near = F.lit(window - 1)
    low = F.greatest(F.lit(0), F.col("a") - near)
    return picked.select(
        "item_id", "term", "delta", "second", "least",
        F.reverse(F.slice("w", low + 1, F.col("a") - low)).alias("before"),
        F.slice("w", F.col("a") + 2, near).alias("after"),
    )


def build_index(docs: DataFrame, picked: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Stored postings (term, doc_id, version, pos, before, after) of the rarest and second rarest terms.

    ``before`` and ``after`` are the words around those that are a rarest term, else null.
    """
    roles = picked.select("term", F.lit(True).alias("rarest")).union(picked.select("second", F.lit(False)).where("second is not null"))
    roles = roles.groupBy("term").agg(F.max("rarest").alias("rarest"))
    tokens = docs.select("doc_id", "version", "words", F.posexplode("words").alias("pos", "term"))
    near = F.lit(window - 1)
    low = F.greatest(F.lit(0), F.col("pos") - near)
    before = F.reverse(F.slice("words", low + 1, F.col("pos") - low))
    found = [
        tokens.join(F.broadcast(r), "term").select(
            "term", "doc_id", "version", "pos", F.when(F.col("rarest"), before).alias("before"),
            F.when(F.col("rarest"), F.slice("words", F.col("pos") + 2, near)).alias("after"),
        )
        for r in _blocks(roles, "term")
    ]
    return scratch.save(_all(found), "postings")


def _second(index: DataFrame, at: Column) -> DataFrame:
    """The lists of second rarest terms, named so that they join the others."""
    return index.select(F.col("term").alias("t2"), F.col("doc_id").alias("d2"), F.col("version").alias("v2"), at.alias("p2"), F.col("pos").alias("q2"))


def _in_one_text(at: Column) -> Column:
    return (F.col("second") == F.col("t2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("version") == F.col("v2")) & (at == F.col("p2"))


def intersect(index: DataFrame, picked: DataFrame) -> DataFrame:
    """Postings of rarest terms with the second rarest at its place: the lists meet after a shift by their distance."""
    pairs = picked.select("term", "delta", "second").distinct()
    rarest = index.where("before is not null")
    shifted = _all([rarest.join(F.broadcast(p), "term") for p in _blocks(pairs, "term")])
    there = (F.col("pos") + F.col("delta")).cast("int")
    both = shifted.where("second is not null").withColumn("there", there)
    met = both.join(_second(index, F.col("pos")), _in_one_text(F.col("there")), "left_semi").drop("there")
    return met.union(shifted.where("second is null")).drop("delta", "second")


def proximity(index: DataFrame, picked: DataFrame, distance: int) -> DataFrame:
    """Rows (doc_id, version, item_id): the two rarest terms of a window of the item at most ``distance`` words apart."""
    pairs = picked.where("second is not null").select("item_id", "term", "second").distinct()
    rarest = index.where("before is not null").select("term", "doc_id", "version", "pos")
    cell = F.floor(F.col("pos") / distance)
    shifted = _all([rarest.join(F.broadcast(p), "term") for p in _blocks(pairs, "term")])
    around = shifted.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    apart = F.abs(F.col("pos") - F.col("q2"))
    close = _in_one_text(F.col("cell")) & (apart <= distance) & (apart > 0)
    return around.join(_second(index, cell), close, "left_semi").select("doc_id", "version", "item_id").distinct()


def _same(x: str, y: str) -> Column:
    """How many leading words two lists share."""
    equal = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(equal))


def phrases(index: DataFrame, picked: DataFrame) -> DataFrame:
    """Runs of document words that hold a whole window: (doc_id, version, lo, hi, item_id), hi included."""
    items = picked.select("item_id", "term", "least", F.col("before").alias("b"), F.col("after").alias("f")).distinct()
    parts = [index.distinct().join(F.broadcast(p), "term") for p in _blocks(items, "term")]
    runs = _all(parts).withColumns({"left": _same("before", "b"), "right": _same("after", "f")})
    runs = runs.where(F.col("left") + 1 + F.col("right") >= F.col("least"))
    return runs.select(
        "doc_id", "version", (F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("right")).alias("hi"), "item_id"
    )


def near(docs: DataFrame, pairs: DataFrame, scratch: Scratch, distance: int) -> DataFrame:
    """Proximity matches: rows (a, b, doc_id, version, pos_a, pos_b) where words a and b of ``pairs`` stand that close."""
    terms = pairs.select(F.col("a").alias("term")).union(pairs.select(F.col("b").alias("term"))).distinct()
    tokens = docs.select("doc_id", "version", F.posexplode("words").alias("pos", "term"))
    lists = scratch.save(_all([tokens.join(F.broadcast(t), "term") for t in _blocks(terms, "term")]), "lists")
    cell = F.floor(F.col("pos") / distance)
    left = lists.join(pairs.select(F.col("a").alias("term"), "b"), "term").select(
        F.col("term").alias("a"), "b", "doc_id", "version", F.col("pos").alias("pos_a"),
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"),
    )
    right = lists.select(F.col("term").alias("b"), "doc_id", "version", F.col("pos").alias("pos_b"), cell.alias("cell"))
    met = left.join(right, ["b", "doc_id", "version", "cell"]).drop("cell")
    return met.where((F.abs(F.col("pos_a") - F.col("pos_b")) <= distance) & (F.col("pos_a") != F.col("pos_b"))).distinct()


def find(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
    distance: int | None = None,
) -> DataFrame:
    """Per document: doc_id, version, n_words, ``spans`` (maximal runs of hit words, ends included) and ``item_ids``.

    With a ``distance`` also ``near_ids``, the items with a proximity match.
    """
    tokens = scratch.save(tokenized(docs, doc_id, text), "tokens")
    items = scratch.save(items_of(benchmark), "items")
    terms = items.select(F.explode("w").alias("term")).distinct()
    counts = scratch.save(term_counts(tokens, terms), "counts")
    picked = scratch.save(anchors(items, counts, window), "anchors")
    index = build_index(tokens, picked, scratch, window)
    runs = phrases(intersect(index, picked), picked)
    # merge the runs of a document: they are sorted, and each adds to the last span or opens the next
    per_doc = runs.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs"), F.collect_set("item_id").alias("item_ids")
    )
    merged = F.aggregate(
        "runs",
        F.struct(F.array().cast("array<struct<lo:int,hi:int>>").alias("done"), F.col("runs")[0].alias("open")),
        lambda s, x: F.when(
            x["lo"] <= s["open"]["hi"] + 1,
            F.struct(s["done"].alias("done"), F.struct(s["open"]["lo"].alias("lo"), F.greatest(s["open"]["hi"], x["hi"]).alias("hi")).alias("open")),
        ).otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open"))),
        lambda s: F.concat(s["done"], F.array(s["open"])),
    )
    per_doc = per_doc.select("doc_id", "version", merged.alias("spans"), "item_ids")
    per_doc = per_doc.withColumn("near_ids", F.lit(None).cast(per_doc.schema["item_ids"].dataType))
    if distance is not None:
        close = proximity(index, picked, distance).groupBy("doc_id", "version").agg(F.collect_set("item_id").alias("near_ids"))
        empty = F.lit(None).cast(per_doc.schema["spans"].dataType)
        close = close.select("doc_id", "version", empty.alias("spans"), F.lit(None).cast(close.schema["near_ids"].dataType).alias("item_ids"), "near_ids")
        per_doc = per_doc.unionByName(close).groupBy("doc_id", "version").agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in ("spans", "item_ids", "near_ids"))
        )
    per_doc = scratch.save(per_doc if distance is not None else per_doc.drop("near_ids"), "found")
    scratch.drop("postings")
    sizes = tokens.select("doc_id", "version", "n_words")
    keyed = per_doc.withColumnsRenamed({"doc_id": "hit_id", "version": "hit_version"})
    same = sizes["doc_id"].eqNullSafe(keyed["hit_id"]) & (sizes["version"] == keyed["hit_version"])
    return sizes.join(keyed, same, "left").drop("hit_id", "hit_version")


def hit_words(spans: str) -> Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: s + x["hi"] - x["lo"] + 1), F.lit(0))
