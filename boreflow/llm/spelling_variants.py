"""Spelling variants: groups words that are one edit apart, found with a variable-length gram index.

Words are the runs of Latin letters of all texts, A-Z lower-cased, with how often they occur.  Each is padded to ``^word$``.
The gram dictionary holds all grams of ``SHORTEST`` characters and longer ones, up to ``LONGEST``, that occur often enough
in the vocabulary: a frequent short gram is extended, a rare long one is pruned.  A word is decomposed from left to right
into the longest gram of the dictionary at each place, without grams that lie inside an earlier one.

An edit at a place affects the grams that touch it, those left of it that could now grow into it (what stands between their
start and the edit opens a longer gram of the dictionary), and those right of it that a longer gram could now swallow (what
stands between the edit and their end closes one).  So each gram of a word has a bound: a gram of the left part survives all
edits from some place on, one of the right part all edits up to some place.  The rarest two that together survive every edit
are merged: only their lists, (gram, place, length), are read for the word.  What is found is verified by edit distance.

Places at which no gram is sure to survive (a few in a thousand words) are looked up by what surrounds them, and by the
lists of the other word of the pair where that one has a surviving gram. Words of over ``LONG`` letters have two grams, their
halves, one of which survives any edit. Lists of frequent grams are dealt to blocks by word.

Null texts have no words; a null doc_id counts as the empty string. Repeated rows count each time. Texts and words of any length
are read whole. Ties go to the first in code-point order. Further columns are ignored, whatever their names. Empty tables give
no words.  The driver sees the dictionary alone, at most ``MOST_GRAMS`` grams of each length (and the pairs of letters).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.shared import Scratch, lower_ascii

RUN = r"([A-Za-zÀ-ÿ]+)"
#: Letters of a word at least, and occurrences.
LETTERS, TIMES = 5, 3
#: Lengths of grams.
SHORTEST, LONGEST = 2, 5
#: A long gram stays if it occurs so often, or more often where the dictionary would hold more than this many of a length.
OFTEN, MOST_GRAMS = 64, 30_000
#: Words longer than this are cut into halves.
LONG = 64
#: Occurrences of a gram for each block of its lists.
BLOCK = 1 << 14
#: Rows of one batch from Python.
ROWS = 1 << 14


def lowered(text: Column) -> Column:
    """A-Z lower-cased; texts in which lower() changes nothing else take that faster way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(r"[^\x00-\x7Fß-ÿ]"), lower_ascii(text)).otherwise(F.lower(text))


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """Rows (word, n).  Of each run whose crc32 with its document's id is divisible by ``every`` one letter is left out."""
    runs = docs.select(
        F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":")).alias("of"),
        F.explode(F.regexp_extract_all(lowered(F.col(text)), F.lit(RUN), F.lit(1))).alias("run"),
    ).where(F.char_length("run") >= LETTERS)  # a run only gets shorter
    h = F.crc32(F.concat("of", "run"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word"))
    found = words.where(F.char_length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= TIMES)


def gram_counts(words: DataFrame) -> DataFrame:
    """Rows (gram, n) over the padded words, counted in each task before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "n"])

        seen: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                t = f"^{w}$"
                for q in range(SHORTEST, LONGEST + 1):
                    seen.update([t[p : p + q] for p in range(len(t) - q + 1)])
                if len(seen) > 300_000:
                    yield flush()
                    seen = Counter()
        yield flush()

    found = words.select("word").mapInArrow(counted, "gram string, n bigint")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame) -> dict[str, int]:
    """The pruned grams and how often they occur in the vocabulary."""
    total = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    least = max(OFTEN, -(-total // MOST_GRAMS))
    kept = gram_counts(words).where((F.char_length("gram") == SHORTEST) | (F.col("n") >= least))
    return {r.gram: r.n for r in kept.collect()}


class Grams:
    """Decomposes words by a dictionary, and bounds which of their grams an edit can affect."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        longer = [g for g in known if len(g) > SHORTEST]
        self.longer = set(longer)
        self.opens = {g[:j] for g in longer for j in range(SHORTEST, len(g))}
        self.closes = {g[j:] for g in longer for j in range(1, len(g) - SHORTEST + 1)}

    def decompose(self, t: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a padded word."""
        out, reach, n, longer = [], 0, len(t), self.longer
        for p in range(n - SHORTEST + 1):
            e = p + SHORTEST
            for end in range(min(p + LONGEST, n), e, -1):
                if t[p:end] in longer:
                    e = end
                    break
            if e > reach:
                out.append((p, e))
                reach = e
        return out

    def bounds(self, t: str) -> tuple[list[int], list[int]]:
        """For each place i of a padded word: the first start from which grams left of an edit at i or later can be affected,
        and the last end up to which grams right of an edit before i or earlier can be."""
        n, opens, closes = len(t), self.opens, self.closes
        left, right = list(range(n + 1)), list(range(n + 1))
        for i in range(SHORTEST, n):
            for j in range(max(0, i - LONGEST + 1), i - SHORTEST + 1):
                if t[j:i] in opens:
                    left[i] = j
                    break
        for i in range(n - 2, 0, -1):
            left[i] = min(left[i], left[i + 1])
        for i in range(1, n - SHORTEST + 1):
            for e in range(min(n, i + LONGEST - 1), i + SHORTEST - 1, -1):
                if t[i:e] in closes:
                    right[i] = e
                    break
            right[i] = max(right[i], right[i - 1])
        return left, right

    def picked(self, t: str, grams: list[tuple[int, int]]) -> tuple[tuple | None, tuple | None, int, int]:
        """The gram that survives edits from place a on, the one that survives edits before r, a and r.

        A letter at i counts as before r if i < r, a gap in front of it if i <= r.
        """
        left, right = self.bounds(t)
        n, known = len(t), self.known
        lefts, rights = [], []
        for p, e in grams:
            a = bisect_right(left, p, e, n)  # left never falls
            if a < n:
                lefts.append((a, known.get(t[p:e], 0), p, e))
            r = bisect_left(right, e, 1, p + 1) - 1 if p else 0  # nor does right
            if r > 0:
                rights.append((r, known.get(t[p:e], 0), p, e))
        lefts.sort()
        best, cheap = None, []
        for x in lefts:
            cheap.append(x if not cheap or x[1] < cheap[-1][1] else cheap[-1])
        starts = [x[0] for x in lefts]
        for y in rights:
            k = bisect_right(starts, y[0])
            if k and (best is None or cheap[k - 1][1] + y[1] < best[0]):
                best = cheap[k - 1][1] + y[1], cheap[k - 1], y
        if best is None:
            x = lefts[0] if lefts else None
            y = max(rights, key=lambda y: (y[0], -y[1])) if rights else None
        else:
            _, x, y = best
        return (x and x[2:]), (y and y[2:]), x[0] if x else n, y[0] if y else 0


def _key(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def keys(grams: Grams, w: str) -> tuple[list[int], list[int], bool]:
    """Keys under which a word is listed, keys that it reads, and whether an edit of it may leave no gram whole."""
    listed, read, weak, size = [], [], False, len(w)
    if size <= LONG + 1:
        t = f"^{w}$"
        parts = grams.decompose(t)
        x, y, a, r = grams.picked(t, parts)
        weak = a > r
        deal = {}
        for p, e in parts:
            g = t[p:e]
            deal[g] = n = 1 + grams.known.get(g, 0) // BLOCK
            block = zlib.crc32(w.encode()) % n if n > 1 else 0
            listed.append(_key(0, g, p, size, block))
            if weak:
                listed.append(_key(1, g, p, size, block))
        for part, shift in ((x, 0), (y, 1)):
            if part:
                p, g = part[0], t[part[0] : part[1]]
                for block in range(deal[g]):
                    read += [_key(0, g, p, size, block), _key(0, g, p + shift, size + 1, block), _key(1, g, p - shift, size - 1, block)]
        for i in range(max(1, r), min(a, size + 1)):  # letters that no gram is sure to survive
            around = _key(2, i, t[:i], t[i + 1 :])
            listed.append(around)
            read += [around, _key(3, i, t[:i] + t[i + 1 :])]
        listed += [_key(3, i, t) for i in range(r + 1, min(a, size + 2))]  # gaps
    if size > LONG:
        for short in (size, size - 1):
            half = short // 2
            listed += [_key(4, short, size, w[:half]), _key(5, short, size, w[size - short + half :])]
        half = size // 2
        for other in (size, size + 1):
            read += [_key(4, size, other, w[:half]), _key(5, size, other, w[half:])]
    return listed, read, weak


ENTRIES = "listed boolean, key bigint, word string, n bigint, letters bigint, weak boolean"
_TYPES = [pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]


def index(words: DataFrame, known: dict[str, int]) -> DataFrame:
    """Entries of the index, and the reads of each word: (listed, key, word, n, letters, weak); letters is a bit mask."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows, size = Grams(shared.value), [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        for b in batches:
            for w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                listed, read, weak = keys(grams, w)
                letters = 0
                for c in set(w):
                    letters |= 1 << (ord(c) & 63)
                letters -= (letters >> 63) << 64
                rows += [(True, k, w, n, letters, weak) for k in listed]
                rows += [(False, k, w, n, letters, weak) for k in dict.fromkeys(read)]
                size += len(w) * (len(listed) + len(read))
                if len(rows) >= ROWS or size > 1 << 22:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return words.select("word", "n").mapInArrow(entries, ENTRIES)


def near_pairs(entries: DataFrame) -> DataFrame:
    """Each pair of near words once: (a, n_a, b, n_b) with a < b."""
    listed = entries.where("listed").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("letters").alias("letters_b"), "weak")
    read = entries.where("not listed").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("letters").alias("letters_a"))
    # of two words of a length each reads the other's lists; one of the reads is enough unless the first has a weak place
    near = (
        "bit_count(letters_a ^ letters_b) <= 2 and (a < b or weak or char_length(a) <> char_length(b)) and levenshtein(a, b, 1) = 1"
    )
    met = read.join(listed, "key").where(near)
    first = F.col("a") < F.col("b")
    low = F.when(first, F.struct("a", "n_a")).otherwise(F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a")))
    high = F.when(first, F.struct("b", "n_b")).otherwise(F.struct(F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    return met.select(low.alias("low"), high.alias("high")).select("low.*", "high.*").distinct()


def forms(pairs: DataFrame) -> DataFrame:
    """Per word with near words: (word, n_near, form, form_n)."""
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other"))
    both = both.union(pairs.select("b", "n_b", "a", "n_a"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    return best.select("word", "n_near", F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (word, root) of words with a form: each round doubles how far a root lies, and a form at least doubles n."""
    now = scratch.save(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        step += 1
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = scratch.save(moved, f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """Per word: word, n, n_near, form, form_n and root."""
    words = scratch.save(word_counts(docs, doc_id, text, every), "words")
    entries = scratch.save(index(words, dictionary(words)), "entries")
    found = scratch.save(forms(near_pairs(entries)), "forms")
    scratch.drop("entries")
    ends = roots(found, scratch)
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
