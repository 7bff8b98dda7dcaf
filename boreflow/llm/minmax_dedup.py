"""Near-duplicate groups by min-max hashing.

A document is the set of its distinct 5-word shingles (64-bit hashes).  Under each of ``PERMUTATIONS`` random orders both
the least and the greatest element are kept, so half the hash evaluations give a full signature; ``ROWS`` values make a
band, and documents that agree on a band are candidates.  Candidates are confirmed on their full sets.

Only connections matter, so pairs within a bucket are not all formed:

1. documents with the same set are one class;
2. in every bucket all classes are compared with one pivot, the class that shares buckets with most others: copies of one
   original meet the original there.  Confirmed links give first components;
3. in buckets that still hold several components, the classes outside the bucket's largest component are compared with all
   others by their signatures, in blocks of bounded size and without emitting pairs; the close ones are confirmed on full
   sets there.  A group of copies that is one component is thus never compared with itself.

Joins by bucket are dealt further by class in proportion to the bucket's size, so one bucket is not one task.

The result is that of a join on the sets but for what banding misses: a pair at similarity s agrees in no band with a chance
of about (1 - s**5)**25, 4e-7 at 0.85 and 5e-5 at 0.80; a pair whose signatures agree ``SLACK`` standard deviations less
than s of their values is not looked at either (3e-7).  The least and the greatest value of one order are nearly independent;
the tests measure recall at the threshold.  Shingles are compared by 64-bit hashes.

Null and empty texts have no shingles and are linked with nothing. A text of fewer than 5 words has one shingle, all its
words. Rows that share an id but not a text are separate members. Repeated rows are one class. Rows with a null id are linked
like others; ``component_id`` is null only where no row of the group has an id, and such rows count as kept. Texts of any
length are read whole, long ones in portions, so that beyond a word's 8 bytes only a portion (or a longer word) is in memory. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.components import connected_components
from boreflow.llm.shared import Scratch

SHINGLE = 5
PERMUTATIONS, ROWS = 64, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Classes of a bucket that are compared at once, and those that one task of a join takes of it.
BLOCK = 512
#: Bytes of text whose words are hashed at once; a longer text is cut between words.
PORTION = 2 << 20
DEAL = 256
#: How far below the threshold an estimate of the similarity may lie: five standard deviations.
SLACK = 5.0

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: A-Z to a-z, and 0 for white space (space, tab to carriage return), in UTF-8 bytes.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[32, *range(9, 14)]] = 0
_FOLD[0] = 1  # NUL belongs to words; its value is raised below, which tells it from the real 1
#: The same white space as bytes.
_SPACES, _SPACE = [bytes([x]) for x in (32, *range(9, 14))], re.compile(rb"[ \t-\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 20)
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, factor, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and how many words each text has."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    folded = _FOLD[raw]
    is_word = folded > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(raw) + 1)
    value = folded.astype(np.uint64) + (raw == 0) * np.uint64(300) + np.uint64(1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[:-1], dtype=np.uint64)])
    hashes = _mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))


def portions(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes that end between words; a longer word is a piece with what precedes it."""
    at = 0
    while len(text) - at > size:
        space = max(text.rfind(c, at, at + size) for c in _SPACES)
        if space < at:
            found = _SPACE.search(text, at + size)
            if found is None:
                break
            space = found.start()
        yield text[at:space]
        at = space + 1
    yield text[at:]


def all_word_hashes(texts: list[bytes], size: int = PORTION) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes``, with long texts in portions; a word's hash does not depend on where it stands."""
    if sum(map(len, texts)) <= 2 * size:
        return word_hashes(texts)
    parts = [[word_hashes([p])[0] for p in portions(t, size)] for t in texts]
    return np.concatenate([h for hs in parts for h in hs]), np.array([sum(map(len, hs)) for hs in parts])


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = all_word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        w = hashes[at : at + n]
        at += n
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        k = min(n, size)
        x = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            x += w[j : n - k + 1 + j] * _FACTORS[200 + j]
        out.append(np.unique(_mix(x + np.uint64(k))))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least and greatest hash under each permutation: a row of 2 * PERMUTATIONS values for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sig = np.empty((len(sets), 2 * PERMUTATIONS), np.uint32)
    for i in range(PERMUTATIONS):
        v = ((flat * _FACTORS[i]) >> np.uint64(32)).astype(np.uint32)
        sig[:, 2 * i] = np.minimum.reduceat(v, starts)
        sig[:, 2 * i + 1] = np.maximum.reduceat(v, starts)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band."""
    x = sig[:, : BANDS * ROWS].astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = (x * _FACTORS[210 : 210 + ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _M1
    return _mix(key)


def _class_of(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a = int(_mix(s ^ _FACTORS[220]).sum(dtype=np.uint64)) + len(s)
    b = int(_mix(s + _FACTORS[221]).sum(dtype=np.uint64)) ^ (len(s) * int(_M1))
    return b"".join((x % (1 << 64)).to_bytes(8, "big") for x in (a, b))


def _chunks(batches: Iterator[pa.RecordBatch], size: int = 1 << 20, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about so many bytes of text (column ``text``); so many rows at most are turned to Python values at once."""
    for whole in batches:
        for first in range(0, whole.num_rows, rows):
            b = whole.slice(first, rows)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and n < size:
                    n += len(texts[end])
                    end += 1
                yield b.slice(at, end - at), texts[at:end]
                at = end


def _profiles(batches: Iterator[pa.RecordBatch]):
    for b, texts in _chunks(batches):
        sets = shingle_sets(texts)
        full = [i for i, s in enumerate(sets) if len(s)]
        cls: list = [None] * len(sets)
        sig: list = [None] * len(sets)
        keys: list = [None] * len(sets)
        if full:
            sigs = signatures([sets[i] for i in full])
            for i, s, k in zip(full, sigs, band_keys(sigs).astype(np.int64), strict=True):
                cls[i], sig[i], keys[i] = _class_of(sets[i]), s.tobytes(), k
        cols = [b.column("doc_id"), b.column("version"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary())]
        cols += [pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "version", "n_shingles", "cls", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]):
    for b, texts in _chunks(batches):
        sets = shingle_sets(texts)
        cls = [_class_of(s) for s in sets]
        cols = [pa.array(cls, pa.binary()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["cls", "members"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (src, dst) that 100 * intersection >= percent * union holds for."""
    a = sets.select(F.col("cls").alias("src"), F.col("members").alias("a"))
    b = sets.select(F.col("cls").alias("dst"), F.col("members").alias("b"))
    both = pairs.join(a, "src").join(b, "dst")
    met = F.size(F.array_intersect("a", "b"))
    both = both.select("src", "dst", met.alias("met"), (F.size("a") + F.size("b") - met).alias("all"))
    return both.where(100 * F.col("met") >= percent * F.col("all")).select("src", "dst")


def _linked(percent: int):
    """Links between the ``left`` and the other classes of one block, confirmed on full sets.

    Signatures rule out most pairs; a pair is looked at in the first band it shares, and not where earlier links already
    connect it, so a block gives fewer links than it has classes.
    """
    values, threshold = 2 * PERMUTATIONS, percent / 100
    least = (threshold - SLACK * (threshold * (1 - threshold) / values) ** 0.5) * values

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(len(group), values)
        keys = band_keys(sig).astype(np.int64)
        here = int(np.flatnonzero(keys[0] == group["band"].iloc[0])[0])
        left, cls, sets = group["left"].to_numpy(bool), group["cls"].to_numpy(), group["members"].to_numpy()
        _, comp = np.unique(group["comp"].to_numpy(), return_inverse=True)
        others, out = np.flatnonzero(~left), []
        for i in np.flatnonzero(left).tolist():
            js = others[comp[others] != comp[i]]
            js = js[(sig[js] == sig[i]).sum(axis=1) >= least]
            js = js[~(keys[js, :here] == keys[i, :here]).any(axis=1)]
            for j in js.tolist():
                if comp[j] != comp[i]:
                    met = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * met >= percent * (len(sets[i]) + len(sets[j]) - met):
                        out.append((cls[i], cls[j]))
                        comp[comp == comp[j]] = comp[i]
        return pd.DataFrame(out, columns=["src", "dst"])

    return compare


def _dealt(by_band: DataFrame) -> DataFrame:
    """A row of each band for each of the parts its classes (``n``) are dealt to."""
    return by_band.withColumn("deal", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / DEAL).cast("int"))))


def near_groups(
    docs: DataFrame, scratch: Scratch, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept, version, first), one for each document; version is a hash of the text.

    Documents are linked where 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id of the connected group, and the document of that id is kept.  ``first`` holds for one (doc_id, version) of each
    group, the smallest (null ids come last), and for rows without shingles.
    """
    plain = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text")
    )
    profiles = scratch.save(
        plain.mapInArrow(_profiles, "doc_id bigint, version bigint, n_shingles bigint, cls binary, sig binary, bands array<bigint>"), "profiles"
    )
    full = profiles.where("cls is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("least")
    classes = scratch.save(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), least, F.first("bands").alias("bands")), "classes")

    # buckets of two or more classes
    banded = classes.select("cls", F.explode("bands").alias("band"))
    sizes = scratch.save(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    deal = F.pmod(F.xxhash64("cls"), F.floor(F.col("n") / DEAL) + 1).cast("int").alias("deal")
    shared = scratch.save(banded.join(sizes, "band").select("band", "cls", "n", deal), "shared")
    popular = shared.groupBy("cls").agg(F.sum("n").alias("popularity"))
    pivots = shared.join(popular, "cls").groupBy("band", "n").agg(F.max(F.struct("popularity", "cls")).getField("cls").alias("pivot"))
    pairs = shared.drop("n").join(_dealt(pivots).drop("n"), ["band", "deal"]).where("cls <> pivot")
    pairs = pairs.select(F.least("cls", "pivot").alias("src"), F.greatest("cls", "pivot").alias("dst")).distinct()
    pairs = scratch.save(pairs, "pivot-pairs")

    # full sets of the classes that share a bucket
    wanted = shared.select("cls").distinct().join(classes, "cls").select(
        F.col("least.doc_id").alias("want_id"), F.col("least.version").alias("want_version")
    )
    one = plain["doc_id"].eqNullSafe(wanted["want_id"]) & (plain["version"] == wanted["want_version"])
    picked = plain.join(wanted, one, "left_semi")
    sets = picked.mapInArrow(_sets, "cls binary, members array<bigint>").dropDuplicates(["cls"])
    sets = scratch.save(sets, "sets")
    links = scratch.save(_confirm(pairs, sets, percent), "links")
    first = scratch.save(connected_components(links, scratch), "first")

    # buckets that still hold several components
    placed = shared.join(first.withColumnRenamed("node", "cls"), "cls", "left")
    placed = placed.select("band", "deal", "cls", F.coalesce("component", "cls").alias("comp"))
    heads = placed.groupBy("band", "comp").agg(F.count("*").alias("k")).groupBy("band")
    mixed = heads.agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    parts = F.ceil((F.col("n") - F.col("main.k")) / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    mixed = mixed.select("band", "n", F.col("main.comp").alias("main"), parts[0].alias("lefts"), parts[1].alias("rights"))
    rest = scratch.save(placed.join(_dealt(mixed).drop("n"), ["band", "deal"]).drop("deal"), "rest")
    sig = full.select("cls", "sig").dropDuplicates(["cls"])
    rest = rest.join(sig, "cls").join(sets, "cls")
    own = lambda parts: F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    block = ["band", "cls", "comp", "sig", "members"]
    left = rest.where("comp <> main").select(*block, F.lit(True).alias("left"), own("lefts").alias("i"), every("rights").alias("j"))
    right = rest.select(*block, F.lit(False).alias("left"), every("lefts").alias("i"), own("rights").alias("j"))
    found = left.union(right).groupBy("band", "i", "j").applyInPandas(_linked(percent), "src binary, dst binary")
    more = scratch.save(found, "more-links")
    scratch.drop("sets")

    # components of both kinds of links
    if more.isEmpty():
        final = first
    else:
        a = first.toDF("src", "x")
        b = first.toDF("dst", "y")
        joined = more.join(a, "src", "left").join(b, "dst", "left")
        joined = joined.select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))
        second = connected_components(joined, scratch)
        up = second.toDF("component", "top")
        nodes = first.union(second.select("node", "node").toDF("node", "component").join(first.select("node"), "node", "left_anti"))
        final = nodes.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    grouped = classes.select("cls", "rep", "least").join(final.toDF("cls", "component"), "cls", "left")
    grouped = grouped.select("cls", "rep", "least", F.coalesce("component", "cls").alias("component"))
    lowest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("least").alias("lead"))
    labels = grouped.join(lowest, "component").select("cls", "component_id", "lead")
    out = profiles.select("doc_id", "version", "n_shingles", "cls").join(labels, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("version") == F.col("lead.version"))
    return out.select("doc_id", "n_shingles", "component_id", kept, "version", (F.col("cls").isNull() | leads).alias("first"))
