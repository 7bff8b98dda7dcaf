"""Exact substring deduplication with a logarithmic family of sparse suffix arrays.

Bytes are removed where a string of ``LENGTH`` bytes starts that also starts anywhere else.  Sorting every suffix of the
corpus is not needed for that: of each such string one position is chosen, the leftmost of the least hashes of its
``GRAM``-byte grams.  The choice depends on the string alone, so equal strings choose equal positions, and consecutive
strings mostly choose the same one: there is about one chosen suffix in 77 bytes.

A batch's suffix array holds its chosen suffixes, each with a digest of the whole stretch of strings that chose it.  Suffixes
are ordered by their first eight bytes (as a number), then by the hash of their gram, in parts dealt by that hash; that hashed
grams stand in for the bytes beyond is what makes an entry small.  The family keeps arrays in levels.  A new batch is
merge-scanned against each level there is, and against itself, for suffixes that begin with the same gram; those grams are
noted.  Then it becomes the lowest level, and levels of equal rank are merged into one of the next, so each suffix is
rewritten a logarithmic number of times.  Only kinds of stretches with a noted gram are looked at further: stretches that are
equal as a whole are duplicated throughout; other stretches that share a gram are compared string by string, one of each
kind.  All strings of a comparison share the gram, so the work is dealt by grams, and a gram of many stretches is dealt
further by the strings' own hashes.  A family is a set of tables: ``state`` and ``resume`` carry it to a later corpus.

Texts are UTF-8 bytes; a null text is empty; nothing crosses documents. Texts of fewer than ``LENGTH`` bytes lose nothing.
Long texts are read in overlapping pieces, so their length is bounded by Spark's rows only. Repeated rows are duplicates of
each other. Strings are compared by 64-bit hashes. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.minmax_dedup import _M1, _chunks, _mix, _Powers
from boreflow.llm.shared import Scratch

LENGTH, GRAM = 200, 48
POSITION_BITS = np.uint64(28)
#: Batches that one call feeds to the family: the last one meets two levels. Each scan reads all levels once.
BATCHES = 4
#: Stretches of one gram up to which it is not dealt further.
PART = 256
#: Bytes of text that are worked on at once, and of a piece of a longer text.
CHUNK, PIECE = 1 << 20, 1 << 20


def _pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[Stretches]:
    """Stretches of all texts; a text longer than ``PIECE`` comes in pieces whose starts do not overlap."""
    group, size = [], 0
    for d, t in enumerate(texts):
        for base in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[base : base + PIECE + length - 1]
            if group and size + len(part) > 2 * PIECE:
                yield Stretches(group, length)
                group, size = [], 0
            group.append((d, base, part))
            size += len(part)
    if group:
        yield Stretches(group, length)


class Stretches:
    """Chosen suffixes of (doc, base, bytes): ``k`` first bytes, ``h`` gram hash, ``s`` stretch digest, ``doc``, ``start``, ``n``.

    ``start`` is the first start of the stretch in its document and ``n`` how many starts it has.
    """

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int = LENGTH, gram: int = GRAM):
        self.length = length
        raw = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).astype(np.int64)
        self.h = self.s = np.empty(0, np.uint64)
        self.k = self.doc = self.at = self.n = self.start = np.empty(0, np.int64)
        size = len(raw)
        if size < length:
            return
        up, self.down = _Powers.upto(size + 1)
        terms = (raw.astype(np.uint64) + np.uint64(1)) * up[:size]
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        del terms
        g = self.hashes(np.arange(size - gram + 1), gram)
        m = ((g >> POSITION_BITS) << POSITION_BITS) | np.arange(len(g), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while 2 * have <= width:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        chosen = (m & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
        # maximal runs of starts in one document that chose one position
        starts = np.flatnonzero(np.diff(chosen, prepend=-1))
        cuts = np.unique(np.concatenate([starts, begins[begins < len(chosen)]]))
        ends = np.append(cuts[1:], len(chosen))
        part = np.searchsorted(begins, cuts, side="right") - 1
        ends = np.minimum(ends, begins[part + 1] - length + 1)
        good = ends > cuts
        self.at, self.n, part = cuts[good], (ends - cuts)[good], part[good]
        self.doc = np.array([p[0] for p in parts])[part]
        self.start = self.at - begins[part] + np.array([p[1] for p in parts])[part]
        first = chosen[self.at]
        self.h = g[first]
        self.s = self.hashes(self.at, self.n + length - 1)
        self.k = np.ascontiguousarray(raw[first[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
        self.k = (self.k ^ np.uint64(1 << 63)).astype(np.int64)  # signed numbers in the order of the bytes

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        """Hashes of the strings that start at the given positions."""
        n = np.asarray(length)
        return _mix((self.prefix[at + n] - self.prefix[at]) * self.down[at] + n.astype(np.uint64) * _M1)


def _suffixes(batches: Iterator[pa.RecordBatch]):
    for b, texts in _chunks(batches, CHUNK):
        for x in _pieces(texts):
            rows = pa.array(x.doc)
            cols = [pa.array(x.k), pa.array(x.h.astype(np.int64)), pa.array(x.s.astype(np.int64))]
            cols += [b.column("doc_id").take(rows), b.column("version").take(rows)]
            yield pa.RecordBatch.from_arrays(cols, ["k", "h", "s", "doc_id", "version"])


def versioned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, version, text); version tells apart texts that share an id."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text_).alias("version"), text_.alias("text"))


class SuffixFamily:
    """Levels of suffix arrays: rows (k, h, s, n, rep) in the order of k and h; n stretches of that kind, rep a document of it."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.levels, self.members, self.noted, self.made = scratch, [], [], [], 0

    def state(self) -> dict:
        """Names and ranks of the family's tables, from which ``resume`` goes on."""
        return {
            "base": self.scratch.base, "made": self.made, "levels": [(r, n) for r, n, _ in self.levels],
            "members": [n for n, _ in self.members], "noted": [n for n, _ in self.noted],
        }

    @classmethod
    def resume(cls, scratch: Scratch, state: dict) -> SuffixFamily:
        """A family whose tables ``scratch`` holds from now on; those of the state are read where they are."""
        family, at = cls(scratch), lambda n: scratch.spark.read.parquet(f"{state['base']}/{n}")
        family.made = state["made"]
        family.levels = [(r, n, at(n)) for r, n in state["levels"]]
        family.members = [(n, at(n)) for n in state["members"]]
        family.noted = [(n, at(n)) for n in state["noted"]]
        return family

    def _save(self, df: DataFrame, kind: str) -> tuple[str, DataFrame]:
        self.made += 1
        return f"{kind}-{self.made}", self.scratch.save(df, f"{kind}-{self.made}")

    def add(self, docs: DataFrame) -> None:
        """A new batch (rows of ``versioned``): scanned against each level, then the lowest level; equal ranks merge."""
        self.members.append(self._save(docs.mapInArrow(_suffixes, "k bigint, h bigint, s bigint, doc_id bigint, version bigint"), "suffixes"))
        rep = F.struct("doc_id", "version").alias("rep")
        kinds = self.members[-1][1].groupBy("k", "h", "s").agg(F.count("*").alias("n"), F.min(rep).alias("rep"))
        level = self._save(kinds.sortWithinPartitions("k", "h"), "level")
        grams = level[1].groupBy("k", "h").agg(F.sum("n").alias("n"))
        met = grams.where("n > 1").select("k", "h")
        for _, _, old in self.levels:
            met = met.union(grams.join(old.select("k", "h"), ["k", "h"], "left_semi").select("k", "h"))
        self.noted.append(self._save(met.distinct(), "noted"))
        self.levels.append((0, *level))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, old_a, a), (_, old_b, b) = self.levels.pop(), self.levels.pop()
            both = a.union(b).groupBy("k", "h", "s").agg(F.sum("n").alias("n"), F.min("rep").alias("rep"))
            self.levels.append((rank + 1, *self._save(both.sortWithinPartitions("k", "h"), "level")))
            self.scratch.drop(old_a, old_b)

    def scan(self) -> DataFrame:
        """Kinds whose gram starts more than one stretch (h, s, n, rep, kinds), from the grams that the scans noted."""
        noted = _all([t for _, t in self.noted]).distinct()
        found = _all([x for _, _, x in self.levels]).join(noted, ["k", "h"], "left_semi")
        merged = found.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min("rep").alias("rep"))
        merged = self._save(merged, "met")[1]
        grams = merged.groupBy("h").agg(F.count("*").alias("kinds"))
        return merged.join(grams, "h")

    def occurrences(self) -> DataFrame:
        return _all([t for _, t in self.members])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


STRINGS = "h bigint, part int, s bigint, n bigint, offsets binary, hashes binary"


def _strings(batches: Iterator[pa.RecordBatch]):
    """String hashes of the stretches that need comparison, dealt by gram and part."""
    for b, texts in _chunks(batches, CHUNK):
        wanted = [{w["s"]: w for w in ws or []} for ws in b.column("compare").to_pylist()]
        for x in _pieces(texts):
            rows = []
            for i, (d, s) in enumerate(zip(x.doc.tolist(), x.s.astype(np.int64).tolist(), strict=True)):
                w = wanted[d].pop(s, None)  # the first stretch of its kind in the document
                if w is None:
                    continue
                starts = np.arange(x.n[i])
                hs = x.hashes(x.at[i] + starts, x.length)
                parts = -(-w["kinds"] // PART)
                for p in range(parts):
                    mine = np.flatnonzero(hs % np.uint64(parts) == p) if parts > 1 else starts
                    if len(mine):
                        rows.append((w["h"], p, w["s"], w["n"], mine.astype("<i4").tobytes(), hs[mine].tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            names = ["h", "part", "s", "n", "offsets", "hashes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _compare(batches: Iterator[pa.RecordBatch], most: int = 1 << 20):
    """Which strings of single stretches stand in others too; rows come in the order of (h, part)."""

    def settle(rows):
        hs = np.frombuffer(b"".join(r[5] for r in rows), np.uint64)
        off = np.frombuffer(b"".join(r[4] for r in rows), "<i4")
        sizes = np.array([len(r[4]) // 4 for r in rows])
        weight = np.repeat([min(2, r[3]) for r in rows], sizes)
        _, which = np.unique(hs, return_inverse=True)
        again = np.bincount(which, weight)[which] > 1
        cuts, out = np.cumsum(sizes)[:-1], []
        for r, o, a in zip(rows, np.split(off, cuts), np.split(again, cuts), strict=True):
            if r[3] == 1 and a.any():
                out.append((r[2], o[a].tobytes()))
        s, o = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(o, pa.binary())], ["s", "offsets"])

    rows, size, key = [], 0, None
    for b in batches:
        for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if size >= most and r[:2] != key:
                yield settle(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[4]) // 4
            key = r[:2]
    if rows:
        yield settle(rows)


def _merged(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Maximal runs (start, stop) of the union of some spans."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]]) if len(first) else np.empty(0, bool)
    return np.stack([first[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)] if len(first) else first], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]):
    """Removes the strings of wholly duplicated stretches and those found by comparison."""
    for b, texts in _chunks(batches, CHUNK):
        whole = [set(w or []) for w in b.column("whole").to_pylist()]
        some: list[dict] = [{} for _ in texts]
        for d, pieces in enumerate(b.column("some").to_pylist()):
            for piece in pieces or []:
                some[d].setdefault(piece["s"], []).append(np.frombuffer(piece["offsets"], "<i4"))
        spans: list[list] = [[] for _ in texts]
        for x in _pieces(texts):
            for d, s, at, n in zip(x.doc.tolist(), x.s.astype(np.int64).tolist(), x.start.tolist(), x.n.tolist(), strict=True):
                if s in whole[d]:
                    spans[d].append(np.array([[at, at + n - 1 + x.length]]))
                for offsets in some[d].pop(s, ()):
                    spans[d].append(np.stack([at + offsets, at + offsets + x.length], axis=1).astype(np.int64))
        runs, kept = [], []
        for t, found in zip(texts, spans, strict=True):
            gone = np.concatenate([np.empty((0, 2), np.int64), *found])
            gone = _merged(gone[:, 0], gone[:, 1]).tolist()
            at, left = 0, []
            for start, stop in gone:
                left.append(t[at:start])
                at = stop
            kept.append(b"".join([*left, t[at:]]))
            runs.append([{"start": start, "stop": stop} for start, stop in gone])
        valid = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        out = [b.column("doc_id"), b.column("version"), pa.array(runs, SPANS), pa.array(kept, pa.binary()), valid]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "version", "spans", "kept", "kept_text"])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
RESULT = "doc_id bigint, version bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary, kept_text string"


def _free(docs: DataFrame) -> None:
    """Let Spark's cleaner remove the shuffle files of steps that are done."""
    gc.collect()
    docs.sparkSession._jvm.System.gc()


def removals(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES
) -> DataFrame:
    """Rows (doc_id, version, spans, kept, kept_text) of the documents that lose bytes.

    ``spans`` are the maximal removed runs of bytes (stop excluded) and ``kept`` the other bytes; ``kept_text`` is kept
    without the halves of characters that a cut left.  ``version`` is that of ``versioned``.
    """
    plain = versioned(docs, doc_id, text)
    family = SuffixFamily(scratch)
    for i in range(batches):
        family.add(plain.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(batches)) == i))
    kinds = scratch.save(family.scan(), "kinds")
    scratch.drop(*(name for _, name, _ in family.levels))

    several = kinds.where("n > 1").select("h", "s")
    whole = family.occurrences().join(several, ["h", "s"]).groupBy("doc_id", "version").agg(F.collect_set("s").alias("whole"))
    compare = kinds.where("kinds > 1").groupBy("rep").agg(F.collect_list(F.struct("h", "s", "n", "kinds")).alias("compare"))
    compare = compare.select("rep.doc_id", "rep.version", "compare")
    marks = scratch.save(_by_doc(whole, compare), "marks")
    scratch.drop(*(n for n, _ in family.members + family.noted))
    touched = plain.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    touched = _with_marks(touched, marks, ["whole", "compare"])
    hit = F.col("whole").isNotNull() | F.col("compare").isNotNull()
    work = scratch.save(touched.where(hit).dropDuplicates(["doc_id", "version"]), "work")
    _free(docs)

    dealt = work.where("compare is not null").select("text", "compare").mapInArrow(_strings, STRINGS)
    pieces = dealt.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_compare, "s bigint, offsets binary")
    pieces = scratch.save(pieces, "pieces")
    owner = kinds.where("n = 1").select("s", "rep.doc_id", "rep.version")
    some = pieces.join(owner, "s").groupBy("doc_id", "version").agg(F.collect_list(F.struct("s", "offsets")).alias("some"))
    cut = _with_marks(work.select("doc_id", "version", "text", "whole"), some, ["some"])
    cut = scratch.save(cut.where("whole is not null or some is not null").mapInArrow(_cut, RESULT), "cut")
    _free(docs)
    return cut


def remove_repeats(
    docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES
) -> DataFrame:
    """Rows (doc_id, version, n_bytes, spans, kept), one for each document; where nothing is removed kept is the text."""
    cut, plain = removals(docs, scratch, doc_id, text, batches), versioned(docs, doc_id, text)
    out = _with_marks(plain.withColumn("n_bytes", F.octet_length("text").cast("bigint")), cut, ["spans", "kept"])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return out.select(
        "doc_id", "version", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept", F.col("text").cast("binary")).alias("kept")
    )


def _by_doc(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.withColumnsRenamed({"doc_id": "d", "version": "v"})
    both = a.join(b, a["doc_id"].eqNullSafe(b["d"]) & a["version"].eqNullSafe(b["v"]), "full_outer")
    return both.select(
        F.when(F.col("v").isNotNull(), F.col("d")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.coalesce("version", "v").alias("version"), "whole", "compare",
    )


def _with_marks(docs: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    m = marks.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), *columns)
    return docs.join(m, docs["doc_id"].eqNullSafe(m["d"]) & (docs["version"] == m["v"]), "left").drop("d", "v")
