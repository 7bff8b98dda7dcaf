"""Byte-level BPE by prefix dynamic programming.

For a byte string under BPE every prefix has exactly one token that ends its encoding.  That token is kept for each
prefix, so the encoding of a text is found by walking back from its end, an append only adds prefixes, and an edit is
re-encoded from the last unchanged piece.  Whether a token may follow the last token of a shorter prefix is decided by
undoing the merges of the two tokens towards their common border: the pair is valid when no merge across the border
would have come first.

Null texts are encoded as the empty text: no ids and no bytes.  Other columns are kept; where ``out`` names a column
that exists, it is replaced. Repeated rows are encoded alike, an empty table gives an empty result, and texts of any length are
encoded whole. With another pattern than ``SEGMENTED`` texts are cut by the pattern alone, without the memo of segments.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from boreflow.llm.shared import small_batches

#: The piece pattern whose pieces never reach from one segment (see ``SEGMENT``) into the next (fixed value).
SEGMENTED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the piece pattern (Unicode White_Space), fixed values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes of memoised segments and prefixes in one Python worker before the memo starts anew.
MEMO_BYTES = 64 << 20
#: Segments longer than this many characters are encoded without being memoised.
MEMO_CHARS = 48
#: Characters that are segmented at a time, pieces whose prefix tables grow together, and ids decoded at a time.
TEXT_CHARS, PIECES, IDS = 1 << 20, 1 << 14, 1 << 16


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a decimal on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


#: Factor of the rolling hash that finds tokens in many pieces at once.
BASE = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Index of each 64-bit key in an array of distinct keys, or -1, for many keys at once."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        assert len(np.unique(keys)) == len(keys), "two keys are the same"
        self.keys, self.shift, self.levels = keys, np.uint64(64 - bits), []
        rest, factor = np.arange(len(keys)), int(BASE)
        while len(rest):
            slot = (keys[rest] * np.uint64(factor)) >> self.shift
            table = np.full(1 << bits, -1, np.int32)
            table[slot] = rest
            self.levels.append((np.uint64(factor), table))
            rest, factor = rest[table[slot] != rest], (factor * 6364136223846793005 + 2) % (1 << 64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        out, rest = None, None
        for factor, table in self.levels:
            q = wanted if rest is None else wanted[rest]
            at = table[(q * factor) >> self.shift]
            taken = at >= 0
            wrong = np.flatnonzero(taken & (self.keys[at] != q))  # of another key: ours may be a level further
            at[wrong] = -1
            if rest is None:
                out, rest = at, wrong
            else:
                out[rest], rest = at, rest[wrong]
            if not len(rest):
                break
        return out


class PrefixBpe:
    """Encoder and decoder of one rank file; ``pattern`` cuts texts into pieces that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces, self.segmented = regex.compile(pattern), pattern == SEGMENTED
        self.longest = max(map(len, ranks))
        size = max(ranks.values()) + 1
        self.token: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.token[r] = t
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for r, t in enumerate(self.token):
            for cut in range(len(t) - 1, 0, -1):
                a, b = ranks.get(t[:cut], size), ranks.get(t[cut:], size)
                if a < r and b < r and self.follows(a, b):
                    self.merged[a, b] = r
                    self.left[r], self.right[r] = a, b
                    break
        lengths = np.fromiter(map(len, self.token), np.int64, size)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.powers = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        self.token_ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.token_index = Lookup(np.array([self.hash(t) for t in ranks], np.uint64))
        self.pair_ids = np.fromiter(self.merged.values(), np.int64, len(self.merged))
        self.pair_index = Lookup(np.array([a << 32 | b for a, b in self.merged], np.uint64))
        self.lefts, self.rights = np.array(self.left), np.array(self.right)
        self.segments: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def hash(token: bytes) -> int:
        h = 0
        for byte in token:
            h = (h * int(BASE) + byte + 1) % (1 << 64)
        return h

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves token ``b`` right after token ``a``, each as it is."""
        merged, left, right = self.merged, self.left, self.right
        bound = len(self.token)
        while True:
            if merged.get((a, b), bound) < bound:
                return False
            if a > b:
                bound, a = a, right[a]
                if a == bound:
                    bound, b = b + 1, left[b]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, left[b]
                if b + 1 == bound:
                    bound, a = a, right[a]
                    if a == bound:
                        return True

    def last_token(self, text: bytes, end: int, last: list[int], table_end: int = 0) -> int:
        """The token that ends the encoding of ``text[:end]``; ``last[i]`` is that of ``text[:i]`` for smaller i."""
        for start in range(max(0, end - self.longest), end):
            t = self.ranks.get(text[start:end])
            if t is not None and (start == 0 or self.follows(last[start], t)):
                return t
        raise ValueError(f"byte {text[end - 1]} is no token")

    def prefixes(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes of a piece, at index 1 and on; ``last`` holds those already known, and grows."""
        last = [-1] if last is None else last
        for end in range(len(last), len(piece) + 1):
            last.append(self.last_token(piece, end, last))
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end > 0:
            ids.append(last[end])
            end -= len(self.token[last[end]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.walk_back(self.prefixes(piece))

    def follow_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` for arrays of tokens."""
        ok, at, bound = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), len(self.token))
        while len(at):
            m = self.pair_index.find((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            bad = (m >= 0) & (self.pair_ids[m] < bound)
            ok[at[bad]] = False
            first = a > b  # undo the token of higher rank; where it is a single byte, the other one
            ra, lb = self.rights[a], self.lefts[b]
            a_stays, b_stays = ra == a, lb == b
            undo_a = np.where(first, ~a_stays, b_stays)
            on = ~bad & ~(a_stays & b_stays) & ~(first & a_stays & b_stays)
            bound = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, ra, a), np.where(undo_a, b, lb)
            at, a, b, bound = at[on], a[on], b[on], bound[on]
        return ok

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pieces: the prefix tables of all of them grow together, one byte a step."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        width = int(size[0]) if n else 0
        text = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in order]), np.uint8).reshape(n, width)
        hashes = np.zeros((width + 1, n), np.uint64)
        last = np.full((width + 1, n), -1, np.int64)
        live = np.searchsorted(-size, -np.arange(width + 1), side="right")  # rows of at least so many bytes
        for end in range(1, width + 1):
            k = live[end]
            hashes[end, :k] = hashes[end - 1, :k] * BASE + text[:k, end - 1].astype(np.uint64) + np.uint64(1)
            open_ = np.arange(k)
            for start in range(max(0, end - self.longest), end):
                t = self.token_index.find(hashes[end, open_] - hashes[start, open_] * self.powers[end - start])
                hit = np.flatnonzero(t >= 0)
                if not len(hit):
                    continue
                rows, t = open_[hit], self.token_ids[t[hit]]
                if start:
                    fits = self.follow_many(last[start, rows], t)
                    hit, rows, t = hit[fits], rows[fits], t[fits]
                last[end, rows] = t
                open_ = np.delete(open_, hit)
        ids, end, rows = np.full((width, n), -1, np.int64), size.copy(), np.arange(n)
        step = width
        while len(rows):
            step -= 1
            t = last[end[rows], rows]
            ids[step, rows] = t
            end[rows] -= self.lengths[t]
            rows = rows[end[rows] > 0]
        flat = ids.T
        counts = (flat >= 0).sum(axis=1)
        flat = flat[flat >= 0].astype("<u4").tobytes()
        out, at = [b""] * n, 0
        for i, c in zip(order.tolist(), (4 * counts).tolist(), strict=True):
            out[i] = flat[at : at + c]
            at += c
        return out

    def learn(self, segments: list[str]) -> None:
        """Put the ids of new segments into the memo."""
        cut, known = {}, {}
        for s in segments:
            letters = s[1:] if s[0] == " " else s
            plain = self.segmented and letters.isalpha() and max(letters) < "\u0250"  # a run of letters is one piece
            cut[s] = [p.encode("utf-8", "surrogatepass") for p in ([s] if plain else self.pieces.findall(s))]
        pieces = {p for ps in cut.values() for p in ps}
        for low, high in ((0, 12), (12, 24), (24, MEMO_CHARS)):
            some = [p for p in pieces if low < len(p) <= high]
            for at in range(0, len(some), PIECES):
                known.update(zip(some[at : at + PIECES], self.encode_many(some[at : at + PIECES]), strict=True))
        for p in pieces.difference(known):
            known[p] = array("I", self.encode_piece(p)).tobytes()
        for s, ps in cut.items():
            self.segments[s] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])
            self.held += 220 + 5 * len(s)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.held > MEMO_BYTES:
            self.segments.clear()
            self.held = 0
        memo, parts = self.segments, [SEGMENT.findall(t) if self.segmented else [t] * bool(t) for t in texts]
        self.learn(list(set().union(*parts).difference(memo)))
        out = [b"".join(map(memo.__getitem__, p)) for p in parts]
        for s in [s for s in set().union(*parts) if len(s) > MEMO_CHARS]:
            self.held -= 220 + 5 * len(s)
            del memo[s]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of one text; a long one is cut where white space follows another character, as a segment starts there."""
        cuts = [0]
        while self.segmented and len(text) - cuts[-1] > TEXT_CHARS and (m := CUT.search(text, cuts[-1] + TEXT_CHARS)):
            cuts.append(m.start())
        return b"".join(self.encode_batch([text[i:j]])[0] for i, j in zip(cuts, [*cuts[1:], len(text)], strict=True))

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, in portions of bounded size."""
        out = []
        for part in chunks(texts):
            out += self.encode_batch(part) if len(part) > 1 else [self.encode(part[0])]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of(ids[at : at + IDS]) for at in range(0, len(ids), IDS))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


#: A space may lead a run of other characters; no piece reaches from one such segment into the next.
SEGMENT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


class PrefixText:
    """One text with its encoding, kept up to date: ``append`` and ``edit`` re-encode only the pieces that change."""

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text, self.ids_of = bpe, "", []
        self.starts: list[int] = []
        self.edit(0, 0, text)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]``; returns how many pieces were encoded."""
        text = self.text[:start] + new + self.text[end:]
        keep = 0  # pieces that end well before the edit stay: a piece looks one character past its end
        while self.bpe.segmented and keep + 2 < len(self.starts) and self.starts[keep + 2] < start:
            keep += 1
        at = self.starts[keep] if keep < len(self.starts) else 0
        starts, ids = self.starts[:keep], self.ids_of[:keep]
        shift, old = len(text) - len(self.text), {s: i for i, s in enumerate(self.starts) if s >= end}
        done = 0
        for m in self.bpe.pieces.finditer(text, at):
            i = old.get(m.start() - shift) if self.bpe.segmented and m.start() >= start + len(new) else None
            if i is not None:  # from here on the pieces are those of the old text
                starts += [s + shift for s in self.starts[i:]]
                ids += self.ids_of[i:]
                break
            starts.append(m.start())
            ids.append(self.bpe.encode_piece(m.group().encode()))
            done += 1
        self.text, self.starts, self.ids_of = text, starts, ids
        return done

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    @property
    def ids(self) -> list[int]:
        return [i for piece in self.ids_of for i in piece]


_loaded: dict[tuple[str, str], PrefixBpe] = {}


def bpe_of(path: str, pattern: str) -> PrefixBpe:
    """The encoder of a rank file, built once in each Python worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = PrefixBpe(load_ranks(path), pattern)
    return _loaded[path, pattern]


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != name}
    return pa.RecordBatch.from_arrays([*cols.values(), column], [*cols, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, at most ``TEXT_CHARS`` characters at a time; a longer text comes alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > TEXT_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    out: str = "ids",
    keep_text: bool = True,
    decoded: str | None = None,
) -> DataFrame:
    """Adds ``out``, the ids of each whole text (array<int>), as the rank file and piece pattern give them.

    Where ``decoded`` names a column, it gets what ``decode`` makes of those ids, in the same Python worker.
    """

    def run(batches):
        bpe = bpe_of(path, pattern)
        for b in slices(batches):
            got = bpe.encode_texts([t or "" for t in b.column(text).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(got), "<i4"), pa.int32())
            if not keep_text:
                b = b.drop_columns([text])
            b = _with(b, out, pa.ListArray.from_arrays(pa.array(offsets), ids))
            if decoded:
                b = _with(b, decoded, pa.array([bpe.decode(np.frombuffer(x, "<i4")) for x in got], pa.binary()))
            yield b

    small_batches(df.sparkSession)
    base = df if keep_text else df.drop(text)
    kinds = _schema(base, out, T.ArrayType(T.IntegerType()))
    if decoded:
        kinds = T.StructType([*(f for f in kinds.fields if f.name != decoded), T.StructField(decoded, T.BinaryType())])
    return df.mapInArrow(run, kinds)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for; null ids decode to no bytes."""

    def run(batches):
        bpe = bpe_of(path, pattern)
        for b in slices(batches):
            lists = b.column(ids)
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            null = lists.is_null().to_numpy(zero_copy_only=False)
            got = [b"" if n else bpe.decode(flat[i:j]) for i, j, n in zip(off[:-1], off[1:], null, strict=True)]
            yield _with(b, out, pa.array(got, pa.binary()))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, _schema(df, out, T.BinaryType()))
