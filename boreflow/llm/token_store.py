"""Token ids as binary files: frames of separately compressed documents with one shared dictionary.

Layout of a store (a folder on any file system that Spark reaches):

``dictionary``  one row: ``dict_hash`` (sha256) and the zstandard dictionary, trained on serialized id arrays of a bounded
                sample of documents (it decides the size of the files, never what they hold).
``frames``      rows of about ``FRAME_BYTES``, in ascending doc_id order: ``part``, ``frame``, ``first_doc``, ``last_doc``,
                ``n_tokens``, the ``dict_hash``, the index (``doc_ids``, ``counts``, and ``offsets`` of each document in
                the payload) and the ``payload``, in which every document is a zstandard frame of its own.
``totals``      tokens of each part, from which the global position of each document follows.

A document is read by finding the frame whose doc_id range holds it (Parquet statistics skip the others) and
decompressing its slice alone.

Null texts count as empty; every document ends with the end id. Rows with equal doc_id follow each other by text; null
doc_ids come first. Further columns of the input are not stored. An empty table gives an empty store. Texts of any length
are encoded whole. Any file of the tokenizers library will do; one with dropout is refused, as its ids are not fixed.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payload bytes after which a frame ends.
FRAME_BYTES = 1 << 20
#: Bytes of memoised words in one Python worker before the memo starts anew.
MEMO_BYTES = 208 << 20
#: Bounds of the sample that trains the dictionary: documents, bytes of ids, and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 1000, 4 << 20, 64 << 10

FRAMES = (
    "part int, frame int, first_doc bigint, last_doc bigint, n_tokens bigint, width int, dict_hash string, "
    "doc_ids array<bigint>, counts array<bigint>, offsets array<bigint>, payload binary"
)


#: How a tokenizer file cuts text into words where words may be encoded alone (fixed value of such files): white space is left out.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of whole texts that are encoded at once with other tokenizers.
WHOLE_CHARS = 256 << 10


def by_words(spec: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never looks across it, so that its words may be encoded alone."""
    normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, cuts = normal.get("normalizers", [normal]), cut.get("pretokenizers", [cut])
    kinds = {x.get("type") for x in steps}
    spaces = [x for x in steps if x.get("type") == "Replace"]
    plain = all(x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in spaces)
    split = {"type": "Split", "pattern": {"Regex": WORDS_ONLY}, "behavior": "Removed", "invert": True}
    inside = [x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in cuts[1:]]
    names = [t["content"] for t in spec.get("added_tokens") or []]
    strict = not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    tokens = strict and all("<|" in n and not any(map(str.isspace, n)) for n in names)
    return kinds <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds and plain and cuts[0] == split and all(inside) and tokens


class WordEncoder:
    """Whole texts to ids. With a tokenizer that drops white space, what stands between spaces is encoded once and remembered;
    with any other, texts are encoded whole by the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("model", {}).get("dropout"):
            raise ValueError("a tokenizer with dropout gives other ids each time")
        self.words = by_words(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        most = max(self.tokenizer.get_vocab().values(), default=0)
        self.dtype, self.code = ("<u2", "H") if most < 1 << 16 else ("<u4", "I")
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.held = 0

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return self._by_words(texts) if self.words else self._whole(texts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            end, n = at, 0
            while end < len(texts) and n < WHOLE_CHARS:
                n += len(texts[end])
                end += 1
            found = self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False)
            out += [array(self.code, e.ids).tobytes() for e in found]
            at = end
        return out

    def _by_words(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            memo[b""], self.held = b"", 0
        parts = [_folded(t).replace(b"\n", b" ").split(b" ") for t in texts]
        new = list(set().union(*parts).difference(memo))
        words = [w.decode("utf-8", "surrogatepass") for w in new]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            memo[w] = array(self.code, e.ids).tobytes()
            self.held += 200 + 5 * len(w)
        out = [b"".join(map(memo.__getitem__, p)) for p in parts]
        for w in [w for w in new if len(w) > 64]:
            self.held -= 200 + 5 * len(w)
            del memo[w]
        return out


def _folded(text: str) -> bytes:
    """UTF-8 with A-Z in lower case, as the tokenizer makes it; not where the name of a special token may stand."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw if b"<|" in raw else raw.lower()


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _texts(batches: Iterator[pa.RecordBatch], chars: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the first documents at hand; empty where there are too few to train one."""

    def serialized(batches):
        enc, size = encoder_of(tokenizer), 0
        for _, texts in _texts(batches):
            for x in enc.encode_batch(texts):
                for at in range(0, len(x), 1 << 14):
                    if size < SAMPLE_BYTES:
                        size += len(x[at : at + (1 << 14)])
                        yield pa.RecordBatch.from_arrays([pa.array([x[at : at + (1 << 14)]], pa.binary())], ["x"])

    rows = docs.limit(SAMPLE_DOCS).coalesce(1).mapInArrow(serialized, "x binary").collect()
    samples = [bytes(r.x) for r in rows if len(r.x) >= 16]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", level: int = 3
) -> None:
    """Encode every whole text and write the store at ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    trained = train_dictionary(docs, tokenizer, end_id)
    dict_hash = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(trained))], "dict_hash string, dictionary binary").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")

    def frames(batches):
        from pyspark import TaskContext

        enc, part, number = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared)
        end = np.array([end_id], enc.dtype).tobytes()
        width = len(end)
        ids, counts, offsets, payload = [], [], [0], bytearray()

        def frame():
            row = [part, number, ids[0], ids[-1], sum(counts), width, dict_hash, ids, counts, offsets, bytes(payload)]
            return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, row, strict=True))], SCHEMA)

        for doc_ids, texts in _texts(batches):
            for i, x in zip(doc_ids, enc.encode_batch(texts), strict=True):
                x += end
                payload += packer.compress(x)
                ids.append(i)
                counts.append(len(x) // width)
                offsets.append(len(payload))
                if len(payload) >= FRAME_BYTES:
                    yield frame()
                    ids, counts, offsets, payload, number = [], [], [0], bytearray(), number + 1
        if ids:
            yield frame()

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(frames, FRAMES).write.parquet(f"{path}/frames")
    spark.read.schema(FRAMES).parquet(f"{path}/frames").groupBy("part").agg(
        F.sum("n_tokens").alias("n_tokens")
    ).write.parquet(f"{path}/totals")


SCHEMA = pa.schema(
    [("part", pa.int32()), ("frame", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]
    + [("n_tokens", pa.int64()), ("width", pa.int32()), ("dict_hash", pa.string())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "counts", "offsets")]
    + [("payload", pa.binary())]
)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary is not the one that the store was written with")
    return row.dict_hash, bytes(row.dictionary)


def _unpack(frames: DataFrame, dict_hash: str, trained: bytes, wanted: frozenset | None = None) -> DataFrame:
    def run(batches):
        shared = zstandard.ZstdCompressionDict(trained) if trained else None
        reader = zstandard.ZstdDecompressor(dict_data=shared)
        for b in batches:
            for f in b.to_pylist():
                if f["dict_hash"] != dict_hash:
                    raise ValueError("a frame was written with another dictionary")
                start, rows = f["base"], []
                for n, i in enumerate(f["doc_ids"]):
                    if wanted is None or i in wanted:
                        raw = reader.decompress(f["payload"][f["offsets"][n] : f["offsets"][n + 1]])
                        x = np.frombuffer(raw, "<u2" if f["width"] == 2 else "<u4").astype("<u4").tobytes()
                        rows.append((i, start, f["counts"][n], x))
                    start += f["counts"][n]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(OUT.names, r, strict=True)) for r in rows], OUT
                )

    return frames.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Frames with ``base``, the position of their first token among all tokens."""
    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    totals = spark.read.parquet(f"{path}/totals")  # a row for each part: as many as the write had tasks
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    bases = frames.select("part", "frame", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    bases = bases.join(totals, "part").select("part", "frame", (F.col("before") + F.col("inside")).alias("base"))
    return frames.join(bases, ["part", "frame"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a store: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers)."""
    return _unpack(_placed(spark, path), *_dictionary(spark, path))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """A few documents: only frames whose range holds one of them are read, and only their slices decompressed."""
    frames = _placed(spark, path)
    near = F.lit(False)
    for i in doc_ids:
        near = near | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    return _unpack(frames.where(near), *_dictionary(spark, path), frozenset(doc_ids))
