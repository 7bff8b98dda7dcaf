"""WARC records and a Merkle fixity audit of their replicas.

Records lie in archives at byte offsets.  A replica is a table (archive, offset, record).  Its tree has the hashes of
records as leaves; above them stand ordered offset ranges of ``LEAF_RANGE`` bytes, then ranges ``FANOUT`` times as long,
up to one root for each archive.  Ranges are cut by offset, so every node is a small group whatever an archive holds.
An audit compares roots and descends only from nodes that differ, down to the records that are corrupt, missing or extra.

A null url or html is empty; a null page_id belongs to archive ``none``. Records that share archive and offset are hashed
together in the order of their bytes. Empty replicas have no roots: against one, all records of the other are missing or extra.
Further columns of the pages are not written. Pages of any length are one record; equal pages stand one after the other.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreflow.llm.shared import Scratch

LEAF_RANGE, FANOUT = 1 << 16, 16
PAGES_PER_ARCHIVE = 1024
DATE = "2024-01-01T00:00:00Z"


def record_of(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """A WARC 1.1 response record, as text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def pack(pages: DataFrame, per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """Rows (archive, offset, length, page_id, record): pages in id order, so many ids to an archive."""
    record = record_of(F.col("page_id"), F.col("url"), F.col("html"))
    archive = F.coalesce(F.floor(F.col("page_id") / per_archive).cast("string"), F.lit("none"))
    rows = pages.select(archive.alias("archive"), "page_id", record.alias("record"))
    rows = rows.withColumn("length", F.octet_length("record").cast("bigint"))
    before = Window.partitionBy("archive").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return rows.select("archive", "offset", "length", "page_id", F.col("record").cast("binary").alias("record"))


def write(pages: DataFrame, path: str) -> None:
    """WARC files in page order, one or more to a task."""
    record = record_of(F.col("page_id"), F.col("url"), F.col("html"))
    ordered = pages.repartitionByRange("page_id").sortWithinPartitions("page_id", "url", "html")
    bare = ordered.select(record.alias("value")).select(F.expr("substring(value, 1, length(value) - 2)").alias("value"))
    bare.write.option("lineSep", "\r\n").text(path)  # the separator is the last line end of each record


def _records(data: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(begin, end, uri) of each record; what is no whole record up to the next one that begins has a null uri."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        lines = data[at : max(head, at)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        known = size.isascii() and size.isdigit() and len(size) <= 18  # no file is longer than that says
        end = head + 8 + int(size) if known and lines[0].startswith("WARC/") else 0
        if end > at and data[end - 4 : end] == b"\r\n\r\n" and (end == len(data) or data.startswith(b"WARC/", end)):
            yield at, end, fields.get("warc-target-uri", "")
        else:
            end = data.find(b"\r\n\r\nWARC/", at) + 4
            end = end if end > at + 4 else len(data)
            yield at, end, None
        at = end


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (archive, offset, uri, record, damaged) of all WARC files under a path, plain or gzipped; a file is read by one task.

    Bytes that are no whole record (no length, a wrong one, a cut end) come as a ``damaged`` row of their own, up to the next
    record that begins, and reading goes on there; a gzip file that cannot be unpacked is one damaged row.
    """

    def parse(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data, found = raw, None
                if raw[:2] == b"\x1f\x8b":
                    try:
                        data = gzip.decompress(raw)
                    except (OSError, EOFError, zlib.error):
                        found = [(0, len(raw), None)]
                rows = [
                    {"archive": name, "offset": at, "uri": uri, "record": data[at:end], "damaged": uri is None}
                    for at, end, uri in found or _records(data)
                ]
                yield pa.RecordBatch.from_pylist(rows, OUT)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "archive string, offset bigint, uri string, record binary, damaged boolean")


OUT = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("uri", pa.string()), ("record", pa.binary()), ("damaged", pa.bool_())]
)


def leaves(replica: DataFrame) -> DataFrame:
    """Level 0 of a tree: (archive, at, hash, length) of each offset."""
    one = F.struct(F.sha2("record", 256).alias("hash"), F.octet_length("record").cast("bigint").alias("length"))
    rows = replica.select("archive", F.col("offset").alias("at"), one.alias("r"))
    hashes = F.transform(F.sort_array(F.collect_list("r")), lambda x: x["hash"])
    lengths = F.aggregate(F.collect_list(F.col("r.length")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    grouped = rows.groupBy("archive", "at").agg(hashes.alias("hs"), lengths.alias("length"))
    joined = F.when(F.size("hs") == 1, F.col("hs")[0]).otherwise(F.sha2(F.array_join("hs", ""), 256))
    return grouped.select("archive", "at", joined.alias("hash"), "length")


def level_above(below: DataFrame, span: int) -> DataFrame:
    """Nodes over ranges of ``span`` bytes: the hash of their children's offsets and hashes in order."""
    child = F.struct("at", "hash")
    grouped = below.groupBy("archive", (F.floor(F.col("at") / span) * span).alias("up")).agg(
        F.sort_array(F.collect_list(child)).alias("cs")
    )
    text = F.array_join(F.transform("cs", lambda c: F.concat(c["at"].cast("string"), F.lit(":"), c["hash"])), "\n")
    return grouped.select("archive", F.col("up").alias("at"), F.sha2(text, 256).alias("hash"))


def spans_of(*leaf_levels: DataFrame) -> list[int]:
    """Range lengths of the levels above the records, up to one range over the longest archive."""
    longest = max(df.agg(F.coalesce(F.max("at"), F.lit(0)).alias("m")).first().m for df in leaf_levels)
    spans = [LEAF_RANGE]
    while spans[-1] <= longest:
        spans.append(spans[-1] * FANOUT)
    return spans


def audit(a: DataFrame, b: DataFrame, scratch: Scratch) -> DataFrame:
    """Records that differ: archive, offset, status (corrupt, missing or extra in b), both hashes and lengths."""
    leaf_a, leaf_b = scratch.save(leaves(a), "a-0"), scratch.save(leaves(b), "b-0")
    spans = spans_of(leaf_a, leaf_b)
    trees = []
    for name, leaf in (("a", leaf_a), ("b", leaf_b)):
        levels = [leaf]
        for n, span in enumerate(spans, 1):
            levels.append(scratch.save(level_above(levels[-1], span), f"{name}-{n}"))
        trees.append(levels)
    suspects = None
    for n in range(len(spans), -1, -1):
        x, y = trees[0][n], trees[1][n]
        if suspects is not None:  # only below nodes that differ
            span = spans[n]
            up = (F.floor(F.col("at") / span) * span).alias("up")
            x, y = (t.select("*", up).join(suspects, ["archive", "up"], "left_semi").drop("up") for t in (x, y))
        extra = ["length"] if n == 0 else []
        x = x.select("archive", "at", *(F.col(c).alias(f"{c}_a") for c in ("hash", *extra)))
        y = y.select("archive", "at", *(F.col(c).alias(f"{c}_b") for c in ("hash", *extra)))
        found = x.join(y, ["archive", "at"], "full_outer").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if n:
            suspects = scratch.save(found.select("archive", F.col("at").alias("up")), f"suspects-{n}")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
    return found.select("archive", F.col("at").alias("offset"), status.alias("status"), "hash_a", "hash_b", "length_a", "length_b")
