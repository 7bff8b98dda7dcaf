"""Scratch space that every executor can reach, and small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder from ``spark.checkpoint.dir``; a local session without one (tests) gets its own, a cluster is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="boreflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of one Arrow batch between the JVM and Python; Spark's own bound is 64 MB, several times over in each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as whole texts may be long rows; a bound that the session sets itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") == "64m":  # what is given here comes back where nothing is set
        spark.conf.set(key, str(BATCH_BYTES))


#: Scratch tables made in the present thread or context since ``cleaned`` began there.
_held: ContextVar[list[Scratch] | None] = ContextVar("held", default=None)


@contextmanager
def cleaned():
    """Drops the scratch tables made inside, once what was computed from them is written."""
    mine: list[Scratch] = []
    before = _held.set(mine)
    try:
        yield
    finally:
        _held.reset(before)
        for scratch in mine:
            scratch.drop()


class Scratch:
    """Tables of one operator run, written as Parquet to the shared folder so that lineage ends at replicated files."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        held = _held.get()
        if held is not None:
            held.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.load(df, name)

    def load(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; with no name, the whole run."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in [self.path(n) for n in names] or [self.base]:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
