"""From raw documents to token ids: quality rules, near-dedup, repeated strings, leaks, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the last return the columns
of documents, further ones of the caller untouched.  Between stages the rows are written as Parquet to the shared folder and
read again; what a stage wrote for itself goes once its result is written.

Null and empty texts have under 50 words, so the quality stage drops them; any that a later stage is given stay, without ids.
Of rows that repeat an id and a text one stays; rows with a null id are documents like others, and the last of their group to
lead it. An empty table gives an empty result. Texts of any length are read whole. Ties go to the smallest id, then version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boreflow.llm import byte_bpe, decontaminate, minmax_dedup, quality, suffix_index
from boreflow.llm.queries import piece_pattern, tokenizer_path
from boreflow.llm.shared import Scratch, cleaned, fresh, read


def _same(docs: DataFrame, marks: DataFrame, version=None):
    """Rows of ``docs`` and of ``marks`` (doc_id, version) that are the same document."""
    version = F.xxhash64(docs["text"]) if version is None else version
    return docs["doc_id"].eqNullSafe(marks["doc_id"]) & (version == marks["version"])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio.

    The verdicts are written beside the rows and the filter reads them: a filter on the expressions themselves would be
    pushed below them, and each use would count all n-grams anew.
    """
    model = quality.ratio_model(docs, read(spark, sf_dir, "labels").where("quality = 1"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    judged = Scratch(spark, "quality").save(quality.judge(rows, model).select("row", "kept"), "judged")
    return judged.where("kept").select("row.*")


#: Percent of shared shingles from which documents are near copies.
NEAR = 80


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, of the smallest id and then version, and all rows without words."""
    scratch = Scratch(spark, "near")
    found = minmax_dedup.near_groups(docs, scratch, percent=NEAR).where("n_shingles > 0")
    marks = found.groupBy("doc_id", "version").agg(F.max("first").alias("first"), F.count("*").alias("n"))
    marks = scratch.save(marks.where("not first or n > 1"), "marks")
    twice = marks.where("first")
    version = fresh(docs, "version")[0]
    one = docs.join(twice, _same(docs, twice), "left_semi").withColumn(version, F.xxhash64("text"))
    one = one.dropDuplicates(["doc_id", version]).drop(version)
    return docs.join(marks, _same(docs, marks), "left_anti").union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that start elsewhere too; n_chars follows."""
    found = suffix_index.removals(docs, Scratch(spark, "repeats")).select("doc_id", "version", "kept_text")
    cut, kept = fresh(docs, "cut", "kept_text")
    found = found.withColumnRenamed("kept_text", kept).withColumn(cut, F.lit(True))
    joined = docs.join(found, _same(docs, found, F.xxhash64(F.coalesce(docs["text"], F.lit("")))), "left")
    text = F.when(F.col(cut), F.col(kept)).otherwise(docs["text"])
    new = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        chars = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(cut), chars).otherwise(docs["n_chars"]).alias("n_chars")
    return joined.select(*(new.get(c, docs[c]) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))
    gone = found.where("spans is not null").select("doc_id", "version").distinct()
    return docs.join(gone, _same(docs, gone), "left_anti")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number; the decoded ids are the text."""
    how = tokenizer_path("byte_bpe_50k.tiktoken"), piece_pattern()
    back = byte_bpe.encode(docs.select("doc_id", "text"), *how, keep_text=False, decoded="decoded")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("byte_bpe", to_tokens),
]

#: Suffix arrays and merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        with cleaned():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])
    return docs
