"""Files written and rows held by as many tasks as they need."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from boreflow.operators.places import bounded
from boreflow.plans import intake
from boreflow.sources import logs


def test_few_bytes_of_many_files_are_written_by_many_tasks(spark, tmp_path):
    rows = [(i, f"*** A ***\nline {i}\n") for i in range(80)]
    logs.write_texts(spark.createDataFrame(rows, "hole int, value string").coalesce(1), str(tmp_path / "x"), "hole")
    parts = {m[1] for _, _, names in os.walk(tmp_path) for n in names if (m := re.match(r"part-(\d+)", n))}
    assert len(parts) > 4
    got = logs.log_lines(spark, str(tmp_path / "x")).select(logs.hole_of("file"), "line", "text").collect()
    assert sorted(map(tuple, got)) == sorted(r for i in range(80) for r in ((i, 0, "*** A ***"), (i, 1, f"line {i}")))


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 50)
    few = bounded(df, "k", rows=1000)
    assert few is df
    dealt = bounded(df, "k", rows=20).withColumn("p", F.spark_partition_id())
    assert dealt.rdd.getNumPartitions() == 50
    assert dealt.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert bounded(df, "k", rows=20, counted=spark.range(3)) is df


def test_lines_are_dealt_by_the_pieces_of_a_folder(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.xls").write_text("a\nb\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        lines = logs.log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() == 300 // 4
        assert lines.count() == 600
    finally:
        spark.conf.set(key, before)


def files_below(path):
    return {os.path.relpath(os.path.join(at, n), path) for at, _, names in os.walk(path) for n in names}


def test_message_files_are_all_that_is_written_for_triples(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k,) for k in range(1, 41)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(intake, "scratch_path", lambda _, name: f"file://{tmp_path}/{name}")
    got = __spark_entry__.queries()["s15_message_triples"](spark, str(tmp_path)).collect()
    late, none = [k for k in range(1, 41) if k % 5 == 0], [k for k in range(1, 41) if k % 5 and k % 7 == 0]
    want = [(k, "trace times differ" if k in late else "no heads message" if k in none else None) for k in range(1, 41)]
    assert sorted((int(r.folder), r.error) for r in got) == want
    kinds = ("ResultManagement", "Trace", "Heads")
    written = {re.sub(r"^group=\d+/", "", f) for f in files_below(tmp_path / "triples")}
    assert written == {f"folder=f{k}/{n}.json" for k in range(1, 41) for n in kinds if n != "Heads" or k % 7}


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_message_files_hold_their_rows_in_any_store(spark, tmp_path, store):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.triples.link./x", f"file://{tmp_path}")
    path = {"file": f"file://{tmp_path}", "viewfs": "viewfs://triples/x"}[store] + "/y"
    assert logs.local_folder(spark, path) == (f"{tmp_path}/y" if store == "file" else None)
    text = '{"SourceTimestamp": "ü"}'
    rows = [(f, k, text) for f in ("a", "b c", None) for k in ("ResultManagement", "Trace", "Heads")] + [("d", "Heads", None), ("e", "Trace", text), ("e", "Trace", text)]
    groups = logs.write_messages(spark.createDataFrame(rows, "folder string, kind string, value string").repartition(5), path)
    assert all(re.fullmatch(re.escape(path) + r"/group=\d+", g) for g in groups) and len(set(groups)) == len(groups) <= 5
    got = {(r.result, r.trace, r.heads, r.ts, r.error) for r in logs.message_triples(spark, path).collect()}
    line = text + "\n"
    assert got == {(line, line, line, "ü", None), (None, None, "\n", None, "no result message"), (None, line * 2, None, None, "no result message")}
    folders = {r.folder for r in logs.message_triples(spark, groups).collect()}
    assert folders == {f"folder={f}" for f in ("a", "b%20c", "__HIVE_DEFAULT_PARTITION__", "d", "e")}


def test_messages_of_no_folder_are_an_empty_table(spark, tmp_path):
    groups = logs.write_messages(spark.createDataFrame([], "folder string, kind string, value string"), str(tmp_path / "x"))
    assert logs.grouped_triples(spark, groups, str(tmp_path / "y"), "folder", "error").count() == 0


def test_triples_of_many_groups_are_listed_some_at_a_time(spark, tmp_path, monkeypatch):
    rows = [(f"f{i}", k, f'{{"SourceTimestamp": "{i}"}}') for i in range(60) for k in ("ResultManagement", "Trace", "Heads")]
    groups = logs.write_messages(spark.createDataFrame(rows, "folder string, kind string, value string"), str(tmp_path / "x"))
    assert len(groups) > 32
    listed, read = [], logs.message_triples
    monkeypatch.setattr(logs, "LISTED", 20)
    monkeypatch.setattr(logs, "message_triples", lambda s, paths: listed.append(paths) or read(s, paths))
    got = logs.grouped_triples(spark, groups, str(tmp_path / "y"), "folder", "ts").collect()
    assert sorted(map(tuple, got)) == sorted((f"folder=f{i}", str(i)) for i in range(60))
    assert sum(listed, []) == groups and max(map(len, listed)) == 20


def test_messages_stay_below_their_folder(spark, tmp_path):
    with pytest.raises(Exception, match="no names of files"):
        logs.write_messages(spark.createDataFrame([("../up", "Trace", "x")], "folder string, kind string, value string"), str(tmp_path / "x"))
