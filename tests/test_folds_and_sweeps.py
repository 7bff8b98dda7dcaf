"""Greedy matching and repeats on busy keys, depth sweeps in one pass, log lines of files in pieces."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boreflow.operators import depth, joins
from boreflow.sources import logs
from boreflow.streaming import live

T0 = datetime(2024, 1, 1)


@pytest.fixture
def small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, before)


def repeats(rows, step):
    """Marks of (key, content, seconds, row) by plain Python."""
    last, out = {}, {}
    for k, v, t, i in sorted(rows, key=lambda r: (r[2], r[3])):
        again = (k, v) in last and t - last[k, v] < step
        if not again:
            last[k, v] = t
        out[i] = again
    return out


def test_repeats_of_a_busy_key(spark, small_batches):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", None]), rng.randrange(400), i) for i in range(1500)]
    df = spark.createDataFrame([(k, v, T0 + timedelta(seconds=t), i, [i]) for k, v, t, i in rows], "k string, v string, ts timestamp, i int, extra array<int>")
    got = joins.duplicates(df, "k", "ts", "v", 5, "i")
    assert got.columns == [*df.columns, "is_duplicate"]
    marks = {r.i: r.is_duplicate for r in got.collect()}
    assert marks == repeats(rows, 5)
    assert all(r.extra == [r.i] for r in got.collect())


def test_repeats_of_nothing_and_without_times(spark):
    df = spark.createDataFrame([("a", "x", None, 1), ("a", "x", None, 2), ("a", "x", T0, 3), ("a", "x", T0, 4)], "k string, v string, ts timestamp, i int")
    assert {r.i: r.is_duplicate for r in joins.duplicates(df, "k", "ts", "v", 5, "i").collect()} == {1: False, 2: False, 3: False, 4: True}
    assert joins.duplicates(df.where("false"), "k", "ts", "v", 5, "i").count() == 0


def greedy(pairs):
    """Matches of (key, left, time, right, time) by plain Python."""
    lefts, rights, out = set(), set(), set()
    for k, a, left, b, right in sorted((str(k), a, left, b, right) for k, left, a, right, b in pairs):
        if (k, left) not in lefts and (k, right) not in rights:
            lefts.add((k, left))
            rights.add((k, right))
            out.add((k, left, right))
    return out


def test_greedy_match_of_a_busy_key(spark, small_batches):
    rng = random.Random(5)
    lefts = [(rng.choice(["a", "a", "b", None]), i, rng.randrange(300)) for i in range(250)]
    rights = [(rng.choice(["a", "a", "b", None]), 1000 + i, rng.randrange(300)) for i in range(250)]
    pairs = [(k, i, s, j, t) for k, i, s in lefts for m, j, t in rights if k == m and abs(s - t) <= 6]
    rows = [(k, i, T0 + timedelta(seconds=s), j, T0 + timedelta(seconds=t)) for k, i, s, j, t in pairs]
    df = spark.createDataFrame(rows, "tool string, result bigint, ts_r timestamp, trace bigint, ts_t timestamp")
    got = joins.greedy_match(df, "tool", "result", "trace", "ts_r", "ts_t")
    assert {(str(r.tool), r.result, r.trace) for r in got.collect()} == greedy(pairs)
    assert got.count() == len(greedy(pairs))
    assert joins.greedy_match(df.where("false"), "tool", "result", "trace", "ts_r", "ts_t").count() == 0


def holes(spark):
    rng = random.Random(11)
    rows = []
    for hole in range(6):
        for i in range(700 if hole else 30):  # hole 0 ends before any exit
            p = i * 0.05
            rows.append((hole, i, -p, (2.0 if 3 < p < 3 + 15 + hole / 2 else 0.0) + rng.random() / 10))
    return spark.createDataFrame(rows, "hole_id bigint, idx bigint, pos_mm double, torque_a double")


def test_sweep_equals_single_runs(spark):
    df = holes(spark).cache()
    cells = depth.depth_sweep(df, "torque_a", [10, 20], [12.0, 15.0], [4.0, 8.0])
    got = {(r.n, r.expected, r.win, r.hole_id): (r.xa, r.xb) for r in cells.collect()}
    assert len(got) == 2 * 2 * 2 * 6
    for n in (10, 20):
        for expected in (12.0, 15.0):
            for win in (4.0, 8.0):
                for r in depth.reference_depth(df, "torque_a", n=n, expected=expected, win=win, taper=False).collect():
                    assert got[n, expected, win, r.hole_id] == (r.xa, r.xb)
    low = depth.sweep_summary(cells).where("n = 10 and expected = 15 and win = 8").first()
    assert low.missing >= 1 and low.holes + low.missing == 6


def test_choices_equal_single_runs(spark):
    df = holes(spark)
    got = {r.hole_id: r for r in depth.depths_by_choice(df, "torque_a").collect()}
    for mode in ("max", "first", "last"):
        for r in depth.reference_depth(df, "torque_a", mode=mode).collect():
            assert (got[r.hole_id][f"xa_{mode}"], got[r.hole_id][f"depth_{mode}"]) == (r.xa, r.depth)


def test_lines_of_files_in_pieces(spark, tmp_path):
    texts = {"a.xls": "é one\r\n\r\n" + "\n".join(f"row {i}" for i in range(3000)), "b.xls": "", "c.xls": "\nx\ty\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode("iso-8859-1"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        rows = logs.log_lines(spark, str(tmp_path)).select(F.regexp_extract("file", r"[^/]+$", 0).alias("f"), "line", "text").collect()
    finally:
        spark.conf.set(key, before)
    got = sorted((r.f, r.line, r.text) for r in rows)
    want = [(f, i, x) for f, text in texts.items() for i, x in enumerate(text.replace("\r\n", "\n").split("\n")) if x]
    assert got == sorted(want)


def test_labels_of_periods_by_buckets(spark):
    samples = spark.createDataFrame([(i, i) for i in range(0, 100, 5)] + [(999, None)], "i bigint, t bigint")
    periods = [(0, 12, "a"), (10, 40, "b"), (50, None, "c"), (None, 60, "d"), (90, 80, "e"), (95, 95, "f")]
    p = spark.createDataFrame(periods, "s bigint, e bigint, label string")
    want = sorted(((i, x) for i in range(0, 100, 5) for x in [n for s, e, n in periods if s is not None and e is not None and s <= i <= e] or [None]), key=str)
    for most in (0, 100):
        got = joins.label_periods(samples, p, "t", "s", "e", "label", most).select("i", "label").collect()
        assert sorted(map(tuple, got), key=str) == sorted([*want, (999, None)], key=str)
    none = joins.label_periods(samples, p.where("s is null"), "t", "s", "e", "label", 0).collect()
    assert len(none) == 21 and all(r.label is None for r in none)


def test_sweep_of_a_busy_key_equals_all_pairs(spark, small_batches):
    rng = random.Random(8)
    times = lambda first, n: [(rng.choice(["a", "a", "a", "b", None]), first + i, rng.choice([None, *range(300)] if i % 9 == 0 else range(300))) for i in range(n)]
    lefts, rights = times(0, 400), times(1000, 380)
    pairs = [(k, i, s, j, t) for k, i, s in lefts for m, j, t in rights if k and k == m and None not in (s, t) and abs(s - t) <= 6]
    frame = lambda rows, name: spark.createDataFrame([(k, i, None if s is None else T0 + timedelta(seconds=s)) for k, i, s in rows], f"tool string, {name} bigint, ts_{name} timestamp")
    a, b = frame(lefts, "result"), frame(rights, "trace")
    got = joins.greedy_sweep(a, b, "tool", "result", "trace", "ts_result", "ts_trace", 6)
    assert got.columns == ["tool", "result", "trace"]
    assert sorted(map(tuple, got.collect())) == sorted(greedy(pairs))
    assert joins.greedy_sweep(a.where("false"), b, "tool", "result", "trace", "ts_result", "ts_trace", 6).count() == 0
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_greedy_queries_make_no_pairs(spark):
    """Messages of a tool at one time would be as many pairs as their square."""
    import __spark_entry__

    plan = __spark_entry__.queries()["j05_greedy_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_firsts_of_equal_messages_whatever_their_order(spark, tmp_path):
    rows = [(i % 4, 5000 - i) for i in range(3000)]
    spark.createDataFrame(rows, "tool int, event_id bigint").repartition(7).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tool int, event_id bigint").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    got = live.run_once(live.first_messages(stream, ["tool"], "event_id"), str(tmp_path / "out"), "complete").collect()
    assert sorted((r.tool, r.event_id) for r in got) == [(k, min(i for t, i in rows if t == k)) for k in range(4)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_stream_join_meets_by_key_and_time(spark, tmp_path, how):
    rng = random.Random(2)
    sides = {}
    for n, first in (("result", 0), ("trace", 1000)):
        rows = [(i % 2, first + i, T0 + timedelta(seconds=rng.randrange(600))) for i in range(200)] + [(9, first + 999, T0 + timedelta(days=9))]
        spark.createDataFrame(rows, f"tool int, {n} bigint, ts_{n} timestamp").write.parquet(str(tmp_path / n))
        form = spark.read.parquet(str(tmp_path / n)).schema
        sides[n] = rows, spark.readStream.schema(form).parquet(str(tmp_path / n)).withWatermark(f"ts_{n}", "10 minutes")
    x = live.match_streams(sides["result"][1], sides["trace"][1], "tool", "ts_result", "ts_trace", 20, how)
    assert x.columns == ["tool", "result", "ts_result", "trace", "ts_trace"]
    assert "_a" in x._jdf.queryExecution().analyzed().toString()  # the time is part of what rows meet by
    got = live.run_once(x, str(tmp_path / "out")).where("tool < 9").select("tool", "result", "trace").collect()
    want = []
    for k, i, s in sides["result"][0][:-1]:
        near = [j for m, j, t in sides["trace"][0] if m == k and abs((s - t).total_seconds()) <= 20]
        want += [(k, i, j) for j in near or ([None] if how == "left" else [])]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
