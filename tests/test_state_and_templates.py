"""Streams with state over many micro-batches, policies of repeats, segments and templates against numpy and pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators import joins, segments, templates
from boreflow.plans.paths import scratch_path
from boreflow.streaming import live, state

BEGIN = datetime(2024, 1, 1)
FORM = "tool bigint, kind string, event_id bigint, ts timestamp, value double"


def stream_of(spark, batches, form=FORM):
    """A stream that gives each list of rows as one micro-batch."""
    path = scratch_path(spark, "files")
    for rows in batches:
        spark.createDataFrame(rows, form).coalesce(1).write.mode("append").parquet(path)
    return live.with_late_limit(spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(path), late="60 seconds")


def ran(spark, make, batches, form=FORM):
    with state.keyed_state(spark):
        return sorted(tuple(r) for r in live.run_once(make(stream_of(spark, batches, form)), scratch_path(spark, "s")).collect())


def rows_of(n=120):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.integers(1, 12, n))
    return [(int(rng.integers(2)), str(rng.choice(["result", "trace"])), i, BEGIN + timedelta(seconds=int(x)), float(i)) for i, x in enumerate(t)]


def greedy(rows, seconds):
    out, waiting = [], {}
    for tool, kind, i, ts, _ in rows:
        other = waiting.setdefault((tool, "trace" if kind == "result" else "result"), [])
        mate = next((m for m in other if abs((ts - m[1]).total_seconds()) <= seconds), None)
        if mate:
            other.remove(mate)
            out.append((tool, i, mate[0]) if kind == "result" else (tool, mate[0], i))
        else:
            waiting.setdefault((tool, kind), []).append((i, ts))
    return sorted(out)


def test_matches_do_not_depend_on_batches(spark):
    rows = rows_of()
    make = lambda s: state.match_greedily(s, 20, keep=20).select("tool", "result", "trace")
    want = greedy(rows, 20)
    assert len(want) > 20
    assert ran(spark, make, [rows]) == want
    assert ran(spark, make, [rows[i : i + 30] for i in range(0, 120, 30)]) == want


def test_sets_expire_without_further_messages(spark):
    at = lambda s: BEGIN + timedelta(seconds=s)
    one = [(1, "a", 1, at(0), 1.0), (2, "a", 2, at(0), 2.0), (2, "b", 3, at(5), 3.0)]
    later = [(9, "a", 4, at(900), 0.0)]  # moves the watermark past the timers
    last = [(1, "b", 5, at(905), 5.0), (9, "b", 6, at(906), 6.0)]
    got = ran(spark, lambda s: state.complete_sets(s, ["a", "b"], 60).drop("us"), [one, later, last])
    assert got == [(2, 2.0, 3.0), (9, 0.0, 6.0)]


REPEATED = [(0.0, "x"), (0.5, "x"), (1.2, "x"), (2.6, "x"), (0.2, "y"), (0.4, None), (0.4, None)]


@pytest.mark.parametrize("policy, kept", [("ignore", [0, 2, 3, 4, 5]), ("replace", [2, 3, 4, 6])])
def test_policies_of_repeats(spark, policy, kept):
    form = "event_id bigint, ts timestamp, k string, content string"
    rows = [(i, BEGIN + timedelta(seconds=s), "topic", x) for i, (s, x) in enumerate(REPEATED)]
    batch = joins.without_repeats(spark.createDataFrame(rows, form), "k", "ts", "content", 1.0, policy, "event_id")
    assert sorted(r.event_id for r in batch.collect()) == kept
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for cut in ([ordered], [ordered[:3], ordered[3:]]):
        got = ran(spark, lambda s: state.repeats(s, ["k", "content"], policy), cut, form)
        assert sorted({i for i, _, _ in got} - {r for _, _, r in got}) == kept


def test_error_policy_raises(spark):
    form = "event_id bigint, ts timestamp, k string"
    df = spark.createDataFrame([(1, BEGIN, "a"), (2, BEGIN, "a"), (3, BEGIN, "b")], form).withColumn("x", F.lit(1))
    with pytest.raises(Exception, match="repeated message"):
        joins.without_repeats(df, "k", "ts", "x", 1.0, "error", "event_id").count()
    assert joins.without_repeats(df.where("event_id > 1"), "k", "ts", "x", 1.0, "error").count() == 2
    with pytest.raises(ValueError, match="no such policy"):
        state.repeats(df, ["k"], "drop")


def drilled(seed=1, n=90):
    rng = np.random.default_rng(seed)
    rows = []
    for hole in (1, 2):
        for seg, feed in enumerate((0.05, 0.03 * hole, 0.06)):
            rows += [(hole, seg * n + i, -(seg * 2.0 + i * feed), float(t)) for i, t in enumerate(np.round(rng.normal(3, 1, n).cumsum() / 7, 3))]
    return rows + [(3, 0, 0.0, 1.0), (4, 0, -1.0, 1.0), (4, 1, -1.0, None)]


def test_segment_statistics_follow_the_feed(spark):
    rows = drilled()
    df = spark.createDataFrame(rows, "hole_id bigint, idx bigint, pos_mm double, t double")
    got = {(r.hole_id, r.segment): r for r in segments.segment_statistics(df, "t", 0.72).collect()}
    frame = pd.DataFrame(rows, columns=["hole", "idx", "pos", "t"]).assign(p=lambda x: -x.pos)
    seen = 0
    for hole, h in frame.groupby("hole"):
        h = h.assign(seg=h.p.diff().lt(0).cumsum())
        for seg, s in h.groupby("seg"):
            r = got[hole, seg]
            feed = s.p.diff().median()
            if not feed > 0:
                assert r.width is None and r.mean_max is None
                continue
            n = round(0.72 / feed)
            g = s.t.diff() / s.p.diff()
            assert r.width == n
            for name, roll in (("mean", g.rolling(n).mean()), ("median", g.rolling(n).median())):
                for end, at in (("max", roll.round(6).idxmax()), ("min", roll.round(6).idxmin())):
                    assert r[f"{name}_{end}"] == pytest.approx(s.p[at]), (hole, seg, name, end)
                    seen += 1
    assert seen == 24
    layers = {r.hole_id: r for r in segments.layer_depths(segments.segment_statistics(df, "t", 0.72), "mean").collect()}
    for hole in (1, 2):
        a, b, e = got[hole, 1].mean_max, got[hole, 2].mean_max, got[hole, 2].mean_min
        assert layers[hole].total == (pytest.approx(e - a) if a < b < e else None)
    assert layers[3].entry is None and layers[3].total is None


def test_templates_of_any_length(spark, monkeypatch):
    rng = np.random.default_rng(2)
    signals = {1: np.round(rng.normal(size=300).cumsum(), 3), 2: np.zeros(50), 3: np.round(rng.normal(size=9), 3)}
    known = {"a": (signals[1][40:60], 3), "b": (signals[1][100:105], 0), "c": (rng.normal(size=64), 10), "flat": (np.ones(7), 1)}
    df = spark.createDataFrame([(h, i, float(y), -i * 0.1) for h, s in signals.items() for i, y in enumerate(s)], "hole_id bigint, idx bigint, y double, pos_mm double")
    table = spark.createDataFrame([(n, t, [float(v) for v in s]) for n, (s, t) in known.items()], "name string, target_idx int, segment array<double>")
    monkeypatch.setattr(templates, "BLOCK_VALUES", 30)  # several blocks
    got = {(r.hole_id, r.name): r for r in templates.match(df, "y", table, 4).collect()}
    assert len(got) == 3 * 4 - 3  # "c" is longer than the second signal, and than the third, as "a" is
    for (hole, name), r in got.items():
        y, (s, target) = signals[hole], known[name]
        m = len(s)
        z = (s - s.mean()) / s.std() if s.std() > 0 else s * 0
        d = []
        for i in range(len(y) - m + 1):
            w = y[i : i + m]
            d.append(np.sqrt(((z - (w - w.mean()) / w.std()) ** 2).sum()) if w.std() > 0 and s.std() > 0 else np.sqrt(2 * m))
        d = np.round(d, 6)
        assert (r.start, r.target, r.distance) == (int(d.argmin()), int(d.argmin()) + target, pytest.approx(d.min(), abs=2e-6))
    assert (got[1, "a"].start, got[1, "b"].start) == (40, 100) and got[2, "a"].z is None
    ranges = spark.createDataFrame([("a", 40, 20, 43), ("b", 100, 5, 100)], "name string, start int, width int, target int")
    cut = {(r.hole_id, r.name): r for r in templates.estimated_segments(df, "y", ranges, templates.match(df, "y", table, 4)).collect()}
    assert cut[1, "a"].begin == 40 and cut[1, "a"].segment == pytest.approx(signals[1][40:60].tolist())


def test_first_error_of_a_pair(spark):
    good = '{"Messages":{"Payload":{"a":1}}}'
    cases = [
        (None, None, "Missing required result message"), (good, None, "Missing required trace message"), ("", "{", "Result message has no data content"),
        ("{", " ", "Trace message has no data content"), ("{", "[", "Invalid JSON in result message"), ("3", "[", "Result message data is not a valid dictionary"),
        ('{"Messages":3}', "[", "Result message missing required Messages.Payload structure"), (good, "{", "Invalid JSON in trace message"),
        (good, '"x"', "Trace message data is not a valid dictionary"), (good, "{}", "Trace message missing required Messages.Payload structure"), (good, good, None),
    ]
    df = spark.createDataFrame([(i, r, t) for i, (r, t, _) in enumerate(cases)], "i int, r string, t string")
    got = {x.i: x.e for x in df.select("i", c.pair_error(F.col("r"), F.col("t")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, _, e in cases]
