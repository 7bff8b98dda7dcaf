"""Streaks and counts of busy tools in stretches, combined depths, the batch step table as rows."""

import random

from boreflow.operators import aggregates, segments
from boreflow.streaming import live


def test_streaks_over_stretches(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None]), i - 50, rng.choice([True, True, True, False, None]), [i]) for i in range(900)]
    rows += [("long", i, True, [i]) for i in range(100)] + [("long", 100, False, []), ("long", 250, True, []), ("long", 251, None, []), ("long", 300, True, [])]
    want, streak = {}, {}
    for k, i, bad, _ in sorted(rows, key=lambda r: r[1]):
        streak[k] = 0 if bad is False else streak.get(k, 0) + (bad is True)
        want[k, i] = streak[k]
    df = spark.createDataFrame(rows, "tool string, n bigint, bad boolean, extra array<int>").repartition(5)
    for stretch in (7, 64, 1 << 16):
        got = live.failure_runs(df, "tool", "n", "bad", stretch)
        assert got.columns == [*df.columns, "streak"]
        assert {(r.tool, r.n): r.streak for r in got.collect()} == want
        assert got.count() == len(rows)
    assert live.failure_runs(df.where("false"), "tool", "n", "bad").count() == 0


def test_counts_within_a_width(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", None]), rng.randrange(-300, 300) * 5) for i in range(400)] + [(1000 + i, "a", None) for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, tool string, us bigint")
    got = {r.id: r.n for r in live.counts_within(df, "tool", "us", 100).collect()}
    for i, k, t in rows:
        others = [s for _, m, s in rows if m == k and (s is None) == (t is None)]
        assert got[i] == (len(others) if t is None else sum(t - 100 <= s <= t for s in others))
    assert len(got) == len(rows)


def test_combined_depths(spark):
    layers = [(1, 1.0, 4.0, 9.0), (2, 1.0, None, 9.0), (3, None, 4.0, 9.0), (4, 1.0, 4.0, 9.0), (5, 1.0, 4.0, 9.0)]
    ends = [(1, 2.0, 11.0), (2, 2.0, 11.0), (3, 2.0, 11.0), (5, None, 11.0), (6, 2.0, 11.0)]
    got = segments.combined_depths(
        spark.createDataFrame(layers, "hole_id bigint, entry double, transition double, exit double"),
        spark.createDataFrame(ends, "hole_id bigint, first double, last double"),
    )
    none = (None, None, None)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {1: (2.0, 5.5, 11.0), 2: (1.0, 0.0, 9.0), 3: none, 4: none, 5: none}


def test_batch_steps(spark, tmp_path):
    rows = [(h, i, i // 3, -0.5 * i) for h in (7, 3, 9) for i in range(4 if h == 3 else 7)]
    df = spark.createDataFrame(rows, "hole_id bigint, idx bigint, step bigint, pos double").repartition(3)
    got = {tuple(r) for r in aggregates.batch_steps(df, "pos", str(tmp_path / "places")).collect()}
    want = set()
    for place, h in enumerate((3, 7, 9), 1):
        for step in {s for k, _, s, _ in rows if k == h}:
            mine = [(i, p) for k, i, s, p in rows if (k, s) == (h, step)]
            want.add((step, place, h, len(mine), min(mine)[1]))
    assert got == want
