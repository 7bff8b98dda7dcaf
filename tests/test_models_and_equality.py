"""Model windows, line fits and deep equality against numpy and plain Python."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators import joins
from boreflow.operators import model_windows as mw
from boreflow.operators import windows as w
from boreflow.sources import logs


def test_any_model_scores_whole_windows(spark):
    rng = np.random.default_rng(1)
    frame, want = [], {}
    for hole, n in ((1, 60), (2, 5), (3, 400)):
        data = np.round(rng.normal(3, 1, (n, 18)), 2)
        data[:, 15:17] = 0.5
        frame += [(hole, i, *map(float, r)) for i, r in enumerate(data)]
        whole = np.full((n + 800, 18), -1.0)
        whole[:, 15:] = data[0, 15:]
        whole[400 : 400 + n] = data
        peak = whole[:, 7].argmax()
        for k, j in enumerate(range(0, 200, 5)):
            b = peak - 330 + j
            x = whole[b : b + 512, :17].astype(np.float32)
            heat = x * x
            heat[heat < 4] = 0
            want[hole, k] = (b, b + int(np.round(heat[:, :15].sum(axis=1, dtype=float), 4).argmax()))
    form = "hole_id bigint, row bigint, " + ", ".join(f"torque{i + 1} double" for i in range(15)) + ", local double, predrilled double, xpos double"
    df = spark.createDataFrame(frame, form)
    seen = {}

    def model(x):
        assert x.shape[1:] == (512, 17) and x.dtype == np.float32
        return x * x

    got = {(r.hole_id, r.window_nr): r for r in mw.score_windows(df, model, 4.0).collect()}
    assert {k: (r.begin, r.at) for k, r in got.items()} == want
    xpos = {(h, i): r[-1] for h, i, *r in frame}
    for (hole, _), r in got.items():
        assert r.xpos == pytest.approx(xpos.get((hole, r.at - 400), xpos[hole, 0]))
        seen.setdefault(hole, []).append(r.xpos)
    means = {r.hole_id: (r.exit, r.windows) for r in mw.exits(mw.score_windows(df, model, 4.0)).collect()}
    assert means == {h: (pytest.approx(np.mean(x)), 40) for h, x in seen.items()}


def test_line_fit_with_ends(spark):
    rng = np.random.default_rng(4)
    signals = {1: rng.normal(size=30), 2: rng.normal(size=9), 3: rng.normal(size=8)}
    df = spark.createDataFrame([(h, i + 5, float(y)) for h, s in signals.items() for i, y in enumerate(s)], "hole_id bigint, idx bigint, y double")
    got = {(r.hole_id, r.idx - 5): r.s for r in df.select("hole_id", "idx", w.line_fit("y", 9).alias("s")).collect()}
    for h, y in signals.items():
        for i in range(len(y)):
            if len(y) < 9:
                continue
            if 4 <= i < len(y) - 4:
                want = y[i - 4 : i + 5].mean()
            else:
                first = 0 if i < 4 else len(y) - 9
                want = np.polyval(np.polyfit(np.arange(9), y[first : first + 9], 1, w=np.array(w.hann(9))), i - first)
            assert got[h, i] == pytest.approx(want), (h, i)
    assert got[3, 4] is None


def equal(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    number = (int, float)
    if isinstance(a, number) and isinstance(b, number) and not isinstance(a, bool) and not isinstance(b, bool):
        return abs(a - b) < 1e-10
    return a == b


DOCS = [
    {"a": 1, "b": [1.5, {"c": "x"}]}, {"b": [1.5, {"c": "x"}], "a": 1.00000000004}, {"a": 0.99999999996, "b": [1.5, {"c": "x"}]}, {"a": 1, "b": [1.5, {"c": "y"}]},
    {"a": 1, "b": [{"c": "x"}, 1.5]}, {"a": 1}, {"a": None}, {"a": []}, {"a": {}}, {"a": {}}, [], [[]], 3, 3.0, "3", True, {"a.b": 1}, {"a": {"b": 1}}, {"x": 1e9},
    {"x": 1e9 + 1e-7}, {"x": 9.99999999999}, {"x": 10.00000000001}, {"x": -0.00000000004}, {"x": 0}, {"x": [2, 1]}, {"x": [1, 2]}, {"a": None},
]


def test_deep_equality(spark):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(DOCS)] + [(90, "{ no"), (91, "{ no"), (92, None), (93, None)], "i int, doc string")
    got = {(r.a, r.b) for r in joins.deep_equal_pairs(df, "i", "doc").collect()}
    assert got == {(i, k) for i, x in enumerate(DOCS) for k, y in enumerate(DOCS) if i < k and equal(x, y)}


def test_values_at_any_depth(spark):
    doc, want = {"v": 0}, ["0"]
    for i in range(1, 41):
        doc = {"v": i, "a": [doc]}
        want.insert(0, str(i))
    df = spark.createDataFrame([(json.dumps(doc),), (None,), ("[[",)], "d string").select(c.find_values(F.col("d"), "v").alias("v")).collect()
    assert df[0].v == want and not df[1].v and not df[2].v
    topic = "a/b/c/" + "/".join(str(i) for i in range(150))
    assert spark.range(1).select(c.is_exact_topic(F.lit(topic), topic[6:])).first()[0]


def test_first_date_of_a_log(spark):
    lines = [("a", 0, "x 2024-13-41:10:00:00"), ("a", 1, "Date 2024-2-9:1:5:07"), ("a", 2, "2020-01-01:00:00:00"), ("b", 0, "09/02/24 :  03:30 PM"), ("c", 0, "none 1/2"), ("d", 3, "2024-02-09:25:00:00")]
    got = {r.file: str(r.written) for r in logs.write_dates(spark.createDataFrame(lines, "file string, line int, text string")).collect()}
    assert got == {"a": "2024-02-09 01:05:07", "b": "2024-02-09 15:30:00"}


def test_occupancy_against_a_count(spark):
    from boreflow.streaming import alerts

    rng = np.random.default_rng(7)
    rows = [(f"k{i % 2}", i, int(t), None if i % 5 == 0 else int(t + rng.integers(0, 500e6))) for i, t in enumerate(np.sort(rng.integers(0, 40_000, 400)) * 1_000_000)]
    x = alerts.stays(spark.createDataFrame(rows, "key string, id bigint, us bigint, done_us bigint"))
    leave = {r.id: r.leave_us for r in x.collect()}
    for k, i, us, done in rows:
        assert leave[i] == (us + 300_000_000 if done is None or done > us + 300_000_000 else done)
    got = {r.id: (r.waiting, r.level) for r in alerts.occupancy(x, 5).collect()}
    for k, i, us, _ in rows:
        here = [j for q, j, t, _ in rows if q == k and leave[j] > us and (t, j) <= (us, i)]
        n = len(here) + sum(1 for q, j, t, _ in rows if q == k and leave[j] == t == us and (t, j) <= (us, i))
        assert got[i][0] == n, i
        share = n / 5
        assert got[i][1] == ("critical" if share >= 0.9 else "high" if share >= 0.8 else "warn" if share >= 0.6 else "ok")
    assert len({v[1] for v in got.values()}) == 4


def test_processed_messages(spark):
    rows = [("control/x", '{"type":"t","id":7,"v":[1,"a\\"b"]}'), ("y", "no json"), ("control/", "[1]"), ("z", None), ("q\"", "{}")]
    df = spark.createDataFrame(rows, "topic string, payload string")
    out = c.processed(F.col("topic"), F.col("payload"), "control/")
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in out.items())).collect()]
    assert got[0][:2] == ("t", "7") and json.loads(got[0][2]) == {"type": "t", "id": 7, "v": [1, 'a"b'], "_topic": "x"}
    assert got[1][:2] == ("unknown", "unknown") and json.loads(got[1][2]) == {"raw": "no json", "_topic": "y"}
    assert json.loads(got[2][2]) == {"raw": "[1]", "_topic": ""} and json.loads(got[4][2]) == {"_topic": 'q"'}


def test_copies_are_compared_once(spark):
    """Rows of one text: each pair comes once, and a text is parsed as often as it differs and not as often as it is there."""
    texts = ['{"a":[1,{"b":2}]}', '{"a":[1.00000000002,{"b":2}]}', '{"a":[1,{"b":3}]}', "{ no", None]
    rows = [(k, texts[k % 5]) for k in range(60)]
    df = spark.createDataFrame(rows, "i int, doc string")
    found = joins.deep_equal_pairs(df, "i", "doc")
    got = [(r.a, r.b) for r in found.collect()]
    near = [{0, 1}, {0, 1}, {2}, set(), set()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60) if b % 5 in near[a % 5]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parse" in plan.lower() and "parse" not in plan[plan.rindex("RepartitionByExpression [json") :].lower()
