"""Queries whose results or work went wrong on larger tables."""

import datetime

import pandas as pd
import pytest

import __spark_entry__
from boreflow.operators import segments
from boreflow.plans import messages
from boreflow.sources import logs
from boreflow.streaming import state

DAY = datetime.datetime(2024, 1, 1)


def lineitem(spark, path, quantities):
    """A lineitem table with the quantities of each hole, in order."""
    rows = [(h, n, 0, h, float(q), 100.0, 0.05, 0.02, DAY) for h, values in quantities.items() for n, q in enumerate(values)]
    kinds = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    spark.createDataFrame(rows, kinds).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_bounds_of_means_hold_whatever_the_order_of_sums(spark, tmp_path):
    high, low, tie = [12, 40, 11, 41, 13, 39] * 100, [11, 39, 12, 38, 10, 40] * 100, ([25] * 15 + [26]) * 40
    over = [*high[:-1], 40]
    got = __spark_entry__.queries()["t07_run_search"](spark, lineitem(spark, tmp_path, {1: high, 2: low, 3: tie, 4: over}))
    assert sorted((r.hole_id, r.mean) for r in got.collect()) == [(1, 2.6), (2, 2.5), (3, 2.5063)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def small(spark, path):
    return lineitem(spark, path, {1: [n % 7 for n in range(500)], 2: [n % 11 for n in range(130)]})


def test_result_messages_are_parsed_before_their_rows_are_exploded(spark, tmp_path):
    df = __spark_entry__.queries()["f10_flatten_result"](spark, small(spark, tmp_path))
    above, explode, _ = plan_of(df).partition("Generate")
    assert explode and "from_json" not in above
    assert sorted((r.hole_id, r.part, r.pos) for r in df.collect()) == sorted((str(h), i // 64, i % 64) for h, n in ((1, 500), (2, 130)) for i in range(n))


def test_raw_messages_are_parsed_before_their_rows_are_exploded(spark, tmp_path):
    df = __spark_entry__.queries()["f12_flatten_raw"](spark, small(spark, tmp_path))
    above, explode, _ = plan_of(df).partition("Generate")
    assert explode and "from_json" not in above
    assert {(r.of, r.hole_id) for r in df.collect()} == {(1, "1"), (2, "2"), (1, "UNKNOWN"), (2, "UNKNOWN")}


def test_heads_are_parsed_before_they_meet_the_rows(spark, tmp_path):
    df = __spark_entry__.queries()["f13_heads_enrichment"](spark, small(spark, tmp_path))
    above, join, _ = plan_of(df).partition("Join")
    assert join and "from_json" not in above
    got = {(r.hole_id, r.idx): (r.serial, r.temps) for r in df.collect()}
    assert got[1, 70] == ("H1", "6") and got[2, 129][1].startswith("[0,1,") and len(got) == 630


def test_depths_by_several_statistics_take_one_pass(spark, tmp_path):
    df = __spark_entry__.queries()["d06_layer_depths"](spark, small(spark, tmp_path))
    assert plan_of(df).count("Relation [") == 1
    assert sorted((r.hole_id, r.stat) for r in df.collect()) == [(h, s) for h in (1, 2) for s in ("mean", "median")]
    columns = "hole_id bigint, idx bigint, pos_mm double, t double"
    rows = [(1, i, -float(i % 20), float(i * i % 17)) for i in range(80)]
    known = [{r.segment: r for r in segments.segment_statistics(spark.createDataFrame(rows, columns), "t", 3.0, only=o).collect()} for o in ((), (1, 2))]
    assert {s for s, r in known[1].items() if r.mean_max is not None} == {1, 2} and known[1].keys() == known[0].keys()
    assert all(known[1][s] == known[0][s] for s in (1, 2))


class Held(dict):
    """A map state in memory, which counts the rows that are looked at."""

    looks = 0

    def containsKey(self, k):
        self.looks += 1
        return tuple(k) in self

    def getValue(self, k):
        self.looks += 1
        return self[tuple(k)]

    def updateValue(self, k, v):
        self[tuple(k)] = tuple(v)

    def removeKey(self, k):
        del self[tuple(k)]

    def keys(self):
        self.looks += len(self)
        return list(super().keys())

    def iterator(self):
        self.looks += len(self)
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    def registerTimer(self, ms):
        self.timers.add(ms)


class Expired:
    def __init__(self, ms):
        self.getExpiryTimeInMs = lambda: ms


@pytest.mark.parametrize("seconds", [30.0, 0.0004])
def test_a_timer_looks_at_its_own_stretch_only(seconds):
    handle, matcher = Handle(), state.GreedyMatcher(seconds, 300.0, "string", 1.0)
    matcher.init(handle)
    rows = [("result", i, i * 1_500_000_000, str(i), i) for i in range(500)] + [("result", 1000 + i, i * 1_500_000_000 + 300, "", i) for i in range(500)]
    assert not any(len(x) for x in matcher.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["kind", "event_id", "us", "value", "content"])]), None))
    assert len(handle.states["waiting"]) == 500 == len(handle.states["seen"])  # repeats are left out
    for ms in sorted(handle.timers):
        before = sum(s.looks for s in handle.states.values())
        list(matcher.handleExpiredTimer(("a",), None, Expired(ms)))
        assert sum(s.looks for s in handle.states.values()) - before < 30
    assert not any(handle.states.values())


def test_looked_up_values_take_the_first_lines_of_sections_only(spark):
    texts = ["before", "*** A ***", "x\ty ;x", "1\t2 ;3;4", "5\t6", "*** B ***", "*** C ***", "y", "7", "*** D ***", "x", "*** E ***", "x;y", " 8;9"]
    lines = spark.createDataFrame([(f, i + i // 3, t) for f in ("f", "g") for i, t in enumerate(texts)], "file string, line int, text string")
    for name in ("x", "y", "z"):
        got = logs.first_values(lines, name)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, logs.lookup(logs.sections(lines), name).collect()))
    assert sorted(map(tuple, logs.first_values(lines, "x").collect())) == [(f, v) for f in ("f", "g") for v in ("1", "3", "8")]
    above, _, below = plan_of(got).partition("Generate")
    assert "split" not in below.partition("Filter")[2]


def test_results_of_a_busy_tool_without_heads_stay(spark, tmp_path):
    """The outer stream join by stretches of time gives the rows of a plain join, those without a partner once."""
    rows = [(i, DAY + datetime.timedelta(seconds=7 * i), 1, "purchase", 0.0, "{}") for i in range(200)]
    rows += [(1000 + i, DAY + datetime.timedelta(seconds=613 * i), 21, "view", 0.0, "{}") for i in range(3)]
    kinds = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/events.parquet")
    df = __spark_entry__.queries()["r04_optional_heads"](spark, str(tmp_path))
    near = lambda i: [1000 + j for j in range(3) if abs(7 * i - 613 * j) <= messages.WINDOW_S]
    want = [(1, i, h) for i in range(200) for h in near(i) or [None]]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_optional_heads_look_up_no_state_for_a_pair(spark, tmp_path, monkeypatch):
    """The messages of a tool's stretch of time are one row of state; results without a time or a tool stay too."""
    kinds = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = [(1000 * n + i, DAY + datetime.timedelta(seconds=i), 1, kind, 0.0, "{}") for n, kind in enumerate(("purchase", "view")) for i in range(150)]
    odd = [(5000, None, 1, "purchase", 0.0, "{}"), (5001, DAY, None, "purchase", 0.0, "{}"), (5002, DAY, None, "view", 0.0, "{}"), (5003, DAY, -1, "purchase", 0.0, "{}")]
    spark.createDataFrame(rows + odd, kinds).write.parquet(f"{tmp_path}/events.parquet")
    streams, run_once = [], messages.live.run_once
    monkeypatch.setattr(messages.live, "run_once", lambda x, *more: streams.append(x) or run_once(x, *more))
    got = __spark_entry__.queries()["r04_optional_heads"](spark, str(tmp_path)).collect()
    want = [(1, i, 1000 + j) for i in range(150) for j in range(150)] + [(1, 5000, None), (None, 5001, None), (-1, 5003, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(streams) == 1 and "Join" not in streams[0]._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_matches_of_stretches_that_are_over(spark, tmp_path, how):
    """Micro-batches out of order, both ends of the window, rows without a key: the pairs of a plain join."""
    at = lambda s: DAY + datetime.timedelta(seconds=s)
    sides, rows = {}, {"result": [(i % 3 if i % 10 else None, i, 37 * i % 600) for i in range(200)], "trace": [(i % 3 if i % 10 else None, i, 53 * i % 600) for i in range(200)]}
    for name, all_of in rows.items():
        form = f"tool int, {name} bigint, ts_{name} timestamp"
        for part in [all_of[k::4] for k in range(4)] + [[(9, 900, 900_000)]]:
            spark.createDataFrame([(k, i, at(s)) for k, i, s in part], form).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        sides[name] = stream.withWatermark(f"ts_{name}", "11 minutes")
    x = messages.live.match_when_over(sides["result"], sides["trace"], "tool", "ts_result", "ts_trace", 20, how)
    assert x.columns == ["tool", "result", "ts_result", "trace", "ts_trace"]
    got = messages.live.run_once(x, str(tmp_path / "out")).where("tool is null or tool < 9").collect()
    assert any(abs((r.ts_result - r.ts_trace).total_seconds()) == 20 for r in got if r.trace is not None)
    want = []
    for k, i, s in rows["result"]:
        near = [(j, at(t)) for m, j, t in rows["trace"] if k is not None and m == k and abs(s - t) <= 20]
        want += [(k, i, at(s), *r) for r in near or ([(None, None)] if how == "left" else [])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_results_stay_where_a_table_has_no_heads_at_all(spark, tmp_path):
    rows = [(i, DAY + datetime.timedelta(seconds=7 * i), 1, "purchase", 0.0, "{}") for i in range(20)]
    kinds = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/events.parquet")
    got = __spark_entry__.queries()["r04_optional_heads"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, i, None) for i in range(20)]
