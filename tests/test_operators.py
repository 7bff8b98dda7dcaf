"""Registered drilling queries against DuckDB, and micro-tables with known answers."""

import math
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from boreflow.functions import columns as c
from boreflow.operators import joins, windows
from boreflow.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns, order = sorted(df.columns), [want.columns.index(x) for x in sorted(df.columns)]
    mine = sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert len(mine) == len(theirs)
    assert mine == theirs


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first()


def test_grip_lengths(spark):
    def at(x):
        r = one(spark, **{k: v for k, v in c.grip_lengths(F.lit(x)).items() if k[0] == "d"})
        return r.d1, r.d2, r.d3

    assert at(5.0) == (4, 3, 3)
    assert at(3.2) == (3, 2, 2)
    assert at(4.8) == (4, 3, 3)


def test_numbers_names_topics(spark):
    r = one(
        spark, a=c.decimal_comma(F.lit("1,234,5")), b=c.decimal_comma(F.lit("x")), k=c.clean_key(F.lit("A.b.9 Max-Torque (A)")),
        t=c.tool_key(F.lit("plant/box/tool/ResultManagement")), n=c.topic_kind(F.lit("p/b/t/ResultManagement/Trace")),
        h=c.normal_head_id(F.array(F.lit(" HEAD "))), d=c.depths_of(F.array(F.lit(1.0), F.lit(3.0), F.lit(6.0))),
        e=c.iso_to_epoch(F.lit("2024-01-01T00:00:00Z")),
    )
    assert (r.a, r.b, r.k, r.t, r.n, r.h, r.d, r.e) == (1234.5, None, "field_9_max_torque_a", "box/tool", "trace", "HEAD", [2.0, 3.0], 1704067200.0)


def messages(spark, rows, name):
    return spark.createDataFrame([(t, i, datetime(2024, 1, 1, 0, 0, s)) for t, i, s in rows], f"tool string, {name} bigint, ts_{name} timestamp")


def test_matching(spark):
    a = messages(spark, [("t1", 1, 0), ("t1", 2, 1), ("t2", 3, 0)], "result")
    b = messages(spark, [("t1", 11, 1), ("t1", 12, 4), ("t3", 13, 0), ("t2", 14, 10)], "trace")
    pairs = joins.interval_join(a, b, "tool", "ts_result", "ts_trace", 5)
    got = joins.greedy_match(pairs, "tool", "result", "trace", "ts_result", "ts_trace").collect()
    assert {tuple(r) for r in got} == {("t1", 1, 11), ("t1", 2, 12)}


def test_duplicate_rule(spark):
    rows = [("t", 0.0, "x"), ("t", 0.5, "x"), ("t", 2.0, "x"), ("t", 0.0, "y")]
    df = spark.createDataFrame([(k, datetime.fromtimestamp(1e9 + s), v) for k, s, v in rows], "k string, ts timestamp, v string")
    got = joins.duplicates(df, "k", "ts", "v").select("v", "is_duplicate").collect()
    assert sorted(map(tuple, got)) == [("x", False), ("x", False), ("x", True), ("y", False)]


def test_plateau_peak(spark):
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate([0.0, 2.0, 2.0, 2.0, 1.0, 3.0, 0.0])], "hole_id bigint, idx bigint, y double")
    assert sorted(r.idx for r in windows.peaks(df, "y", 0.5).collect()) == [2, 5]
