"""Views of the driver tables as drilling data: traces, messages, programs; with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreflow.functions.columns import result_topic
from boreflow.operators.places import bounded

SAMPLES_PER_STEP = 150


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: hole_id, idx, pos_mm, torque_a, thrust_a, torque_empty_a, thrust_empty_a, step."""
    li = bounded(table(spark, sf_dir, "lineitem"), "l_suppkey")  # a hole stays whole, and a task has so many rows at any size
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    numbered = li.select(*order, "l_suppkey", (F.row_number().over(w) - 1).cast("bigint").alias("idx"))
    return numbered.select(
        F.col("l_suppkey").alias("hole_id"), "idx", (-(F.col("idx") * 0.05)).alias("pos_mm"),
        (F.col("l_quantity") / 10).alias("torque_a"), (F.col("l_discount") * 10).alias("thrust_a"),
        F.lit(4.5).alias("torque_empty_a"), F.col("l_tax").alias("thrust_empty_a"),
        F.floor(F.col("idx") / SAMPLES_PER_STEP).cast("int").alias("step"),
    )


TRACE = """trace AS (SELECT hole_id, idx, -(idx * 0.05::DOUBLE) AS pos_mm, q / 10 AS torque_a, d * 10 AS thrust_a,
    4.5::DOUBLE AS torque_empty_a, t AS thrust_empty_a, CAST(idx // 150 AS INTEGER) AS step FROM (
    SELECT l_suppkey AS hole_id, l_quantity AS q, l_discount AS d, l_tax AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY
        l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS idx FROM lineitem))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: event_id, ts, tool, kind, topic, value, payload (JSON)."""
    ev = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "click", "trace")
    kind = kind.when(F.col("event_type") == "view", "heads")
    ev = ev.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 20).alias("tool"), kind.alias("kind"), "value", "props"
    ).where("kind is not null")
    tail = F.when(F.col("kind") == "result", "ResultManagement").when(F.col("kind") == "trace", "ResultManagement/Trace")
    toolbox = F.concat(F.lit("box"), F.col("tool") % 3)
    topic = result_topic(F.lit("plant"), toolbox, F.concat(F.lit("tool"), F.col("tool")), tail.otherwise("AssetManagement/Heads"))
    k = F.get_json_object("props", "$.k")
    payload = F.concat(
        F.lit('{"Messages":{"Payload":{"Unit.Machine.ID":{"Value":"'), F.col("tool").cast("string"), F.lit('"},"Unit.Count":{"Value":"'),
        F.coalesce(k, F.lit("")), F.lit('"}}}}'),
    )
    return ev.select("event_id", "ts", "tool", "kind", topic.alias("topic"), "value", k.cast("int").alias("k"), payload.alias("payload"))


MSG = """msg AS (SELECT event_id, ts, user_id % 20 AS tool, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'click' THEN 'trace'
        ELSE 'heads' END AS kind, 'plant/box' || (user_id % 20 % 3) || '/tool' || (user_id % 20) || CASE event_type
        WHEN 'purchase' THEN '/ResultManagement' WHEN 'click' THEN '/ResultManagement/Trace' ELSE '/AssetManagement/Heads' END AS topic,
    value, CAST(props->>'$.k' AS INTEGER) AS k, '{"Messages":{"Payload":{"Unit.Machine.ID":{"Value":"' || (user_id % 20) ||
    '"},"Unit.Count":{"Value":"' || coalesce(props->>'$.k', '') || '"}}}}' AS payload
    FROM events WHERE event_type IN ('purchase', 'click', 'view'))"""


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program steps: program_id, step, on, stroke, rpm, feed (mm/s), delay."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.floor(F.col("p_partkey") / 4).alias("program_id"), (F.col("p_partkey") % 4).cast("int").alias("step"),
        (F.col("p_size") % 5 != 0).alias("on"), F.col("p_size").cast("double").alias("stroke"),
        (F.col("p_retailprice") * 2).alias("rpm"), (F.col("p_size") / 10).alias("feed"),
        F.when(F.col("p_size") > 25, F.col("p_size") * 2.0).otherwise(0.0).alias("delay"),
    )


PROGRAM = """program AS (SELECT p_partkey // 4 AS program_id, CAST(p_partkey % 4 AS INTEGER) AS step, p_size % 5 <> 0 AS "on",
    p_size::DOUBLE AS stroke, p_retailprice * 2 AS rpm, p_size / 10 AS feed,
    CASE WHEN p_size > 25 THEN p_size * 2.0::DOUBLE ELSE 0.0::DOUBLE END AS delay FROM part)"""
