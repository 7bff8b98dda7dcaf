"""From messages to results: one function for matched pairs, driven by a batch or by a stream.

A stream takes messages of one root and the known topics, leaves out repeats, matches results with traces by tool, and hands each
micro-batch of pairs to :func:`results`.  Windows over samples are no streaming operators, but a batch of pairs is a
table like any other.  What a batch gives is written under its number, so a batch that is run again replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators import depth as dp
from boreflow.operators import joins
from boreflow.sources.logs import result_records
from boreflow.streaming import live, state

#: Parts of the dotted keys under which messages hold their values.
KEYS = {
    "step": "Step.Nb", "torque_empty": "Torque.Empty", "thrust_empty": "Thrust.Empty", "machine_id": "Machine.ID", "result_id": "Result.ID",
    "position": "Position", "torque": "Torque.Values", "thrust": "Thrust.Values",
}
#: Seconds between a result and its trace at most, and between repeats of a message.
WINDOW_S, REPEAT_S = 30.0, 1.0


def prepared(messages: DataFrame, root: str) -> DataFrame:
    """Messages (event_id, topic, ts, payload) under the root whose topic is known: with kind, tool and content."""
    x = live.topic_messages(messages, root).where(F.col("kind").isin("result", "trace"))
    tool, content = c.tool_key(F.col("topic")), F.xxhash64("payload")
    return x.select("event_id", "ts", tool.alias("tool"), "kind", F.col("payload").alias("value"), content.alias("content"))


def frames(pairs: DataFrame, keys: dict[str, str] = KEYS) -> DataFrame:
    """Samples of each pair: (hole_id, idx, step, pos_mm, torque, thrust) with the result's empty values of the step added.

    Rows of a step that only one side has stay, with what that side knows; ``hole_id`` is the result message.
    """
    f = c.flatten_result(F.col("result_value"), keys)
    left = pairs.select(F.col("result").alias("hole_id"), F.explode(f["rows"]).alias("r"))
    left = left.select("hole_id", F.col("r.step").alias("step"), "r.torque_empty", "r.thrust_empty")
    found = c.once(c.payload_map(F.col("trace_value")), lambda m: F.struct(*(c.lookup_containing(m, keys[k]).alias(k) for k in ("position", "torque", "thrust", "step"))))
    numbers = lambda k, kind="double": F.from_json(F.col("f")[k], f"array<{kind}>")
    rows = F.arrays_zip(*(numbers(k).alias(k) for k in ("position", "torque", "thrust")), numbers("step", "int").alias("step"))
    right = pairs.select(F.col("result").alias("hole_id"), found.alias("f")).select("hole_id", F.posexplode(rows).alias("idx", "t"))
    right = right.select("hole_id", F.col("idx").cast("bigint").alias("idx"), F.col("t.step").alias("step"), "t.position", "t.torque", "t.thrust")
    both = right.join(left, ["hole_id", "step"], "full_outer")
    total = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0.0))
    return both.select(
        "hole_id", "idx", "step", (-F.col("position")).alias("pos_mm"), total("torque", "torque_empty").alias("torque"),
        total("thrust", "thrust_empty").alias("thrust"),
    )


def results(pairs: DataFrame, keys: dict[str, str] = KEYS) -> DataFrame:
    """Per matched pair (tool, result, trace, result_value, trace_value): ids, key points, depths, error and route.

    Pairs whose messages or frame are not valid have an error and no key points; pairs with one step have neither.
    """
    bad = c.pair_error(F.col("result_value"), F.col("trace_value"))
    f = c.flatten_result(F.col("result_value"), keys)
    checked = pairs.select("tool", "result", "trace", bad.alias("error"), f["hole_id"].alias("machine_id"), f["local"].alias("result_id"), "result_value", "trace_value")
    samples = frames(checked.where("error is null"), keys).where("idx is not null")
    steps = samples.groupBy(F.col("hole_id").alias("result")).agg(F.count_distinct("step").alias("steps"))
    points = dp.stack_depths(dp.step_keypoints(samples, "torque")).select(F.col("hole_id").alias("result"), "keypoints")
    x = checked.drop("result_value", "trace_value").join(steps, "result", "left").join(points, "result", "left")
    frame_error = (
        F.when(F.col("steps").isNull(), "DataFrame is empty")
        .when(F.col("machine_id").isNull(), "HOLE_ID is None or NaN")
        .when(F.col("result_id").isNull(), "local (result_id) is None or NaN")
    )
    x = x.withColumn("error", F.coalesce("error", frame_error))
    known = F.when(F.col("error").isNull() & (F.col("steps") >= 2), F.col("keypoints"))
    x = x.withColumn("keypoints", known).withColumn("depths", c.depths_of(F.col("keypoints")))
    route = c.route(F.col("error").isNull(), F.col("error"), F.col("keypoints"), F.col("depths"))
    return x.select("tool", "result", "trace", "machine_id", "result_id", "keypoints", "depths", "error", route.alias("route"))


def records(done: DataFrame, root: str) -> DataFrame:
    """The two records of each successful result, for the tool's topics."""
    parts = F.split("tool", "/")
    good = done.where("route = 'success'").withColumns({"toolbox": F.get(parts, F.lit(0)), "tool": F.get(parts, F.lit(1)), "ts": F.col("result").cast("string")})
    return result_records(good, root)


def batch_results(messages: DataFrame, root: str, path: str, keys: dict[str, str] = KEYS) -> DataFrame:
    """Results of a table of messages; its matched pairs, which several steps read, are written to ``path``."""
    x = prepared(messages, root)
    x = joins.duplicates(x.withColumn("of", F.struct("tool", "kind")), "of", "ts", "content", REPEAT_S, "event_id").where("not is_duplicate")
    side = lambda k: x.where(F.col("kind") == k).select("tool", F.col("event_id").alias(k), F.col("ts").alias(f"ts_{k}"))
    pairs = joins.greedy_sweep(side("result"), side("trace"), "tool", "result", "trace", "ts_result", "ts_trace", WINDOW_S)
    value = lambda k: x.where(F.col("kind") == k).select(F.col("event_id").alias(k), F.col("value").alias(f"{k}_value"))
    pairs = pairs.join(value("result"), "result").join(value("trace"), "trace")
    pairs.write.parquet(path)
    return results(messages.sparkSession.read.schema(pairs.schema).parquet(path), keys)


def live_results(messages: DataFrame, root: str, path: str, late: str = live.LATE, keys: dict[str, str] = KEYS) -> DataFrame:
    """Runs a stream of messages over what is there, and returns the results that it wrote under ``path``.

    A batch writes its pairs, then its results and records, each under the batch's number.
    """
    spark = messages.sparkSession
    pairs = state.match_greedily(live.with_late_limit(prepared(messages, root), late=late), WINDOW_S, repeat=REPEAT_S)

    def put(batch: DataFrame, n: int) -> None:
        at = f"{path}/pairs/batch={n}"
        batch.write.mode("overwrite").parquet(at)
        done = results(spark.read.schema(batch.schema).parquet(at), keys)
        done.write.mode("overwrite").parquet(f"{path}/results/batch={n}")
        written = spark.read.schema(done.schema).parquet(f"{path}/results/batch={n}")
        records(written, root).write.mode("overwrite").parquet(f"{path}/records/batch={n}")

    with state.keyed_state(spark):
        q = pairs.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put)
        q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/results").drop("batch")
