"""Structured Streaming over drilling messages: late data, duplicates, matching, alerts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "300 seconds"


def with_late_limit(messages: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Event time as a timestamp with a watermark: older messages are dropped."""
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def drop_repeats(messages: DataFrame, keys: list[str]) -> DataFrame:
    """One of equal messages within the watermark: that which comes first. Which that is in a micro-batch is open."""
    return messages.dropDuplicatesWithinWatermark(keys)


def first_messages(messages: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of equal messages the first by a column, however they come; for complete mode, with a state row for each content."""
    return messages.groupBy(*keys).agg(F.min(order).alias(order))


def match_streams(results: DataFrame, traces: DataFrame, key: str, ts_a: str, ts_b: str, seconds: int, how: str = "inner") -> DataFrame:
    """Stream-stream interval join of one key; both sides carry watermarks and differ in their other names.

    A busy key is joined by buckets of time too, so that a row meets what lies near it and not all that its key holds: traces are
    dealt to the bucket before, their own and the one after.
    """
    bucket = lambda ts: F.floor(F.unix_micros(ts) / (seconds * 1_000_000))
    b = traces.withColumnRenamed(key, "_key").withColumn("_b", F.explode(F.array(*(bucket(ts_b) + i for i in (-1, 0, 1)))))
    near = F.expr(
        f"{key} = _key AND _a = _b AND {ts_b} >= {ts_a} - INTERVAL {seconds} SECONDS AND {ts_b} <= {ts_a} + INTERVAL {seconds} SECONDS"
    )
    return results.withColumn("_a", bucket(ts_a)).join(b, near, "left_outer" if how == "left" else how).drop("_key", "_a", "_b")


def match_when_over(results: DataFrame, traces: DataFrame, key: str, ts_a: str, ts_b: str, seconds: int, how: str = "inner") -> DataFrame:
    """The rows of :func:`match_streams`, each once the watermark has passed all that it could meet.

    A key's results of a stretch of ``seconds``, and the traces at most ``seconds`` from that stretch, are one row of state, and its
    pairs are made when it goes; no state is looked up for a pair. Left rows without a partner have to wait so long in any case, and
    those without a time do not. Columns of time have no watermark behind it, as they are older than it.
    """
    a, b = (F.struct(*(c for c in side.columns if c != key)) for side in (results, traces))
    spans = lambda ts: F.window(ts, f"{3 * seconds} seconds", f"{seconds} seconds").alias("_a")
    middle = f"_l.{ts_a} >= _a.start + INTERVAL {seconds} SECONDS AND _l.{ts_a} < _a.end - INTERVAL {seconds} SECONDS"
    x = results.select(key, spans(ts_a), a.alias("_l")).where(middle)
    x = x.unionByName(traces.where(F.col(key).isNotNull()).select(key, spans(ts_b), b.alias("_r")), allowMissingColumns=True)
    x = x.groupBy("_a", key).agg(F.collect_list("_l").alias("_ls"), F.collect_list("_r").alias("_rs"))
    apart = lambda r: F.abs(F.unix_micros(r[ts_b]) - F.unix_micros(F.col("_l")[ts_a]))
    near = F.filter("_rs", lambda r: apart(r) <= seconds * 1_000_000)
    x = x.select(key, F.explode("_ls").alias("_l"), "_rs").select(key, "_l", (F.explode_outer if how == "left" else F.explode)(near).alias("_r"))
    if how == "left":
        x = x.unionByName(results.where(F.col(ts_a).isNull()).select(key, a.alias("_l")), allowMissingColumns=True)
    mine = [F.col(c if c == key else f"_l.{c}").alias(c, metadata={}) for c in results.columns]
    return x.select(*mine, *(F.col(f"_r.{c}").alias(c, metadata={}) for c in traces.columns if c != key))


PENDING = ", ".join(f"{side} array<struct<id:bigint,ts:bigint,value:double>>" for side in ("results", "traces"))


def greedy_matcher(seconds: float, keep: float = 300.0, most: int | None = None) -> Callable:
    """State function of one tool: results and traces wait; each takes the first of the other kind in its window.

    Pending items older than ``keep`` seconds of event time go; a bound ``most`` on their number, which drops the oldest, is
    set by the caller only. Rows of a micro-batch are taken in the order of their time, and what waits is searched by time.
    """
    window, age = int(seconds * 1e6), int(keep * 1e6)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        waiting = {k: sorted((int(t), int(i), v) for i, t, v in part) for k, part in zip(("result", "trace"), held, strict=True)}
        new = pd.concat(list(batches)).sort_values(["us", "event_id"])
        out = []
        for kind, i, t, v in zip(*(new[c].tolist() for c in ("kind", "event_id", "us", "value")), strict=True):
            other = waiting["trace" if kind == "result" else "result"]
            at = bisect_left(other, (t - window,))
            if at < len(other) and other[at][0] <= t + window:
                _, mate, w = other.pop(at)
                out.append((key[0], i, mate, v, w) if kind == "result" else (key[0], mate, i, w, v))
            else:
                insort(waiting[kind], (t, i, v))
        if len(new):
            limit = int(new["us"].max()) - age
            for k, part in waiting.items():
                part = part[bisect_left(part, (limit,)) :]
                waiting[k] = part if most is None else part[-most:]
        state.update(tuple([(i, t, v) for t, i, v in waiting[k]] for k in ("result", "trace")))
        yield pd.DataFrame(out, columns=["tool", "result", "trace", "result_value", "trace_value"])

    return run


def match_greedily(messages: DataFrame, seconds: float, keep: float = 300.0) -> DataFrame:
    """One-to-one matches of a stream of results and traces (columns tool, kind, event_id, ts, value), with both values."""
    x = messages.where(F.col("kind").isin("result", "trace")).select("tool", "kind", "event_id", F.unix_micros("ts").alias("us"), "value")
    out = "tool bigint, result bigint, trace bigint, result_value double, trace_value double"
    return x.groupBy("tool").applyInPandasWithState(greedy_matcher(seconds, keep), out, PENDING, "append", GroupStateTimeout.NoTimeout)


def complete_sets(messages: DataFrame, required: list[str], timeout_ms: int = 60_000) -> DataFrame:
    """A row as soon as all required types of a key came (latest value of each); then the key starts anew.

    A set that is not complete so long after its first message is given up. Rows of a micro-batch are taken in the order of
    their time. The stream needs a watermark, which also removes what waits without further messages.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, kinds, values = state.get if state.exists else (None, [], [])
        held, out = dict(zip(kinds, values, strict=True)), []
        new = pd.concat(list(batches)).sort_values(["us", "event_id"])
        for kind, t, value in zip(*(new[c].tolist() for c in ("kind", "us", "value")), strict=True):
            if since is not None and t - since > timeout_ms * 1000:
                held, since = {}, None
            held[kind] = value
            since = t if since is None else since
            if len(held) == len(required):
                out.append([key[0], t, *(held[k] for k in required)])
                held, since = {}, None
        if held:
            state.update((since, list(held), list(held.values())))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), since // 1000) + timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["tool", "us", *required])

    kinds = ", ".join(f"{k} double" for k in required)
    x = messages.where(F.col("kind").isin(required)).select("tool", "kind", "event_id", F.unix_micros("ts").alias("us"), "value", "ts")
    return x.groupBy("tool").applyInPandasWithState(
        run, f"tool bigint, us bigint, {kinds}", "since bigint, kinds array<string>, vals array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def failure_alerts(messages: DataFrame, least: int = 5) -> DataFrame:
    """Messages of a stream (tool, event_id, bad) that are at least the so-manieth failure in a row; a success starts anew."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, out = state.get[0] if state.exists else 0, []
        new = pd.concat(list(batches)).sort_values("event_id")
        for i, bad in zip(new["event_id"].tolist(), new["bad"].tolist(), strict=True):
            streak = streak + 1 if bad else 0
            if streak >= least:
                out.append((key[0], i, streak))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["tool", "event_id", "streak"])

    x = messages.select("tool", "event_id", "bad")
    return x.groupBy("tool").applyInPandasWithState(run, "tool bigint, event_id bigint, streak bigint", "streak bigint", "append", GroupStateTimeout.NoTimeout)


def limited_alerts(messages: DataFrame, seconds: float) -> DataFrame:
    """Alerts of a stream (tool, ts) at least so long after the last one of the tool that was let through."""
    step = int(seconds * 1e6)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        for t in sorted(x for b in batches for x in b["us"].tolist()):
            if last is None or t - last >= step:
                last = t
                out.append((key[0], t))
        state.update((last,))
        yield pd.DataFrame(out, columns=["tool", "us"])

    x = messages.select("tool", F.unix_micros("ts").alias("us"))
    return x.groupBy("tool").applyInPandasWithState(run, "tool bigint, us bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(messages: DataFrame, ts: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return messages.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"))


def sessions(messages: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    return messages.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def failure_runs(df: DataFrame, key: str, order: str, failed: str, stretch: int = 1 << 16) -> DataFrame:
    """Batch form of the consecutive-failure count: failures since the last success (``streak``), in the order of a whole number.

    A key's rows are counted in stretches of the order, each apart; a row for each stretch tells what runs on into the next one,
    so a busy key is many tasks. What is null in ``failed`` is neither failure nor success.
    """
    yes, no = F.coalesce(F.col(failed), F.lit(False)).cast("int"), F.coalesce(~F.col(failed), F.lit(False)).cast("int")
    so_far = lambda *by, o=order: Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_b", F.col(order) - F.pmod(order, F.lit(stretch)))
    x = x.withColumn("_i", F.sum(no).over(so_far(key, "_b")))
    x = x.withColumn("streak", F.sum(yes).over(so_far(key, "_b", "_i")))
    ends = x.groupBy(F.col(key).alias("_key"), F.col("_b").alias("_at")).agg(F.max(F.struct("_i", "streak")).alias("_last"))
    ends = ends.withColumn("_s", F.sum((F.col("_last._i") > 0).cast("int")).over(so_far("_key", o="_at")))
    ends = ends.withColumn("_on", F.sum("_last.streak").over(so_far("_key", "_s", o="_at")))
    ends = ends.select("_key", "_at", F.lag("_on").over(Window.partitionBy("_key").orderBy("_at")).alias("_carried")).where("_carried > 0")
    x = x.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_b").eqNullSafe(F.col("_at")), "left")
    streak = F.col("streak") + F.when(F.col("_i") == 0, F.coalesce("_carried", F.lit(0))).otherwise(0)
    return x.select(*df.columns, streak.alias("streak"))


def counts_within(df: DataFrame, key: str, us: str, width: int) -> DataFrame:
    """Adds ``n``, how many rows of the key lie in the ``width`` before a row, both ends, the row and its equals included.

    A row also goes to the next stretch of that width, where it counts for others only, so stretches of a busy key are tasks of
    their own. Rows without a time count each other.
    """
    own = F.col(us) - F.pmod(us, F.lit(width))
    spots = F.when(F.col(us).isNull(), F.array(own)).otherwise(F.array(own, own + width))
    near = Window.partitionBy(key, "_b").orderBy(us).rangeBetween(-width, 0)
    x = df.select("*", F.explode(spots).alias("_b")).withColumn("n", F.count("*").over(near))
    return x.where(F.col("_b").eqNullSafe(own)).drop("_b")


def rate_limited(df: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Times (key, us) at least so long after the last one that was let through, per kind; equal times are one."""
    from boreflow.operators.joins import duplicates

    marked = duplicates(df.select(key, ts, F.lit(1).alias("_same")), key, ts, "_same", seconds)
    return marked.where("not is_duplicate").select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))


def run_once(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there and return what it wrote (in update mode the last state of each batch's rows)."""
    spark = stream.sparkSession

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put)
    q.trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/out")
    if mode == "complete":
        last = batches.agg(F.max("batch").alias("b")).first().b
        batches = batches.where(F.col("batch") == last)
    return batches.drop("batch")


def topic_messages(stream: DataFrame, root: str, topic: str = "topic") -> DataFrame:
    """Messages under ``root/+/+/`` whose topic is that of a result, a trace or heads; adds ``kind``."""
    kinds = {"ResultManagement": "result", "ResultManagement/Trace": "trace", "AssetManagement/Head": "heads", "AssetManagement/Heads": "heads"}
    parts = F.split(topic, "/")
    tail = F.array_join(F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))), "/")
    kind = F.lit(None).cast("string")
    for suffix, k in kinds.items():
        kind = F.when(tail == suffix, k).otherwise(kind)
    return stream.withColumn("kind", kind).where((F.get(parts, F.lit(0)) == root) & F.col("kind").isNotNull())


def read_events(spark: SparkSession, sf_dir: str, closing: str | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """The events table as a stream; with a ``closing`` scratch folder, and an event of each type long after all others.

    Those events, of user -1, move the watermark past the others, so that a join that ends with the table gives its last rows
    too. Filters that would drop them are applied before the watermark, so they can only be left out behind the stream. The
    ``types`` close too where the table has none of them, as one side without events would hold the watermark back.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may match a file or a folder
    if closing is None:
        return stream
    every = F.array_union(F.collect_set("event_type"), F.array(*map(F.lit, types)).cast("array<string>"))
    far = events.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts"), every.alias("event_type")).select("ts", F.explode("event_type").alias("event_type"))
    given = {"ts": F.col("ts"), "event_type": F.col("event_type"), "user_id": F.lit(-1)}
    far.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema)).write.parquet(closing)
    return stream.union(spark.readStream.schema(events.schema).parquet(closing))
