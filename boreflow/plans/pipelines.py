"""Messages to results in batch and as a stream, repeats by policy, ordered validation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators import joins as j
from boreflow.plans.bindings import MSG, TRACE, messages, table, trace
from boreflow.plans.depth import KEYPOINTS
from boreflow.plans.messages import _stream
from boreflow.plans.paths import scratch_path
from boreflow.queries import query
from boreflow.streaming import live, pipeline, state

T = f"WITH {TRACE} "
M = f"WITH {MSG} "
FILES = 4
#: Messages of a file at most, in the mean.
FILE_MESSAGES = 10_000


def cycle_messages(spark, d):
    """Messages of each hole: a result by step and a trace by sample up to 19 s later; heads, repeats, other roots, and faulty ones.

    Of a tool the holes lie 1,500 s apart.  Every 7th result is repeated after 0.4 s; every 6th hole has a trace under another root.
    """
    h = F.col("hole_id")
    g = trace(spark, d).groupBy("hole_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "pos_mm", "torque_a", "thrust_a", "step"))).alias("x"), F.array_sort(F.collect_set("step")).alias("steps")
    )

    def payload(**values):
        of = [F.struct(v.alias("Value"), F.lit("t").alias("SourceTimestamp")).alias("Unit." + k.replace("_", ".")) for k, v in values.items()]
        return F.to_json(F.struct(F.struct(F.struct(*of).alias("Payload")).alias("Messages")))

    result = payload(
        Step_Nb=F.col("steps"), Torque_Empty=F.transform("steps", lambda s: F.lit(4.5)), Thrust_Empty=F.transform("steps", lambda s: F.lit(0.5)),
        Machine_ID=F.when(h % 17 != 4, h.cast("string")), Result_ID=h,
    )
    result = F.when(h % 13 == 5, '{"Messages":{}}').otherwise(result)
    x = F.col("x")
    samples = payload(Position=x["pos_mm"], Torque_Values=x["torque_a"], Thrust_Values=x["thrust_a"], Step_Nb=x["step"])
    samples = F.when(h % 11 == 3, "{ broken").otherwise(samples)
    g = g.select("hole_id", result.alias("result"), samples.alias("samples"))

    def message(k, wanted, root, tail, seconds, value):
        topic = F.concat(F.lit(f"{root}/box"), h % 3, F.lit("/tool"), h % 5, F.lit(f"/{tail}"))
        us = (h * 100 + 1_700_000_000) * 1_000_000 + (seconds * 1_000_000).cast("bigint")
        row = F.struct((h * 10 + k).alias("event_id"), topic.alias("topic"), F.timestamp_micros(us).alias("ts"), value.alias("payload"))
        return F.when(wanted, row)

    always = F.lit(True)
    rows = F.array_compact(F.array(
        message(0, always, "plant", "ResultManagement", F.lit(0.0), F.col("result")),
        message(1, h % 7 == 0, "plant", "ResultManagement", F.lit(0.4), F.col("result")),
        message(2, always, "plant", "ResultManagement/Trace", (h % 20) * 1.0, F.col("samples")),
        message(3, h % 6 == 0, "lab", "ResultManagement/Trace", F.lit(-1.0), F.col("samples")),
        message(4, h % 5 == 0, "plant", "AssetManagement/Heads", F.lit(2.0), F.lit("{}")),
    ))
    return g.select("hole_id", F.explode(rows).alias("m")).select("hole_id", "m.*")


RESULTS = T + f""", {KEYPOINTS}, h AS (SELECT hole_id, count(*) AS n, max(at_max) FILTER (step = 0) AS a0, max(at_min) FILTER (step = 0) AS b0, max(at_max) FILTER (step = 1) AS a1,
    max(at_max) FILTER (step = 2) AS a2, max(at_min) FILTER (step = 2) AS b2 FROM k GROUP BY 1),
e AS (SELECT *, CASE WHEN hole_id % 13 = 5 THEN 'Result message missing required Messages.Payload structure' WHEN hole_id % 11 = 3 THEN 'Invalid JSON in trace message'
    WHEN hole_id % 17 = 4 THEN 'HOLE_ID is None or NaN' END AS error, CASE WHEN n >= 3 THEN a2 - a1 ELSE b0 - a0 END AS x, CASE WHEN n >= 3 THEN b2 - a2 END AS y FROM h)
SELECT 'box' || hole_id % 3 || '/tool' || hole_id % 5 AS tool, hole_id * 10 AS result, hole_id * 10 + 2 AS trace, error, CASE WHEN error IS NULL THEN round(x, 3) END AS first,
    CASE WHEN error IS NULL THEN round(y, 3) END AS second, CASE WHEN error IS NOT NULL THEN 'error' WHEN x < 0 OR y < 0 THEN 'suppressed' ELSE 'success' END AS route FROM e"""


def _told(x):
    return x.select(
        "tool", "result", "trace", "error", *(F.round(F.get("depths", F.lit(i)), 3).alias(n) for i, n in enumerate(("first", "second"))), "route"
    )


@query(RESULTS)
def d24_batch_results(spark, d):
    """Messages to results as a table: repeats out, greedy match, frames, validation, key points, depths, route."""
    return _told(pipeline.batch_results(cycle_messages(spark, d).drop("hole_id"), "plant", scratch_path(spark, "pairs")))


def _as_files(spark, rows, path, files=FILES):
    """The messages as files in the order of time, and a stream that reads those of one stretch of it in each micro-batch.

    A stretch is one file, or of many messages several, each written by a task of its own.
    """
    low, high, n = rows.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    width = (high - low) / files if low is not None else None
    tasks = max(1, -(-n // (files * FILE_MESSAGES)))
    for k in range(files if low is not None else 0):
        part = rows.where((F.col("ts") >= F.lit(low + k * width)) & ((F.col("ts") < F.lit(low + (k + 1) * width)) | F.lit(k == files - 1)))
        (part.coalesce(1) if tasks == 1 else part.repartition(tasks)).write.mode("append").parquet(path)
    if low is None:
        rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(path)


@query(RESULTS)
def r12_live_results(spark, d):
    """The same results from a stream of several micro-batches, with state between them and windows inside each."""
    at = scratch_path(spark, "r12-live")
    rows = spark.read.parquet(_saved(cycle_messages(spark, d).drop("hole_id"), f"{at}/messages"))
    return _told(pipeline.live_results(_as_files(spark, rows, f"{at}/files"), "plant", at))


def _saved(df, path):
    df.write.parquet(path)
    return path


@query(RESULTS.replace("SELECT 'box'", ", o AS (SELECT 'box'") + """)
SELECT 'plant/' || tool || '/Estimation/' || kind AS topic, result // 10 AS result_id, CASE kind WHEN 'DepthEstimation' THEN first END AS first FROM o,
    (VALUES ('Keypoints'), ('DepthEstimation')) AS k(kind) WHERE route = 'success'""")
def s17_live_records(spark, d):
    """Records of the successful results of the batch form: topic, result and the first depth."""
    x = pipeline.records(pipeline.batch_results(cycle_messages(spark, d).drop("hole_id"), "plant", scratch_path(spark, "pairs")), "plant")
    first = F.from_json(F.get_json_object("value", "$.Value"), "array<double>")[0]
    depth = F.when(F.col("topic").endswith("DepthEstimation"), F.round(first, 3))
    return x.select("topic", F.get_json_object("value", "$.ResultId").cast("bigint").alias("result_id"), depth.alias("first"))


DAY = 86_400_000_000
CHAINS = """x AS (SELECT event_id, tool, k, epoch_us(ts) AS us, lag(event_id) OVER o AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS gap, lead(epoch_us(ts)) OVER o - epoch_us(ts) AS ahead
    FROM msg WINDOW o AS (PARTITION BY tool, k ORDER BY ts, event_id))"""


@query(M + f", {CHAINS} SELECT event_id, CASE WHEN gap < {DAY} THEN before END AS replaces FROM x")
def r02_replacing_repeats(spark, d):
    """Repeats within a day replace the message before them, as a stream; which message each one replaces."""
    with state.keyed_state(spark):
        x = live.run_once(state.repeats(_stream(spark, d), ["tool", "k"], "replace", 86400.0), scratch_path(spark, "r02-replace"))
    return x.select("event_id", "replaces")


@query(f"""WITH RECURSIVE {MSG}, q AS (SELECT event_id, tool, k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY tool, k ORDER BY ts, event_id) AS n FROM msg),
g(tool, k, n, event_id, kept_at, dup) AS (SELECT tool, k, 1::BIGINT, event_id, t, false FROM q WHERE n = 1 UNION ALL
    SELECT q.tool, q.k, q.n, q.event_id, CASE WHEN q.t - kept_at < {DAY} THEN kept_at ELSE q.t END, q.t - kept_at < {DAY} FROM g JOIN q ON q.tool = g.tool AND q.k IS NOT DISTINCT FROM g.k AND q.n = g.n + 1)
SELECT event_id FROM g WHERE NOT dup""")
def r02_ignored_repeats(spark, d):
    """Messages that are no repeat within a day of the last one kept, by the exact rule in state."""
    with state.keyed_state(spark):
        x = live.run_once(state.repeats(_stream(spark, d), ["tool", "k"], "ignore", 86400.0), scratch_path(spark, "r02-ignore"))
    return x.select("event_id")


@query(M + f", {CHAINS} SELECT event_id FROM x WHERE ahead IS NULL OR ahead >= {DAY}")
def u05_replacing(spark, d):
    """Policy replace in batch: a message stays unless one of the same tool and content follows within a day."""
    return j.without_repeats(messages(spark, d), "tool", "ts", "k", 86400.0, "replace", "event_id").select("event_id")


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Missing required result message' WHEN 1 THEN 'Missing required trace message' WHEN 2 THEN 'Result message has no data content'
    WHEN 3 THEN 'Invalid JSON in result message' WHEN 4 THEN 'Result message data is not a valid dictionary' WHEN 5 THEN 'Result message missing required Messages.Payload structure'
    WHEN 6 THEN 'Trace message data is not a valid dictionary' END AS error, value > 30 AS apart FROM events""")
def p10_ordered_errors(spark, d):
    """First error of a pair of messages in the order of the checks, and whether they lie too far apart."""
    k, good = F.col("event_id") % 8, F.concat(F.lit('{"Messages":{"Payload":'), "props", F.lit("}}"))
    result = F.when(k == 2, " ").when(k == 3, F.lit("{ broken")).when(k == 4, F.lit("[1]")).when(k == 5, F.col("props")).when(k > 5, good).when(k == 1, good)
    shown = F.when(k == 6, F.lit("17")).when(k == 1, F.lit(None).cast("string")).otherwise(good)
    e = table(spark, d, "events").select("event_id", result.alias("r"), shown.alias("t"), F.timestamp_seconds(F.lit(0)).alias("a"), F.timestamp_micros((F.col("value") * 1e6).cast("bigint")).alias("b"))
    return e.select("event_id", c.pair_error(F.col("r"), F.col("t")).alias("error"), c.apart(F.col("a"), F.col("b")).alias("apart"))
