"""Buffer alerts with their rules, newest of what is not too old, alerts per window, exact codes, processed messages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.plans.bindings import MSG, messages, table
from boreflow.plans.messages import _tools
from boreflow.plans.paths import scratch_path
from boreflow.queries import query
from boreflow.streaming import alerts, live

M = f"WITH {MSG} "
#: Seconds of waiting for each unit of an event's value; what has none is never processed. Messages that a buffer holds.
PACE, CAPACITY = 400.0, 20
AGE = 14_400.0


def _waiting(spark, d):
    us = F.unix_micros("ts")
    done = F.when(F.col("k") % 3 > 0, us + (F.col("value") * PACE * 1e6).cast("bigint"))
    m = messages(spark, d).select(F.col("kind").alias("key"), F.col("event_id").alias("id"), us.alias("us"), done.alias("done_us"))
    return alerts.stays(m, AGE)


WAITING = f"""s AS (SELECT kind AS key, event_id AS id, epoch_us(ts) AS us, CASE WHEN k % 3 > 0 THEN epoch_us(ts) + CAST(trunc(value * {PACE} * 1e6) AS BIGINT) END AS done FROM msg),
a AS (SELECT *, done IS NULL OR done > us + {int(AGE * 1e6)} AS removed, CASE WHEN done IS NULL OR done > us + {int(AGE * 1e6)} THEN us + {int(AGE * 1e6)} ELSE done END AS leave_us FROM s)"""
LEVEL = f"CASE WHEN n >= 0.9 * {CAPACITY} THEN 'critical' WHEN n >= 0.8 * {CAPACITY} THEN 'high' WHEN n >= 0.6 * {CAPACITY} THEN 'warn' ELSE 'ok' END"
OCCUPIED = f"""{WAITING}, v AS (SELECT key, id, us AS t, 1 AS d FROM a UNION ALL SELECT key, id, leave_us, -1 FROM a),
o AS (SELECT key, id, t AS us, d, sum(d) OVER (PARTITION BY key ORDER BY t, d, id ROWS UNBOUNDED PRECEDING) AS n FROM v)"""


@query(M + f", {OCCUPIED} SELECT key, id, us, CAST(n AS BIGINT) AS waiting, {LEVEL} AS level FROM o WHERE d = 1")
def r10_occupancy(spark, d):
    """How many messages of a kind wait at each arrival, and the level against the buffer's capacity."""
    return alerts.occupancy(_waiting(spark, d), CAPACITY)


@query(M + f""", {WAITING} SELECT key, us // 3600000000 AS hour, count(*) AS n, round(max(leave_us - us) / 1e6, 3) AS oldest, round(avg(removed::INTEGER), 5) AS share,
    count(*) FILTER (removed) AS unprocessed, max(leave_us - us) / 1e6 > 240 AS is_old, avg(removed::INTEGER) > 0.5 AS is_removing, count(*) FILTER (removed) > 100 AS is_unprocessed FROM a GROUP BY 1, 2""")
def r10_hourly_rules(spark, d):
    """Oldest wait, share removed and number unprocessed of each hour, with the rule that each one breaks."""
    x = alerts.hourly(_waiting(spark, d))
    return x.withColumns({"oldest": F.round("oldest", 3), "share": F.round("share", 5)})


@query(f"""WITH RECURSIVE {MSG}, {OCCUPIED}, l AS (SELECT DISTINCT us, {LEVEL} AS level FROM o WHERE d = 1), e AS (SELECT level, us, row_number() OVER (PARTITION BY level ORDER BY us) AS q FROM l WHERE level <> 'ok'),
g(level, q, us, kept, yes) AS (SELECT level, q, us, us, true FROM e WHERE q = 1 UNION ALL
    SELECT e.level, e.q, e.us, CASE WHEN e.us - kept < 21600000000 THEN kept ELSE e.us END, e.us - kept >= 21600000000 FROM g JOIN e ON e.level = g.level AND e.q = g.q + 1)
SELECT level, us FROM g WHERE yes""")
def r10_limited_alerts(spark, d):
    """Alerts of each level, at most one in six hours."""
    x = alerts.occupancy(_waiting(spark, d), CAPACITY).where("level <> 'ok'")
    return alerts.limited(x, "level", "us", 6 * 3600)


@query("""SELECT epoch_us(ts) // 86400000000 AS day, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 60""")
def r11_failure_alerts(spark, d):
    """Windows of a day with more than sixty failures of a category, as a stream that forgets windows that are over."""
    ev = live.with_late_limit(live.read_events(spark, d, scratch_path(spark, "closing"))).select("ts", F.when(F.col("user_id") >= 0, F.col("event_type")).alias("category"))
    x = live.windowed_counts(ev, "ts", "1 day", ["category"]).where("n > 60")
    x = live.run_once(x, scratch_path(spark, "r11-alerts")).where("category is not null")
    return x.select((F.unix_seconds("w.start") / 86400).cast("bigint").alias("day"), "category", "n")


@query(M + """, l AS (SELECT max(epoch_us(ts)) - 864000000000 AS low FROM msg), n AS (SELECT topic, event_id, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, event_id DESC) AS k
    FROM msg, l WHERE epoch_us(ts) >= low) SELECT topic, event_id FROM n WHERE k <= 5""")
def t06_newest_of_young(spark, d):
    """What is over ten days older than the newest message goes, then the five newest of each topic stay."""
    m = messages(spark, d)
    low = m.agg((F.max(F.unix_micros("ts")) - 864_000_000_000).alias("low"))
    young = m.join(F.broadcast(low), F.unix_micros("ts") >= F.col("low"))
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("ts"), F.desc("event_id")))
    return young.withColumn("k", k).where("k <= 5").select("topic", "event_id")


@query("""SELECT p_partkey, CASE p_size WHEN 1 THEN 'start' WHEN 2 THEN 'depth' WHEN 4 THEN 'torque' WHEN 8 THEN 'thrust' WHEN 16 THEN 'time' WHEN 32 THEN 'stop' END AS name FROM part""")
def f15_exact_code(spark, d):
    """Name of the stop code that a value is exactly, none for combinations."""
    codes = {1: "start", 2: "depth", 4: "torque", 8: "thrust", 16: "time", 32: "stop"}
    return table(spark, d, "part").select("p_partkey", c.exact_code(F.col("p_size"), codes).alias("name"))


@query(M + """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE kind END AS type, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE tool::VARCHAR END AS key,
    CASE WHEN event_id % 3 = 0 THEN '{"raw":"no \\"json\\"","_topic":"' ELSE '{"id":' || tool || ',"type":"' || kind || '","_topic":"' END || CASE WHEN tool % 2 = 0 THEN 'control/' || tool || '"}' ELSE tool || '"}' END AS data FROM msg""")
def x03_processed_messages(spark, d):
    """Topic without its prefix, type and key of the payload; what is no JSON comes as raw text."""
    tool = F.col("tool").cast("string")
    topic = F.concat(F.when(F.col("tool") % 2 == 0, "data/control/").otherwise("data/"), tool)
    payload = F.when(F.col("event_id") % 3 == 0, 'no "json"').otherwise(F.to_json(F.struct(F.col("tool").alias("id"), F.col("kind").alias("type"))))
    return messages(spark, d).select("event_id", *(v.alias(k) for k, v in c.processed(topic, payload, "data/").items()))
