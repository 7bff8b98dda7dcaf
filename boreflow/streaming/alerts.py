"""Alerts on buffers: how full they are, how old what waits is, how much is removed unprocessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.streaming.live import rate_limited

#: Shares of the capacity from which a buffer is at a level, highest first.
LEVELS = ((0.9, "critical"), (0.8, "high"), (0.6, "warn"))
#: Seconds that a message may wait; age of the oldest, share removed and number unprocessed that alert.
MOST_AGE, OLD, REMOVED, UNPROCESSED = 300.0, 240.0, 0.5, 100
_HOUR = 3_600_000_000


def level_of(share: Column) -> Column:
    out = F.lit("ok")
    for least, name in reversed(LEVELS):
        out = F.when(share >= least, name).otherwise(out)
    return out


def stays(messages: DataFrame, most_age: float = MOST_AGE) -> DataFrame:
    """Adds ``leave_us`` and ``removed`` to rows (key, id, us, done_us): a message goes when it is processed, or removed when too old."""
    limit = F.col("us") + int(most_age * 1e6)
    late = F.col("done_us").isNull() | (F.col("done_us") > limit)
    return messages.withColumns({"leave_us": F.when(late, limit).otherwise(F.col("done_us")), "removed": late})


def occupancy(waiting: DataFrame, capacity: int) -> DataFrame:
    """(key, id, us, waiting, level) at each arrival: how many messages wait then, itself included; who leaves at that moment is gone.

    A sweep over arrivals and departures: running sums inside an hour, and over the hours of a key, of which there are few; so a
    busy key is not one sorted group.
    """
    moves = waiting.select("key", "id", F.col("us").alias("t"), F.lit(1).alias("d"))
    moves = moves.union(waiting.select("key", "id", "leave_us", F.lit(-1))).withColumn("hour", F.floor(F.col("t") / _HOUR))
    inside = Window.partitionBy("key", "hour").orderBy("t", "d", "id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("key").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = moves.groupBy("key", "hour").agg(F.sum("d").alias("d"))
    hours = hours.select(F.col("key").alias("k"), F.col("hour").alias("h"), F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("before"))
    x = moves.withColumn("n", F.sum("d").over(inside)).join(hours, F.col("key").eqNullSafe(F.col("k")) & (F.col("hour") == F.col("h")))
    n = F.col("before") + F.col("n")
    return x.where("d = 1").select("key", "id", F.col("t").alias("us"), n.alias("waiting"), level_of(n / capacity).alias("level"))


def hourly(waiting: DataFrame) -> DataFrame:
    """Per key and hour of arrival: messages, the oldest wait in seconds, the share removed, how many were; with a flag for each rule."""
    age = (F.col("leave_us") - F.col("us")) / 1e6
    g = waiting.groupBy("key", F.floor(F.col("us") / _HOUR).alias("hour")).agg(
        F.count("*").alias("n"), F.max(age).alias("oldest"), F.avg(F.col("removed").cast("double")).alias("share"), F.count_if("removed").alias("unprocessed")
    )
    return g.withColumns(
        {"is_old": F.col("oldest") > OLD, "is_removing": F.col("share") > REMOVED, "is_unprocessed": F.col("unprocessed") > UNPROCESSED}
    )


def limited(alerts: DataFrame, kind: str, us: str, seconds: float) -> DataFrame:
    """At most one alert (kind, us) of a kind in so many seconds."""
    return rate_limited(alerts.select(kind, F.timestamp_micros(us).alias("ts")), kind, "ts", seconds)
