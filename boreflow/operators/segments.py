"""Depth from the statistics of feed segments: the window of each segment follows its own feed rate.

A segment ends where the position turns back. Its feed is the median advance of a sample, and its window holds the samples that
the bit's front face takes to pass: ``bit / feed``, rounded half to even. Gradients are per mm; the first sample of a segment has none,
nor has one that did not advance. A window counts once it is full of gradients.

Windows as wide as a column says are no frames that SQL can name, so the samples of a segment are held as one array and each window
is a slice of it: an array is as long as a drilling cycle, never longer than a hole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.functions.columns import once
from boreflow.operators.windows import HOLE, IDX, segments

DIGITS = 6


def feed_windows(df: DataFrame, bit: float = 0.7, pos: str = "pos_mm") -> DataFrame:
    """Adds segment, ``feed`` (median advance) and ``width`` (samples of a window, null without a feed forwards)."""
    x = segments(df.withColumn("_p", F.abs(F.col(pos))), "_p")
    inside = Window.partitionBy(HOLE, "segment")
    x = x.withColumn("_dp", F.col("_p") - F.lag("_p").over(inside.orderBy(IDX)))
    x = x.withColumn("feed", F.percentile("_dp", F.lit(0.5)).over(inside))
    width = F.when(F.col("feed") > 0, F.greatest(F.bround(F.lit(bit) / F.col("feed"), 0), F.lit(1.0)).cast("int"))
    return x.withColumn("width", width)


def _median(values: Column) -> Column:
    at = lambda o, half: F.get(o, F.floor(half / 2).cast("int"))
    return once(F.sort_array(values), lambda o: (at(o, F.size(o) - 1) + at(o, F.size(o))) / 2)


def segment_statistics(df: DataFrame, c: str, bit: float = 0.7, pos: str = "pos_mm", only: tuple[int, ...] = ()) -> DataFrame:
    """Per hole and segment: width, and the positions of the largest and smallest rolling mean and median gradient.

    Of equal gradients the first sample counts; a segment without a full window has nulls. If ``only`` some segments are asked
    for, the others have their row, with nulls.
    """
    x = feed_windows(df, bit, pos)
    rise = F.col(c) - F.lag(c).over(Window.partitionBy(HOLE, "segment").orderBy(IDX))
    x = x.withColumn("_g", F.when(F.col("_dp") != 0, rise / F.col("_dp")))
    item = F.struct(F.col(IDX).alias("i"), F.col("_p").alias("p"), F.col("_g").alias("g"))
    asked = F.col("segment").isin(*only) if only else F.lit(True)
    g = x.groupBy(HOLE, "segment").agg(F.first("width").alias("width"), F.sort_array(F.collect_list(F.when(asked, item))).alias("s"))
    ends = F.when(F.col("width") < F.size("s"), F.sequence(F.col("width"), F.size("s") - 1))

    def window(k: Column) -> Column:
        at = F.get(F.col("s"), k)

        def told(values: Column) -> Column:
            mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.col("width")
            return F.when(~F.exists(values, lambda v: v.isNull()), F.struct(
                F.round(mean, DIGITS).alias("mean"), F.round(_median(values), DIGITS).alias("median"), at["i"].alias("i"), at["p"].alias("p"),
            ))

        return once(F.slice(F.col("s"), k - F.col("width") + 2, F.col("width"))["g"], told)

    g = g.select(HOLE, "segment", "width", F.filter(F.transform(ends, window), lambda w: w.isNotNull()).alias("w"))

    def place(stat: str, sign: int) -> Column:
        ranked = F.transform("w", lambda w: F.struct((sign * w[stat]).alias("v"), w["i"].alias("i"), w["p"].alias("p")))
        return F.array_min(ranked)["p"]

    return g.select(
        HOLE, "segment", "width", place("mean", -1).alias("mean_max"), place("mean", 1).alias("mean_min"),
        place("median", -1).alias("median_max"), place("median", 1).alias("median_min"),
    )


def layer_depths(statistics: DataFrame, *stats: str, first: int = 1, second: int = 2) -> DataFrame:
    """Entry, transition and exit of a hole, and the depths between them, a row for each of ``stats``; null unless they follow each other.

    ``first`` and ``second`` are the segments that drill the upper and the lower layer.
    """
    stats = stats or ("median",)
    at = lambda seg, name: F.max(F.when(F.col("segment") == seg, F.col(name)))
    places = lambda s: ((first, f"{s}_max", "entry"), (second, f"{s}_max", "transition"), (second, f"{s}_min", "exit"))
    g = statistics.groupBy(HOLE).agg(*(at(seg, name).alias(f"{s}_{n}") for s in stats for seg, name, n in places(s)))
    one = lambda s: F.struct(F.lit(s).alias("stat"), *(F.col(f"{s}_{n}").alias(n) for *_, n in places(s)))
    g = g.select(HOLE, F.explode(F.array(*map(one, stats))).alias("r")).select(HOLE, "r.*")
    ordered = (F.col("entry") < F.col("transition")) & (F.col("transition") < F.col("exit"))
    depth = lambda a, b: F.when(ordered, F.col(b) - F.col(a))
    return g.withColumns(
        {"total": depth("entry", "exit"), "upper": depth("entry", "transition"), "lower": depth("transition", "exit")}
    )


def combined_depths(layers: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows (hole_id, entry, transition, exit) from the places of segments and the ends (``first``, ``last``) of a model.

    The model's ends stand, and the transition moves by the mean of both ends' delays. Without a transition the segments' own ends
    stand, with a transition of 0; all are null where an end is missing.
    """
    x = layers.select(HOLE, "entry", "transition", "exit").join(ends.select(HOLE, "first", "last"), HOLE, "left")
    entry, middle, exit_, first, last = (F.col(n) for n in ("entry", "transition", "exit", "first", "last"))
    moved = middle - (entry - first + exit_ - last) / 2
    two, three = middle.isNull() & (exit_ - entry).isNotNull(), moved.isNotNull()
    return x.select(
        HOLE, F.when(three, first).when(two, entry).alias("entry"), F.when(three, moved).when(two, 0.0).alias("transition"),
        F.when(three, last).when(two, exit_).alias("exit"),
    )
