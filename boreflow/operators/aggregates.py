"""Aggregates per hole, file, step or bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.places import places
from boreflow.operators.windows import HOLE, IDX, by_hole


def first_by(c: str | Column, order: str = IDX) -> Column:
    return F.min_by(c, order)


def last_by(c: str | Column, order: str = IDX) -> Column:
    return F.max_by(c, order)


def trapezoid(df: DataFrame, y: str, x: str, keys: list[str], out: str = "area") -> DataFrame:
    """Area of y over x for each key (the hole first), in sample order."""
    w = by_hole(*[k for k in keys if k != HOLE])
    term = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select(*keys, IDX, term.alias("_t")).groupBy(*keys).agg(F.coalesce(F.sum("_t"), F.lit(0.0)).alias(out))


def entropy(df: DataFrame, c: str, key: str = HOLE) -> DataFrame:
    """Entropy (nats) of the value counts of each key."""
    counts = df.groupBy(key, c).agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    return total.select(key, (F.log("t") - F.col("s") / F.col("t")).alias("entropy"))


def snr(c: str) -> Column:
    return F.when(F.stddev_pop(c) == 0, 0.0).otherwise(F.avg(c) / F.stddev_pop(c))


def mean_abs_deviation(df: DataFrame, c: str, key: str = HOLE) -> DataFrame:
    mean = df.groupBy(key).agg(F.avg(c).alias("_m"))
    return df.join(mean, key).groupBy(key).agg(F.avg(F.abs(F.col(c) - F.col("_m"))).alias("mad"))


def hole_features(df: DataFrame, c: str, pos: str) -> DataFrame:
    """min, max, mean, energy and area over position of each hole in one pass after one sort."""
    w = by_hole()
    term = (F.col(pos) - F.lag(pos).over(w)) * (F.col(c) + F.lag(c).over(w)) / 2
    return df.select(HOLE, IDX, c, term.alias("_t")).groupBy(HOLE).agg(
        F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.sum(F.col(c) * F.col(c)).alias("energy"),
        F.sum("_t").alias("area"), F.count("*").alias("n"),
    )


def batch_steps(df: DataFrame, pos: str, path: str, step: str = "step") -> DataFrame:
    """A row for each step of each hole: the hole's place in the batch, how many samples, where it starts.

    Places count from 1 by hole; ``path`` is a new scratch folder. Steps that a hole lacks have no row.
    """
    found = df.groupBy(HOLE, step).agg(F.count("*").alias("n"), first_by(pos).alias("start"))
    holes = places(df.select(HOLE).distinct(), [HOLE], path).withColumnRenamed(HOLE, "_hole")
    x = found.join(holes, F.col(HOLE).eqNullSafe(F.col("_hole")))
    return x.select(step, "place", HOLE, "n", "start")


def step_distance(a: DataFrame, b: DataFrame, step: str, values: list[str], keys: list[str]) -> DataFrame:
    """Sum over steps of the Euclidean distance of two programs, missing steps as zeros."""
    x = a.select(*keys, step, *(F.col(v).alias(f"{v}_a") for v in values))
    y = b.select(*keys, step, *(F.col(v).alias(f"{v}_b") for v in values))
    both = x.join(y, [*keys, step], "full_outer").fillna(0.0)
    d = sum((F.pow(F.col(f"{v}_a") - F.col(f"{v}_b"), 2) for v in values), F.lit(0.0))
    return both.groupBy(*keys).agg(F.sum(F.sqrt(d)).alias("distance"))


def scores(truth: str, guess: str) -> list[Column]:
    """Accuracy, precision, recall and F1 of binary columns."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    tp, fp, fn = F.count_if(t & g), F.count_if(~t & g), F.count_if(t & ~g)
    return [
        F.avg((t == g).cast("double")).alias("accuracy"), (tp / (tp + fp)).alias("precision"),
        (tp / (tp + fn)).alias("recall"), (2 * tp / (2 * tp + fp + fn)).alias("f1"),
    ]
