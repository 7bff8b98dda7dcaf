"""Window operators over the samples of a hole; they all share one partitioning by hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOLE, IDX = "hole_id", "idx"


def by_hole(*extra: str):
    return Window.partitionBy(HOLE, *extra).orderBy(IDX)


def last_n(n: int, *extra: str):
    return by_hole(*extra).rowsBetween(-(n - 1), 0)


def centred(n: int, *extra: str):
    return by_hole(*extra).rowsBetween(-(n // 2), n - 1 - n // 2)


def whole(*extra: str):
    return Window.partitionBy(HOLE, *extra)


def _full(c: Column, w, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(w) == n, c)


def slope_ols(y: Column, n: int) -> Column:
    """Least-squares slope over the last n samples, 0 before there are as many."""
    w = last_n(n)
    return F.coalesce(_full(F.regr_slope(y, F.col(IDX)).over(w), w, n), F.lit(0.0))


def slope_ends(y: Column, n: int) -> Column:
    return F.coalesce((y - F.lag(y, n - 1).over(by_hole())) / (n - 1), F.lit(0.0))


def slope_both(y: Column, n: int, mode: str = "sum") -> Column:
    """Forward slope and that of the following samples, aligned to the sample."""
    ahead = by_hole().rowsBetween(0, n - 1)
    after = F.coalesce(_full(F.regr_slope(y, F.col(IDX)).over(ahead), ahead, n), F.lit(0.0))
    both = slope_ols(y, n) + after
    return both if mode == "sum" else both / 2


def running_trapezoid(y: Column, x: Column) -> Column:
    """Area under y over x from the first sample on; needs its terms as columns (see ``integrate``)."""
    w = by_hole()
    return F.coalesce((x - F.lag(x).over(w)) * (y + F.lag(y).over(w)) / 2, F.lit(0.0))


def integrate(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    terms = df.withColumn(f"_{out}", running_trapezoid(F.col(y), F.col(x)))
    run = by_hole().rowsBetween(Window.unboundedPreceding, 0)
    return terms.withColumn(out, F.sum(f"_{out}").over(run)).drop(f"_{out}")


def rolling(kind: str, c: Column, n: int, *extra: str) -> Column:
    """mean, max, min, median, var or rms of the last n values, null before there are as many."""
    w = last_n(n, *extra)
    fn = {
        "mean": F.avg(c), "max": F.max(c), "min": F.min(c), "var": F.var_samp(c), "rms": F.avg(c * c),
        "median": F.percentile(c, F.lit(0.5)),
    }[kind].over(w)
    counted = F.when(F.count(c).over(w) == n, fn)
    return F.sqrt(counted) if kind == "rms" else counted


def smooth_centred(df: DataFrame, c: str, n: int, out: str, *extra: str) -> DataFrame:
    """Centred mean, ends filled with the nearest full value."""
    w = centred(n, *extra)
    raw = df.withColumn("_m", F.when(F.count(c).over(w) == n, F.avg(c).over(w)))
    back = by_hole(*extra).rowsBetween(Window.unboundedPreceding, 0)
    # the next full value is the last one in the turned order, a running value; a frame to the end is read anew for each row
    turned = Window.partitionBy(HOLE, *extra).orderBy(F.desc(IDX)).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce("_m", F.last("_m", True).over(turned), F.last("_m", True).over(back))
    return raw.withColumn(out, filled).drop("_m")


def wiener(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Local mean and variance over n samples (zeros beyond the ends), noise as the mean variance."""
    w = centred(n)
    x = F.col(c)
    local = df.withColumns({"_m": F.sum(x).over(w) / n, "_q": F.sum(x * x).over(w) / n})
    local = local.withColumn("_v", F.col("_q") - F.col("_m") * F.col("_m")).withColumn("_noise", F.avg("_v").over(whole()))
    gain = F.when(F.col("_v") < F.col("_noise"), 0.0).otherwise(1 - F.col("_noise") / F.col("_v"))
    return local.withColumn(out, F.col("_m") + gain * (x - F.col("_m"))).drop("_m", "_q", "_v", "_noise")


def weighted_mean(c: str, weights: list[float]) -> Column:
    """Dot product with weights around the sample; null where the frame is not full."""
    n = len(weights)
    w = centred(n)
    frame = F.collect_list(c).over(w)
    terms = F.zip_with(frame, F.array(*map(F.lit, weights)), lambda a, b: a * b)
    return F.when(F.count(F.lit(1)).over(w) == n, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def savgol_linear_weights(n: int) -> list[float]:
    """Order 1: the fit at the centre of a symmetric window is its weighted mean; weights fall off linearly."""
    half = n // 2
    raw = [half + 1 - abs(i - half) for i in range(n)]
    return [r / sum(raw) for r in raw]


def savgol_quadratic_weights(n: int) -> list[float]:
    """Order 2 smoothing weights of a symmetric window, from the normal equations."""
    h = n // 2
    s2 = sum(i * i for i in range(-h, h + 1))
    s4 = sum(i**4 for i in range(-h, h + 1))
    d = n * s4 - s2 * s2
    return [(s4 - s2 * i * i) / d for i in range(-h, h + 1)]


def gradient(df: DataFrame, c: str, out: str) -> DataFrame:
    """Central differences, one-sided at the ends."""
    w = by_hole()
    a, b, x = F.lag(c).over(w), F.lead(c).over(w), F.col(c)
    return df.withColumn(out, F.when(a.isNull(), b - x).when(b.isNull(), x - a).otherwise((b - a) / 2))


def tukey(df: DataFrame, c: str, out: str, alpha: float = 0.1) -> DataFrame:
    """Cosine taper of both ends."""
    n = F.count(F.lit(1)).over(whole())
    i = F.col(IDX)
    edge = alpha * (n - 1) / 2
    up = (1 + F.cos(F.pi() * (i / edge - 1))) / 2
    down = (1 + F.cos(F.pi() * (i / edge - 2 / F.lit(alpha) + 1))) / 2
    taper = F.when(i < edge, up).when(i > (n - 1) - edge, down).otherwise(1.0)
    return df.withColumn(out, F.col(c) * taper)


def segments(df: DataFrame, pos: str = "pos_mm", out: str = "segment") -> DataFrame:
    """Number of reversals so far."""
    back = df.withColumn("_back", (F.col(pos) - F.lag(pos).over(by_hole()) < 0).cast("int"))
    run = by_hole().rowsBetween(Window.unboundedPreceding, 0)
    return back.withColumn(out, F.coalesce(F.sum("_back").over(run), F.lit(0))).drop("_back")


def peaks(df: DataFrame, c: str, share: float | None = 0.5) -> DataFrame:
    """Local maxima (the middle of a plateau) of at least a share of the hole's maximum; all of them for None."""
    w = by_hole()
    changed = df.withColumn("_new", (~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int"))
    runs = changed.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flat = runs.groupBy(HOLE, "_run").agg(F.min(IDX).alias("lo"), F.max(IDX).alias("hi"), F.first(c).alias(c))
    order = Window.partitionBy(HOLE).orderBy("_run")
    high = (F.col(c) > F.lag(c).over(order)) & (F.col(c) > F.lead(c).over(order))
    marked = flat.withColumns({"_peak": high, "_top": F.max(c).over(Window.partitionBy(HOLE))})
    found = marked.where("_peak") if share is None else marked.where("_peak").where(F.col(c) >= share * F.col("_top"))
    return found.select(HOLE, F.floor((F.col("lo") + F.col("hi")) / 2).alias(IDX), c)


def reindexed_padding(df: DataFrame, columns: list[str], rows: int, value: float = -1.0) -> DataFrame:
    """So many rows of a value before and after each hole; idx starts anew at 0."""
    n = df.groupBy(HOLE).agg(F.count("*").alias("_n"))
    pad = n.select(HOLE, "_n", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_k"))
    pad = pad.select(HOLE, F.explode(F.array(F.col("_k"), F.col("_k") + rows + F.col("_n"))).alias(IDX))
    pad = pad.select(HOLE, F.col(IDX).cast("bigint").alias(IDX), *(F.lit(value).alias(c) for c in columns))
    return df.select(HOLE, (F.col(IDX) + rows).alias(IDX), *columns).unionByName(pad)


def lagged_features(df: DataFrame, c: str, step: int = 2, phases: int = 3, shifts: int = 5) -> DataFrame:
    """Samples of a step dealt to phases (idx mod 3); each phase with lags 0 to 4, side by side."""
    rows = df.where(F.col("step") == step)
    rows = rows.withColumn("_r", F.row_number().over(by_hole()) - 1)
    rows = rows.select(HOLE, (F.col("_r") % phases).alias("_p"), F.floor(F.col("_r") / phases).alias("row"), c)
    wide = rows.groupBy(HOLE, "row").pivot("_p", list(range(phases))).agg(F.first(c))
    wide = wide.where(F.col(str(phases - 1)).isNotNull())
    w = Window.partitionBy(HOLE).orderBy("row")
    out = [
        F.coalesce(F.lag(str(p), k).over(w), F.lit(0.0)).alias(f"torque{phases * k + p + 1}")
        for k in range(shifts)
        for p in range(phases)
    ]
    return wide.select(HOLE, "row", *out)


def hann(n: int) -> list[float]:
    """Periodic cosine window."""
    from math import cos, pi

    return [0.5 - 0.5 * cos(2 * pi * i / n) for i in range(n)]


def line_coefficients(n: int, at: int, weights: list[float]) -> list[float]:
    """What each of n samples counts for in the value at a place of the line fitted to them by weighted least squares."""
    w = [x * x for x in weights]  # residuals are weighted before they are squared
    s0, s1, s2 = (sum(x * i**k for i, x in enumerate(w)) for k in (0, 1, 2))
    d = s0 * s2 - s1 * s1
    return [x * (s2 - s1 * i + at * (s0 * i - s1)) / d for i, x in enumerate(w)]


def line_fit(c: str, n: int, weights: list[float] | None = None) -> Column:
    """Savitzky-Golay of order 1: the mean of the n samples around; at the ends the weighted line through the first or last n.

    Null in holes of fewer than n samples.
    """
    weights, half, o = weights or hann(n), n // 2, by_hole()
    i, last = F.col(IDX) - F.min(IDX).over(whole()), F.max(IDX).over(whole()) - F.col(IDX)

    def dot(coefficients: list[float], first: int) -> Column:
        out = F.lit(0.0)
        for k, x in enumerate(coefficients):
            at = first + k
            out = out + F.lit(x) * (F.lag(c, -at).over(o) if at < 0 else F.lead(c, at).over(o))
        return out

    out = _full(F.avg(c).over(centred(n)), centred(n), n)
    for k in range(half):
        out = F.when(i == k, dot(line_coefficients(n, k, weights), -k)).when(last == k, dot(line_coefficients(n, n - 1 - k, weights), k - n + 1)).otherwise(out)
    return out
