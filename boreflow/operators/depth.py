"""Depth estimation: reference peaks, key points per step, labels, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators import windows as w
from boreflow.operators.windows import HOLE, IDX


def _pick(mode: str, value: Column, pos: Column, where: Column) -> Column:
    """Position of the largest value, or of the first or last sample, within a window."""
    if mode == "first":
        return F.min(F.when(where, pos))
    if mode == "last":
        return F.max(F.when(where, pos))
    score = F.struct(F.round(value, 9).alias("v"), (-pos).alias("p"))
    return -F.max(F.when(where, score)).getField("p")


def reference_depth(
    df: DataFrame, c: str, n: int = 20, xstart: float = 10.0, expected: float = 15.0, win: float = 8.0,
    correction: float = 0.0, mode: str = "max", share: float = 0.8, taper: bool = True, pos: str = "pos_mm",
) -> DataFrame:
    """Entry peak of the rolling slope up to xstart, exit peak of its negative about the expected depth.

    ``mode``: max, or first / last among the samples of at least a share of the window's largest slope.  Rows
    (hole, xa, xb, depth); null where a window holds no sample.
    """
    x = df.withColumn("_p", F.abs(F.col(pos)))
    x = w.wiener(x, c, 15, "_s").withColumn("_g", w.slope_ends(F.col("_s"), n))
    if taper:
        x = w.tukey(x, "_g", "_g")
    x = x.select(HOLE, IDX, "_p", "_g")
    first = F.col("_p") <= xstart
    if mode == "max":
        a = x.groupBy(HOLE).agg(_pick("max", F.col("_g"), F.col("_p"), first).alias("xa"))
    else:
        top = F.max(F.when(first, F.col("_g"))).over(Window.partitionBy(HOLE))
        strong = first & (F.round("_g", 9) >= F.round(share * F.col("_top"), 9))
        a = x.withColumn("_top", top).groupBy(HOLE).agg(_pick(mode, F.col("_g"), F.col("_p"), strong).alias("xa"))
    y = x.join(a, HOLE)
    second = (F.col("_p") >= F.col("xa") + expected - win / 2) & (F.col("_p") <= F.col("xa") + expected + win / 2)
    if mode == "max":
        b = y.groupBy(HOLE, "xa").agg(_pick("max", -F.col("_g"), F.col("_p"), second).alias("xb"))
    else:
        top = F.max(F.when(second, -F.col("_g"))).over(Window.partitionBy(HOLE))
        strong = second & (F.round(-F.col("_g"), 9) >= F.round(share * F.col("_top"), 9))
        b = y.withColumn("_top", top).groupBy(HOLE, "xa").agg(_pick(mode, -F.col("_g"), F.col("_p"), strong).alias("xb"))
    return b.withColumn("depth", F.col("xb") - F.col("xa") + correction)


def depth_sweep(
    df: DataFrame, c: str, ns: list[int], expected: list[float], wins: list[float], xstart: float = 10.0, pos: str = "pos_mm"
) -> DataFrame:
    """Untapered ``reference_depth`` for each slope length, expected depth and window: (hole, n, expected, win, xa, xb, depth).

    The signal is shuffled and smoothed once; each slope length is a column, and each cell a pair of conditional maxima over
    the hole, so the grid widens the aggregation and not the plan.
    """
    x = w.wiener(df.withColumn("_p", F.abs(F.col(pos))), c, 15, "_s")
    x = x.select(HOLE, IDX, "_p", *(w.slope_ends(F.col("_s"), n).alias(f"_g{n}") for n in ns))
    whole = Window.partitionBy(HOLE)
    entry = lambda n: F.max(F.when(F.col("_p") <= xstart, F.struct(F.round(f"_g{n}", 9).alias("v"), (-F.col("_p")).alias("p")))).over(whole)
    x = x.withColumns({f"_xa{n}": -entry(n).getField("p") for n in ns})
    cells = [(n, e, win) for n in ns for e in expected for win in wins]

    def exit_of(n: int, e: float, win: float) -> Column:
        from_, to = F.col(f"_xa{n}") + (e - win / 2), F.col(f"_xa{n}") + (e + win / 2)
        return _pick("max", -F.col(f"_g{n}"), F.col("_p"), F.col("_p").between(from_, to))

    g = x.groupBy(HOLE).agg(*(F.first(f"_xa{n}").alias(f"xa{n}") for n in ns), *(exit_of(*cell).alias(f"xb{i}") for i, cell in enumerate(cells)))
    rows = [
        F.struct(F.lit(n).alias("n"), F.lit(float(e)).alias("expected"), F.lit(float(win)).alias("win"), F.col(f"xa{n}").alias("xa"), F.col(f"xb{i}").alias("xb"))
        for i, (n, e, win) in enumerate(cells)
    ]
    return g.select(HOLE, F.inline(F.array(*rows))).withColumn("depth", F.col("xb") - F.col("xa"))


def sweep_summary(cells: DataFrame) -> DataFrame:
    """Holes with a depth, holes without one, mean and spread of the depth for each cell of a sweep."""
    return cells.groupBy("n", "expected", "win").agg(
        F.count("xb").alias("holes"), (F.count("*") - F.count("xb")).alias("missing"),
        F.avg("depth").alias("mean"), F.stddev_pop("depth").alias("sd"),
    )


def depths_by_choice(
    df: DataFrame, c: str, n: int = 20, xstart: float = 10.0, expected: float = 15.0, win: float = 8.0, share: float = 0.8, pos: str = "pos_mm"
) -> DataFrame:
    """``reference_depth`` by the largest, the first and the last strong slope side by side, in one pass over the slopes.

    Rows (hole, xa_max, depth_max, xa_first, depth_first, xa_last, depth_last).
    """
    x = w.wiener(df.withColumn("_p", F.abs(F.col(pos))), c, 15, "_s").withColumn("_g", w.slope_ends(F.col("_s"), n))
    x = w.tukey(x, "_g", "_g").select(HOLE, IDX, "_p", F.round("_g", 9).alias("_g"))
    whole, modes = Window.partitionBy(HOLE), ("max", "first", "last")
    g, p = F.col("_g"), F.col("_p")
    early = p <= xstart
    x = x.withColumn("_top", F.max(F.when(early, F.struct("_g", (-p).alias("p")))).over(whole))
    strong = early & (g >= F.round(share * F.col("_top._g"), 9))
    x = x.withColumns({"_xa_max": -F.col("_top.p"), "_xa_first": F.min(F.when(strong, p)).over(whole), "_xa_last": F.max(F.when(strong, p)).over(whole)})
    near = {m: p.between(F.col(f"_xa_{m}") + (expected - win / 2), F.col(f"_xa_{m}") + (expected + win / 2)) for m in modes}
    x = x.withColumns({f"_low_{m}": F.max(F.when(near[m], -g)).over(whole) for m in ("first", "last")})
    ends = [_pick("max", -g, p, near["max"]).alias("xb_max")]
    ends += [_pick(m, -g, p, near[m] & (-g >= F.round(share * F.col(f"_low_{m}"), 9))).alias(f"xb_{m}") for m in ("first", "last")]
    b = x.groupBy(HOLE).agg(*(F.first(f"_xa_{m}").alias(f"xa_{m}") for m in modes), *ends)
    return b.select(HOLE, *(col for m in modes for col in (F.col(f"xa_{m}"), (F.col(f"xb_{m}") - F.col(f"xa_{m}")).alias(f"depth_{m}"))))


def step_keypoints(df: DataFrame, c: str, smooth: int = 15, n: int = 15, pos: str = "pos_mm") -> DataFrame:
    """Positions of the extreme rolling mean gradient of each step: (hole, step, at_max, at_min)."""
    x = w.smooth_centred(df, c, smooth, "_s", "step")
    o = w.by_hole("step")
    x = x.withColumn("_d", F.col("_s") - F.lag("_s").over(o))
    x = x.withColumn("_g", F.round(w.rolling("mean", F.col("_d"), n, "step"), 9)).where("_g is not null")
    p = F.abs(F.col(pos))
    hi, lo = F.struct(F.col("_g").alias("g"), (-p).alias("p")), F.struct(F.col("_g").alias("g"), p.alias("p"))
    return x.groupBy(HOLE, "step").agg((-F.max(hi)["p"]).alias("at_max"), F.min(lo)["p"].alias("at_min"))


def stack_depths(keypoints: DataFrame) -> DataFrame:
    """Two-layer depth from steps 1 and 2; holes with fewer steps from step 0 alone."""
    g = keypoints.groupBy(HOLE).agg(
        F.max(F.when(F.col("step") == 0, F.col("at_max"))).alias("a0"), F.max(F.when(F.col("step") == 0, F.col("at_min"))).alias("b0"),
        F.max(F.when(F.col("step") == 1, F.col("at_max"))).alias("a1"), F.max(F.when(F.col("step") == 2, F.col("at_max"))).alias("a2"),
        F.max(F.when(F.col("step") == 2, F.col("at_min"))).alias("b2"), F.count("*").alias("steps"),
    )
    two = F.col("steps") >= 3
    points = F.when(two, F.array("a1", "a2", "b2")).otherwise(F.array("a0", "b0"))
    return g.select(HOLE, "steps", points.alias("keypoints"))


def entry_point(df: DataFrame, c: str, pos: str = "pos_mm", level: float = 0.1, least: float = 3.0) -> DataFrame:
    """First of three samples over a level beyond a position, walked back to the foot of the rise."""
    o = w.by_hole()
    t = F.col(c)
    over = (t > level) & (F.lead(t).over(o) > level) & (F.lead(t, 2).over(o) > level) & (F.abs(F.col(pos)) > least)
    foot = (t - F.lag(t, 3).over(o) < 0.0001) & (F.lead(t, 3).over(o) - t >= 0.05)
    x = df.withColumns({"_over": over, "_foot": foot})
    x = x.withColumn("_first", F.min(F.when(F.col("_over"), F.col(IDX))).over(Window.partitionBy(HOLE)))
    return x.groupBy(HOLE).agg(F.max(F.when(F.col("_foot") & (F.col(IDX) <= F.col("_first")), F.col(IDX))).alias("entry"))


def transition_point(df: DataFrame, c: str, step: int = 2, before: int = 300) -> DataFrame:
    """First smoothed gradient over mean + 2 std among the samples before a step begins."""
    begin = F.min(F.when(F.col("step") == step, F.col(IDX))).over(Window.partitionBy(HOLE))
    x = df.withColumn("_b", begin).where((F.col(IDX) < F.col("_b")) & (F.col(IDX) >= F.col("_b") - before))
    x = x.withColumn("_s", w.weighted_mean(c, w.savgol_quadratic_weights(11))).where("_s is not null")
    x = w.gradient(x, "_s", "_g").withColumn("_g", F.round("_g", 9))
    h = Window.partitionBy(HOLE)
    x = x.withColumn("_limit", F.round(F.avg("_g").over(h) + 2 * F.stddev_pop("_g").over(h), 7))
    return x.groupBy(HOLE).agg(F.min(F.when(F.col("_g") > F.col("_limit"), F.col(IDX))).alias("transition"))


def segment_depths(df: DataFrame, c: str, bit: float = 1.5, pos: str = "pos_mm") -> DataFrame:
    """Extreme rolling gradients of each feed segment: (hole, segment, entry, exit, depth); null unless exit lies deeper."""
    x = df.withColumn("_p", F.abs(F.col(pos)))
    x = w.segments(x, "_p").withColumn("_d", F.col(c) - F.lag(c).over(w.by_hole()))
    x = x.withColumn("_g", F.round(w.rolling("mean", F.col("_d"), max(2, round(bit / 0.05))), 9)).where("_g is not null")
    hi, lo = F.struct(F.col("_g").alias("g"), (-F.col("_p")).alias("p")), F.struct(F.col("_g").alias("g"), F.col("_p").alias("p"))
    g = x.groupBy(HOLE, "segment").agg((-F.max(hi)["p"]).alias("entry"), F.min(lo)["p"].alias("exit"))
    return g.withColumn("depth", F.when(F.col("exit") > F.col("entry"), F.col("exit") - F.col("entry")))


def distance_profile(df: DataFrame, c: str, template: list[float]) -> DataFrame:
    """z-normalised Euclidean distance of the template to the samples from each position on; rows (hole, idx, distance)."""
    m = len(template)
    mean = sum(template) / m
    sd = (sum((x - mean) ** 2 for x in template) / m) ** 0.5
    z = [(x - mean) / sd for x in template]
    f = w.by_hole().rowsBetween(0, m - 1)
    dot = F.aggregate(F.zip_with(F.collect_list(c).over(f), F.array(*map(F.lit, z)), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    x = df.select(HOLE, IDX, F.count(F.lit(1)).over(f).alias("_n"), dot.alias("_q"), F.stddev_pop(c).over(f).alias("_sd"))
    # the template has mean 0, so the samples' mean drops out of the product
    corr = F.when(F.col("_sd") > 1e-9, F.col("_q") / (m * F.col("_sd"))).otherwise(0.0)
    return x.where(F.col("_n") == m).select(HOLE, IDX, F.sqrt(F.greatest(F.lit(0.0), 2 * m * (1 - corr))).alias("distance"))


def best_match(profile: DataFrame, digits: int = 6) -> DataFrame:
    best = F.min(F.struct(F.round("distance", digits).alias("distance"), IDX))
    return profile.groupBy(HOLE).agg(best.alias("b")).select(HOLE, F.col("b.idx").alias("at"), F.col("b.distance").alias("distance"))


def match_quality(profile: DataFrame, valleys: int = 5) -> DataFrame:
    """z of the best valley against the next ones: (hole, best, z)."""
    v = w.peaks(profile.withColumn("_y", F.round(-F.col("distance"), 9)), "_y", None)
    k = F.row_number().over(Window.partitionBy(HOLE).orderBy(F.desc("_y"), IDX))
    v = v.withColumn("k", k).where(F.col("k") <= valleys + 1)
    rest = F.when(F.col("k") > 1, -F.col("_y"))
    g = v.groupBy(HOLE).agg(F.max(F.when(F.col("k") == 1, -F.col("_y"))).alias("best"), F.avg(rest).alias("m"), F.stddev_pop(rest).alias("s"))
    return g.select(HOLE, "best", F.when(F.col("s") > 0, (F.col("m") - F.col("best")) / F.col("s")).alias("z"))
