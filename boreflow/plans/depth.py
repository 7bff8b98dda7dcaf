"""Depth, template and history queries over the trace view."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators import aggregates as a
from boreflow.operators import depth as dp
from boreflow.operators import windows as w
from boreflow.plans.bindings import PROGRAM, TRACE, program, table, trace
from boreflow.queries import query

T = f"WITH {TRACE} "
WH = "PARTITION BY hole_id ORDER BY idx"

#: Smoothed, tapered slope of D01 in SQL.
SLOPE = f"""l AS (SELECT hole_id, idx, abs(pos_mm) AS p, torque_a AS x, sum(torque_a) OVER f / 15 AS m, sum(torque_a * torque_a) OVER f / 15 AS q
    FROM trace WINDOW f AS ({WH} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
v AS (SELECT *, q - m * m AS v, avg(q - m * m) OVER (PARTITION BY hole_id) AS noise FROM l),
s AS (SELECT hole_id, idx, p, m + CASE WHEN v < noise THEN 0 ELSE 1 - noise / v END * (x - m) AS s FROM v),
g0 AS (SELECT hole_id, idx, p, coalesce((s - lag(s, 19) OVER ({WH})) / 19, 0) AS g, 0.05 * (count(*) OVER (PARTITION BY hole_id) - 1) AS e,
    count(*) OVER (PARTITION BY hole_id) AS n FROM s),
g AS (SELECT hole_id, idx, p, round(g * CASE WHEN idx < e THEN (1 + cos(pi() * (idx / e - 1))) / 2 WHEN idx > n - 1 - e THEN (1 + cos(pi() * (idx / e - 19))) / 2 ELSE 1 END, 9) AS g FROM g0)"""

DEPTH = SLOPE + """, a AS (SELECT hole_id, arg_max(p, struct_pack(g := g, p := -p)) AS xa FROM g WHERE p <= 10 GROUP BY 1),
b AS (SELECT g.hole_id, xa, arg_max(p, struct_pack(g := -g, p := -p)) FILTER (p >= xa + 11 AND p <= xa + 19) AS xb FROM g JOIN a USING (hole_id) GROUP BY 1, 2)"""


def _depth(spark, d, **how):
    return dp.reference_depth(trace(spark, d), "torque_a", **how)


def _r(df, *cols, keys=("hole_id",)):
    return df.select(*keys, *(F.round(x, 3).alias(x) for x in cols))


@query(T + f", {DEPTH} SELECT hole_id, round(xa, 3) AS xa, round(xb, 3) AS xb, round(xb - xa, 3) AS depth FROM b")
def d01_reference_depth(spark, d):
    return _r(_depth(spark, d), "xa", "xb", "depth")


@query(T + f", {DEPTH} SELECT hole_id, round(xb - xa, 3) AS depth, CASE WHEN xb IS NULL THEN 'no exit peak' END AS error FROM b")
def d02_slim_depth(spark, d):
    x = _depth(spark, d)
    return x.select("hole_id", F.round("depth", 3).alias("depth"), F.when(F.col("xb").isNull(), "no exit peak").alias("error"))


@query(T + f", {DEPTH} SELECT hole_id, round(xa, 3) AS xa FROM a")
def d03_first_reference(spark, d):
    return _r(_depth(spark, d), "xa")


KEYPOINTS = f"""m AS (SELECT hole_id, idx, step, abs(pos_mm) AS p, CASE WHEN count(*) OVER f = 15 THEN avg(torque_a) OVER f END AS m FROM trace
    WINDOW f AS (PARTITION BY hole_id, step ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
s AS (SELECT hole_id, idx, step, p, coalesce(m, first_value(m IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(m IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS s FROM m WINDOW o AS (PARTITION BY hole_id, step ORDER BY idx)),
d AS (SELECT *, s - lag(s) OVER (PARTITION BY hole_id, step ORDER BY idx) AS d FROM s),
g AS (SELECT hole_id, step, p, round(CASE WHEN count(d) OVER f = 15 THEN avg(d) OVER f END, 9) AS g FROM d WINDOW f AS (PARTITION BY hole_id, step ORDER BY idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)),
k AS (SELECT hole_id, step, arg_max(p, struct_pack(g := g, p := -p)) AS at_max, arg_min(p, struct_pack(g := g, p := p)) AS at_min FROM g WHERE g IS NOT NULL GROUP BY 1, 2)"""


@query(T + f", {KEYPOINTS} SELECT hole_id, step, round(at_max, 3) AS at_max, round(at_min, 3) AS at_min FROM k")
def d04_step_keypoints(spark, d):
    return _r(dp.step_keypoints(trace(spark, d), "torque_a"), "at_max", "at_min", keys=("hole_id", "step"))


@query(T + f""", {KEYPOINTS}, h AS (SELECT hole_id, count(*) AS n, max(at_max) FILTER (step = 0) AS a0, max(at_min) FILTER (step = 0) AS b0, max(at_max) FILTER (step = 1) AS a1,
    max(at_max) FILTER (step = 2) AS a2, max(at_min) FILTER (step = 2) AS b2 FROM k GROUP BY 1)
SELECT hole_id, round(CASE WHEN n >= 3 THEN a2 - a1 ELSE b0 - a0 END, 3) AS first, round(CASE WHEN n >= 3 THEN b2 - a2 END, 3) AS second FROM h""")
def d05_stack_depths(spark, d):
    """Key points of two layers, or one, and their successive differences (D11)."""
    x = dp.stack_depths(dp.step_keypoints(trace(spark, d), "torque_a"))
    x = x.withColumn("d", c.depths_of(F.col("keypoints")))
    return x.select("hole_id", F.round(F.get("d", F.lit(0)), 3).alias("first"), F.round(F.get("d", F.lit(1)), 3).alias("second"))


@query(T + f""", x AS (SELECT hole_id, idx, abs(pos_mm) AS p, torque_a - lag(torque_a) OVER ({WH}) AS d FROM trace),
g AS (SELECT hole_id, p, round(CASE WHEN count(d) OVER f = 30 THEN avg(d) OVER f END, 9) AS g FROM x WINDOW f AS ({WH} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
k AS (SELECT hole_id, arg_max(p, struct_pack(g := g, p := -p)) AS a, arg_min(p, struct_pack(g := g, p := p)) AS b FROM g WHERE g IS NOT NULL GROUP BY 1)
SELECT hole_id, 0::BIGINT AS segment, round(a, 3) AS entry, round(b, 3) AS exit, round(CASE WHEN b > a THEN b - a END, 3) AS depth FROM k""")
def d06_segment_depths(spark, d):
    return _r(dp.segment_depths(trace(spark, d), "torque_a"), "entry", "exit", "depth", keys=("hole_id", "segment"))


@query(T + f""", f AS (SELECT hole_id, idx, torque_a > 2 AND lead(torque_a) OVER o > 2 AND lead(torque_a, 2) OVER o > 2 AND abs(pos_mm) > 3 AS over,
    torque_a - lag(torque_a, 3) OVER o < 0.0001 AND lead(torque_a, 3) OVER o - torque_a >= 0.05 AS foot FROM trace WINDOW o AS ({WH})),
m AS (SELECT *, min(idx) FILTER (over) OVER (PARTITION BY hole_id) AS first FROM f)
SELECT hole_id, max(idx) FILTER (foot AND idx <= first) AS entry FROM m GROUP BY 1""")
def d07_entry_point(spark, d):
    return dp.entry_point(trace(spark, d), "torque_a", level=2.0)


def _quad(n=11):
    h = n // 2
    return " + ".join(f"{x!r}::DOUBLE * {f'lag(torque_a, {h - i})' if i < h else f'lead(torque_a, {i - h})'} OVER o" for i, x in enumerate(w.savgol_quadratic_weights(n)))


@query(T + f""", b AS (SELECT *, min(idx) FILTER (step = 2) OVER (PARTITION BY hole_id) AS b FROM trace), x AS (SELECT * FROM b WHERE idx < b AND idx >= b - 300),
s AS (SELECT hole_id, idx, {_quad()} AS s FROM x WINDOW o AS ({WH})), k AS (SELECT * FROM s WHERE s IS NOT NULL),
g AS (SELECT hole_id, idx, round(CASE WHEN lag(s) OVER o IS NULL THEN lead(s) OVER o - s WHEN lead(s) OVER o IS NULL THEN s - lag(s) OVER o
    ELSE (lead(s) OVER o - lag(s) OVER o) / 2 END, 9) AS g FROM k WINDOW o AS ({WH})),
l AS (SELECT *, round(avg(g) OVER (PARTITION BY hole_id) + 2 * stddev_pop(g) OVER (PARTITION BY hole_id), 7) AS lim FROM g)
SELECT hole_id, min(idx) FILTER (g > lim) AS transition FROM l GROUP BY 1""")
def d08_transition_point(spark, d):
    return dp.transition_point(trace(spark, d), "torque_a")


@query(T + """, x AS (SELECT hole_id, CAST(idx // 64 AS BIGINT) AS win, idx % 64 AS x, CASE WHEN torque_a < 2.5 THEN 0 ELSE torque_a END AS v FROM trace),
b AS (SELECT hole_id, win, arg_max(x, struct_pack(v := v, x := -x)) AS x FROM x GROUP BY 1, 2) SELECT hole_id, round(avg(x), 4) AS exit FROM b GROUP BY 1""")
def d09_heat_map(spark, d):
    """Per window the position of the highest score over a threshold, averaged over the windows of a hole."""
    v = F.when(F.col("torque_a") < 2.5, 0.0).otherwise(F.col("torque_a"))
    x = trace(spark, d).select("hole_id", F.floor(F.col("idx") / 64).alias("win"), F.struct(v.alias("v"), (-(F.col("idx") % 64)).alias("x")).alias("s"))
    b = x.groupBy("hole_id", "win").agg((-F.max("s")["x"]).alias("x"))
    return b.groupBy("hole_id").agg(F.round(F.avg("x"), 4).alias("exit"))


@query(T + f", {DEPTH} SELECT b.hole_id, round(xa, 3) AS entry, round(15 + (xa + coalesce(xb, xa)) / 2 * 0.1, 6) AS middle, round(xb, 3) AS exit FROM b")
def d10_combined(spark, d):
    """Ends of one estimate, and a middle shifted by their mean delay."""
    x = _depth(spark, d)
    mid = 15 + (F.col("xa") + F.coalesce("xb", "xa")) / 2 * 0.1
    return x.select("hole_id", F.round("xa", 3).alias("entry"), F.round(mid, 6).alias("middle"), F.round("xb", 3).alias("exit"))


TEMPLATE = [0.5, 1.0, 2.0, 3.5, 4.0, 4.5, 4.0, 2.5]
_MEAN = sum(TEMPLATE) / 8
_SD = (sum((x - _MEAN) ** 2 for x in TEMPLATE) / 8) ** 0.5
_DOT = " + ".join(f"{(x - _MEAN) / _SD!r}::DOUBLE * lead(torque_a, {i}) OVER o" for i, x in enumerate(TEMPLATE))
PROFILE = f"""x AS (SELECT hole_id, idx, {_DOT} AS q, stddev_pop(torque_a) OVER f AS sd FROM trace WINDOW o AS ({WH}), f AS ({WH} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
pr AS (SELECT hole_id, idx, sqrt(greatest(0, 16 * (1 - CASE WHEN sd > 1e-9 THEN q / (8 * sd) ELSE 0 END))) AS distance FROM x WHERE q IS NOT NULL)"""


@query(T + f", {PROFILE}, b AS (SELECT hole_id, min(struct_pack(d := round(distance, 6), i := idx)) AS b FROM pr GROUP BY 1) SELECT hole_id, b.i AS at, b.d AS distance FROM b")
def d12_template_match(spark, d):
    return dp.best_match(dp.distance_profile(trace(spark, d), "torque_a", TEMPLATE))


@query(T + f""", {PROFILE}, y AS (SELECT hole_id, idx, round(-distance, 9) AS y FROM pr),
c AS (SELECT *, CASE WHEN y IS NOT DISTINCT FROM lag(y) OVER ({WH}) AND idx > 0 THEN 0 ELSE 1 END AS n FROM y), q AS (SELECT *, sum(n) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS run FROM c),
f AS (SELECT hole_id, run, min(idx) AS lo, max(idx) AS hi, any_value(y) AS y FROM q GROUP BY 1, 2), m AS (SELECT *, lag(y) OVER o AS a, lead(y) OVER o AS b FROM f WINDOW o AS (PARTITION BY hole_id ORDER BY run)),
v AS (SELECT hole_id, y, row_number() OVER (PARTITION BY hole_id ORDER BY y DESC, (lo + hi) // 2) AS k FROM m WHERE y > a AND y > b),
z AS (SELECT hole_id, max(CASE WHEN k = 1 THEN -y END) AS best, avg(CASE WHEN k > 1 THEN -y END) AS m, stddev_pop(CASE WHEN k > 1 THEN -y END) AS s FROM v WHERE k <= 6 GROUP BY 1)
SELECT hole_id, round(best, 5) AS best, round(CASE WHEN s > 0 THEN (m - best) / s END, 4) AS z,
    CASE WHEN 1 / round(CASE WHEN s > 0 THEN (m - best) / s END, 4) < 1.4 THEN 2 WHEN 1 / round(CASE WHEN s > 0 THEN (m - best) / s END, 4) < 1.75 THEN 1 ELSE 0 END AS rag FROM z""")
def d13_match_quality(spark, d):
    """z of the best valley against the next five, and its colour (F20)."""
    q = dp.match_quality(dp.distance_profile(trace(spark, d), "torque_a", TEMPLATE))
    z = F.round("z", 4)
    return q.select("hole_id", F.round("best", 5).alias("best"), z.alias("z"), c.rag(1 / z).alias("rag"))


@query(T + f""", {PROFILE}, b AS (SELECT hole_id, arg_min(idx, struct_pack(d := round(distance, 6), i := idx)) AS lo FROM pr GROUP BY 1)
SELECT trace.hole_id, idx, CASE WHEN idx >= lo AND idx < lo + 8 THEN NULL ELSE torque_a END AS torque_a FROM trace JOIN b ON b.hole_id = trace.hole_id""")
def d14_cleanup(spark, d):
    t = trace(spark, d)
    at = dp.best_match(dp.distance_profile(t, "torque_a", TEMPLATE)).select("hole_id", "at")
    inside = F.col("idx").between(F.col("at"), F.col("at") + len(TEMPLATE) - 1)
    return t.join(at, "hole_id").select("hole_id", "idx", F.when(~inside, F.col("torque_a")).alias("torque_a"))


@query(T + f", {DEPTH} SELECT hole_id, round(xb - xa, 3) AS total, round((xb - xa) / 2, 3) AS layer, greatest(xa / 10, coalesce((xb - 10) / 20, 0)) < 0.9 AS good FROM b")
def d15_stack_quality(spark, d):
    """Total and layer depth with the worse quality of both ends."""
    x = _depth(spark, d)
    worse = F.greatest(F.col("xa") / 10, F.coalesce((F.col("xb") - 10) / 20, F.lit(0.0)))
    return x.select("hole_id", F.round("depth", 3).alias("total"), F.round(F.col("depth") / 2, 3).alias("layer"), (worse < 0.9).alias("good"))


@query(T + f""", {PROFILE}, b AS (SELECT hole_id, min(struct_pack(d := round(distance, 6), i := idx)) AS b FROM pr GROUP BY 1)
SELECT hole_id, string_agg(torque_a::VARCHAR, ',' ORDER BY idx) AS segment FROM trace JOIN b USING (hole_id) WHERE idx BETWEEN b.b.i AND b.b.i + 7 GROUP BY 1""")
def d16_extract_segments(spark, d):
    t = trace(spark, d)
    at = dp.best_match(dp.distance_profile(t, "torque_a", TEMPLATE)).select("hole_id", F.explode(F.sequence(F.col("at"), F.col("at") + 7)).alias("idx"))
    g = at.join(t, ["hole_id", "idx"]).groupBy("hole_id").agg(F.sort_array(F.collect_list(F.struct("idx", "torque_a"))).alias("x"))
    return g.select("hole_id", F.array_join(F.transform("x", lambda s: s["torque_a"].cast("string")), ",").alias("segment"))


@query(T + f""", {DEPTH} SELECT s_nationkey AS head, hole_id, round(sum(xb - xa) OVER (PARTITION BY s_nationkey ORDER BY hole_id ROWS UNBOUNDED PRECEDING), 3) AS total FROM b JOIN supplier ON s_suppkey = hole_id""")
def d17_depth_per_head(spark, d):
    x = _depth(spark, d).join(table(spark, d, "supplier"), F.col("hole_id") == F.col("s_suppkey"))
    run = Window.partitionBy("s_nationkey").orderBy("hole_id").rowsBetween(Window.unboundedPreceding, 0)
    return x.select(F.col("s_nationkey").alias("head"), "hole_id", F.round(F.sum("depth").over(run), 3).alias("total"))


@query(f"""WITH {TRACE}, {PROGRAM}, p AS (SELECT hole_id, step, max(abs(pos_mm)) AS last FROM trace GROUP BY 1, 2)
SELECT hole_id, p.step, round(last, 3) AS last, stroke, CASE WHEN abs(stroke - last) <= 5 THEN 'DEP' ELSE 'Signal' END AS change FROM p JOIN program ON program_id = hole_id AND program.step = p.step""")
def d18_change_types(spark, d):
    p = trace(spark, d).groupBy("hole_id", "step").agg(F.abs(a.last_by("pos_mm")).alias("last"))
    x = p.join(program(spark, d).withColumnRenamed("program_id", "hole_id"), ["hole_id", "step"])
    kind = F.when(F.abs(F.col("stroke") - F.col("last")) <= 5, "DEP").otherwise("Signal")
    return x.select("hole_id", "step", F.round("last", 3).alias("last"), "stroke", kind.alias("change"))


def _cell(n, win, expected=15):
    lo, hi = expected - win / 2, expected + win / 2
    return f"""SELECT {n} AS n, {win}::DOUBLE AS win, {expected}::DOUBLE AS expected, hole_id, xa, arg_max(p, struct_pack(g := -g, p := -p)) FILTER (p >= xa + {lo} AND p <= xa + {hi}) AS xb FROM
    (SELECT hole_id, p, round((s - lag(s, {n - 1}) OVER ({WH})) / {n - 1}, 9) AS g0, coalesce(round((s - lag(s, {n - 1}) OVER ({WH})) / {n - 1}, 9), 0) AS g FROM s) JOIN
    (SELECT hole_id, arg_max(p, struct_pack(g := g, p := -p)) AS xa FROM (SELECT hole_id, p, coalesce(round((s - lag(s, {n - 1}) OVER ({WH})) / {n - 1}, 9), 0) AS g FROM s) WHERE p <= 10 GROUP BY 1) USING (hole_id) GROUP BY hole_id, xa"""


GRID = [(n, win) for n in (10, 20) for win in (4.0, 8.0)]


@query(T + ", " + SLOPE.split(",\ng0 AS")[0] + ", c AS (" + " UNION ALL ".join(_cell(n, x) for n, x in GRID) + """)
SELECT n, win, count(xb) AS holes, count(*) - count(xb) AS missing, round(avg(xb - xa), 6) AS mean, round(stddev_pop(xb - xa), 6) AS sd FROM c GROUP BY 1, 2""")
def d19_parameter_sweep(spark, d):
    """Depth over a grid of window sizes, with mean and spread of each cell."""
    cells = dp.depth_sweep(trace(spark, d), "torque_a", [10, 20], [15.0], [4.0, 8.0])
    return dp.sweep_summary(cells).select("n", "win", "holes", "missing", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


SWEPT = [(n, win, e) for n in (10, 20, 40) for e in (12.0, 15.0, 40.0) for win in (4.0, 8.0)]


@query(T + ", " + SLOPE.split(",\ng0 AS")[0] + ", c AS (" + " UNION ALL ".join(_cell(*x) for x in SWEPT) + """)
SELECT n, expected, win, count(xb) AS holes, count(*) - count(xb) AS missing, round(avg(xb - xa), 6) AS mean, round(stddev_pop(xb - xa), 6) AS sd FROM c GROUP BY 1, 2, 3""")
def d19_depth_sweep(spark, d):
    """Depth over a grid of slope lengths, expected depths and windows; holes without an exit peak are counted by cell."""
    cells = dp.depth_sweep(trace(spark, d), "torque_a", [10, 20, 40], [12.0, 15.0, 40.0], [4.0, 8.0])
    return dp.sweep_summary(cells).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query(T + """SELECT s_nationkey AS head, hole_id, max(torque_a) AS torque, max(thrust_a) AS thrust, max(torque_empty_a) AS empty, round(arg_max(abs(pos_mm), struct_pack(t := torque_a, i := -idx)), 3) AS at
FROM trace JOIN supplier ON s_suppkey = hole_id GROUP BY 1, 2""")
def d20_tool_life(spark, d):
    t = trace(spark, d)
    at = F.max(F.struct("torque_a", (-F.col("idx")).alias("i"), F.abs("pos_mm").alias("p")))["p"]
    g = t.groupBy("hole_id").agg(F.max("torque_a").alias("torque"), F.max("thrust_a").alias("thrust"), F.max("torque_empty_a").alias("empty"), F.round(at, 3).alias("at"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hole_id"), F.col("s_nationkey").alias("head"))
    return g.join(s, "hole_id")


@query(T + """, f AS (SELECT hole_id, min(torque_a) AS low, max(torque_a) AS high, round(avg(torque_a), 4) AS mean FROM trace GROUP BY 1)
SELECT f.*, dense_rank() OVER (ORDER BY s_nationkey) - 1 AS label, CASE WHEN hole_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM f JOIN supplier ON s_suppkey = hole_id""")
def d21_training_set(spark, d):
    """Features, a label number for each nation, and a fixed split."""
    f = trace(spark, d).groupBy("hole_id").agg(F.min("torque_a").alias("low"), F.max("torque_a").alias("high"), F.round(F.avg("torque_a"), 4).alias("mean"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hole_id"), "s_nationkey")
    x = f.join(s, "hole_id")
    kinds = x.select("s_nationkey").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("s_nationkey")) - 1).cast("bigint"))
    part = F.when(F.col("hole_id") % 5 == 0, "test").otherwise("train")
    return x.join(kinds, "s_nationkey").select("hole_id", "low", "high", "mean", "label", part.alias("part"))


@query(T + """SELECT hole_id, hole_id % 10 AS x, hole_id // 10 % 10 AS y, round(sum(torque_a * torque_a), 3) AS energy, max(torque_a) AS high,
    least(hole_id % 10, 10 - hole_id % 10, hole_id // 10 % 10, 10 - hole_id // 10 % 10) AS edge FROM trace GROUP BY 1""")
def d22_hole_table(spark, d):
    g = trace(spark, d).groupBy("hole_id").agg(F.round(F.sum(F.col("torque_a") * F.col("torque_a")), 3).alias("energy"), F.max("torque_a").alias("high"))
    x, y = F.col("hole_id") % 10, F.floor(F.col("hole_id") / 10) % 10
    return g.select("hole_id", x.alias("x"), y.alias("y"), "energy", "high", c.edge_distance(x, y, F.lit(10), F.lit(10)).alias("edge"))


@query(T + """SELECT hole_id, idx AS breakpoint FROM (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY idx DESC) AS k FROM trace WHERE torque_a > 4.9) WHERE k > 2""")
def d23_breakpoints(spark, d):
    """Breakpoints of all holes without the last two of each."""
    k = F.row_number().over(Window.partitionBy("hole_id").orderBy(F.desc("idx")))
    return trace(spark, d).where("torque_a > 4.9").withColumn("k", k).where("k > 2").select("hole_id", F.col("idx").alias("breakpoint"))


_CHOSEN = ", ".join(
    f"""t_{m} AS (SELECT hole_id, max(g) AS top FROM g WHERE p <= 10 GROUP BY 1), a_{m} AS (SELECT hole_id, {f}(p) AS xa FROM g JOIN t_{m} USING (hole_id) WHERE p <= 10 AND g >= round(0.8 * top, 9) GROUP BY 1),
u_{m} AS (SELECT hole_id, max(-g) AS top FROM g JOIN a_{m} USING (hole_id) WHERE p >= xa + 11 AND p <= xa + 19 GROUP BY 1),
b_{m} AS (SELECT hole_id, any_value(xa) AS xa, {f}(p) FILTER (p >= xa + 11 AND p <= xa + 19 AND -g >= round(0.8 * top, 9)) AS xb FROM g JOIN a_{m} USING (hole_id) LEFT JOIN u_{m} USING (hole_id) GROUP BY 1)"""
    for m, f in (("first", "min"), ("last", "max"))
)


@query(T + f""", {DEPTH}, {_CHOSEN} SELECT b.hole_id, {", ".join(f"round({t}.xa, 3) AS xa_{m}, round({t}.xb - {t}.xa, 3) AS depth_{m}" for m, t in (("max", "b"), ("first", "b_first"), ("last", "b_last")))}
FROM b JOIN b_first ON b_first.hole_id = b.hole_id JOIN b_last ON b_last.hole_id = b.hole_id""")
def d25_depth_by_choice(spark, d):
    """Entry by the largest, the first and the last strong slope, side by side."""
    x = dp.depths_by_choice(trace(spark, d), "torque_a")
    return x.select("hole_id", *(F.round(c, 3).alias(c) for c in x.columns if c != "hole_id"))
