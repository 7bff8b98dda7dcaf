"""Window queries over the trace view."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boreflow.operators import windows as w
from boreflow.plans.bindings import TRACE, table, trace
from boreflow.queries import query

T = f"WITH {TRACE} "
KEY = ["hole_id", "idx"]
WH = "PARTITION BY hole_id ORDER BY idx"


def out(df, *cols, digits=6):
    return df.select(*KEY, *(F.round(c, digits).alias(n) for n, c in cols))


@query(T + f"""SELECT hole_id, idx, round(CASE WHEN count(*) OVER f = 30 THEN regr_slope(torque_a, idx) OVER f ELSE 0 END, 6) AS slope
FROM trace WINDOW f AS ({WH} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def w01_rolling_slope(spark, d):
    return out(trace(spark, d), ("slope", w.slope_ols(F.col("torque_a"), 30)))


@query(T + f"SELECT hole_id, idx, round(coalesce((torque_a - lag(torque_a, 29) OVER ({WH})) / 29, 0), 6) AS slope FROM trace")
def w02_slope_ends(spark, d):
    return out(trace(spark, d), ("slope", w.slope_ends(F.col("torque_a"), 30)))


@query(T + f"""SELECT hole_id, idx, round(CASE WHEN count(*) OVER f = 20 THEN regr_slope(torque_a, idx) OVER f ELSE 0 END
    + CASE WHEN count(*) OVER g = 20 THEN regr_slope(torque_a, idx) OVER g ELSE 0 END, 6) AS slope
FROM trace WINDOW f AS ({WH} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), g AS ({WH} ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)""")
def w03_slope_both(spark, d):
    return out(trace(spark, d), ("slope", w.slope_both(F.col("torque_a"), 20)))


@query(T + f""", s AS (SELECT hole_id, idx, (torque_a - lag(torque_a, 29) OVER ({WH})) / 29 AS g FROM trace),
z AS (SELECT hole_id, idx, coalesce(g, 0) AS g FROM s), t AS (SELECT *, coalesce((g + lag(g) OVER ({WH})) / 2, 0) AS a FROM z),
r AS (SELECT *, sum(a) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS i FROM t)
SELECT hole_id, idx, round(i - min(i) OVER (PARTITION BY hole_id), 4) AS integrated FROM r""")
def w04_integrated_slope(spark, d):
    s = trace(spark, d).withColumn("g", w.slope_ends(F.col("torque_a"), 30))
    s = w.integrate(s.withColumn("x", F.col("idx").cast("double")), "g", "x", "i")
    return out(s, ("integrated", F.col("i") - F.min("i").over(w.whole())), digits=4)


@query(T + f""", g AS (SELECT hole_id, idx, torque_a - lag(torque_a) OVER ({WH}) AS g FROM trace)
SELECT hole_id, idx, round(CASE WHEN count(g) OVER f = 15 THEN avg(g) OVER f END, 6) AS mean,
    round(CASE WHEN count(g) OVER f = 15 THEN max(g) OVER f END, 6) AS high,
    round(CASE WHEN count(g) OVER f = 15 THEN min(g) OVER f END, 6) AS low
FROM g WINDOW f AS ({WH} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def w05_rolling_gradient(spark, d):
    g = trace(spark, d).withColumn("g", F.col("torque_a") - F.lag("torque_a").over(w.by_hole()))
    return out(g, *((n, w.rolling(k, F.col("g"), 15)) for n, k in (("mean", "mean"), ("high", "max"), ("low", "min"))))


@query(T + f"""SELECT hole_id, idx, round(CASE WHEN count(*) OVER f = 15 THEN median(torque_a) OVER f END, 6) AS median
FROM trace WINDOW f AS ({WH} ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""")
def w06_rolling_median(spark, d):
    return out(trace(spark, d), ("median", w.rolling("median", F.col("torque_a"), 15)))


@query(T + f""", m AS (SELECT hole_id, idx, CASE WHEN count(*) OVER f = 15 THEN avg(torque_a) OVER f END AS m
    FROM trace WINDOW f AS ({WH} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
SELECT hole_id, idx, round(coalesce(m, first_value(m IGNORE NULLS) OVER ({WH} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    last_value(m IGNORE NULLS) OVER ({WH} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS smooth FROM m""")
def w07_centred_smoothing(spark, d):
    return out(w.smooth_centred(trace(spark, d), "torque_a", 15, "m"), ("smooth", F.col("m")))


@query(T + f"""SELECT hole_id, idx, round(CASE WHEN count(*) OVER f = 10 THEN sqrt(avg(torque_a * torque_a) OVER f) END, 6) AS rms
FROM trace WINDOW f AS ({WH} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w08_rms(spark, d):
    return out(trace(spark, d), ("rms", w.rolling("rms", F.col("torque_a"), 10)))


@query(T + f"""SELECT hole_id, idx, round(CASE WHEN count(*) OVER f = 10 THEN var_samp(torque_a) OVER f END, 6) AS variance
FROM trace WINDOW f AS ({WH} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w09_rolling_variance(spark, d):
    return out(trace(spark, d), ("variance", w.rolling("var", F.col("torque_a"), 10)))


@query(T + """SELECT hole_id, idx, round(max(torque_a) OVER f, 6) AS high, count(*) OVER f AS n FROM trace
WINDOW f AS (PARTITION BY hole_id ORDER BY idx RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING)""")
def w10_position_window(spark, d):
    """Samples within half a millimetre either side; positions are in steps of 0.05 mm."""
    grid = F.round(F.abs("pos_mm") / 0.05).cast("bigint")
    f = Window.partitionBy("hole_id").orderBy("grid").rangeBetween(-10, 10)
    t = trace(spark, d).withColumn("grid", grid)
    return t.select(*KEY, F.round(F.max("torque_a").over(f), 6).alias("high"), F.count("*").over(f).alias("n"))


@query(T + f""", l AS (SELECT hole_id, idx, torque_a AS x, sum(torque_a) OVER f / 15 AS m, sum(torque_a * torque_a) OVER f / 15 AS q
    FROM trace WINDOW f AS ({WH} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
v AS (SELECT *, q - m * m AS v, avg(q - m * m) OVER (PARTITION BY hole_id) AS noise FROM l)
SELECT hole_id, idx, round(m + CASE WHEN v < noise THEN 0 ELSE 1 - noise / v END * (x - m), 4) AS smooth FROM v""")
def w11_wiener(spark, d):
    return out(w.wiener(trace(spark, d), "torque_a", 15, "s"), ("smooth", F.col("s")), digits=4)


def _dot(weights, c="torque_a"):
    h = len(weights) // 2
    terms = [f"{x!r}::DOUBLE * {f'lag({c}, {h - i})' if i < h else f'lead({c}, {i - h})'} OVER o" for i, x in enumerate(weights)]
    return " + ".join(terms)


@query(T + f"SELECT hole_id, idx, round({_dot(w.savgol_linear_weights(9))}, 6) AS smooth FROM trace WINDOW o AS ({WH})")
def w12_weighted_fit(spark, d):
    return out(trace(spark, d), ("smooth", w.weighted_mean("torque_a", w.savgol_linear_weights(9))))


@query(T + f""", s AS (SELECT hole_id, idx, {_dot(w.savgol_quadratic_weights(11))} AS s FROM trace WINDOW o AS ({WH})),
k AS (SELECT * FROM s WHERE s IS NOT NULL)
SELECT hole_id, idx, round(CASE WHEN lag(s) OVER o IS NULL THEN lead(s) OVER o - s WHEN lead(s) OVER o IS NULL THEN s - lag(s) OVER o
    ELSE (lead(s) OVER o - lag(s) OVER o) / 2 END, 6) AS gradient FROM k WINDOW o AS ({WH})""")
def w13_savgol_gradient(spark, d):
    s = trace(spark, d).withColumn("s", w.weighted_mean("torque_a", w.savgol_quadratic_weights(11)))
    return out(w.gradient(s.where("s is not null"), "s", "g"), ("gradient", F.col("g")))


@query(T + """, n AS (SELECT *, 0.05 * (count(*) OVER (PARTITION BY hole_id) - 1) AS e, count(*) OVER (PARTITION BY hole_id) AS n FROM trace)
SELECT hole_id, idx, round(torque_a * CASE WHEN idx < e THEN (1 + cos(pi() * (idx / e - 1))) / 2
    WHEN idx > n - 1 - e THEN (1 + cos(pi() * (idx / e - 19))) / 2 ELSE 1 END, 5) AS tapered FROM n""")
def w14_tukey(spark, d):
    return out(w.tukey(trace(spark, d), "torque_a", "t"), ("tapered", F.col("t")), digits=5)


@query(T + f""", a AS (SELECT hole_id, idx, torque_a - lag(torque_a) OVER ({WH}) AS d1, pos_mm - lag(pos_mm) OVER ({WH}) AS dp FROM trace)
SELECT hole_id, idx, round(d1, 6) AS d1, round(d1 - lag(d1) OVER ({WH}), 6) AS d2, round(d1 / dp, 4) AS per_mm FROM a""")
def w15_differences(spark, d):
    o = w.by_hole()
    a = trace(spark, d).withColumns({"d": F.col("torque_a") - F.lag("torque_a").over(o), "dp": F.col("pos_mm") - F.lag("pos_mm").over(o)})
    return a.select(
        *KEY, F.round("d", 6).alias("d1"), F.round(F.col("d") - F.lag("d").over(o), 6).alias("d2"), F.round(F.col("d") / F.col("dp"), 4).alias("per_mm")
    )


@query(T + f""", b AS (SELECT hole_id, idx, CASE WHEN torque_a - lag(torque_a) OVER ({WH}) < 0 THEN 1 ELSE 0 END AS b FROM trace)
SELECT hole_id, idx, CAST(sum(b) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM b""")
def w16_segments(spark, d):
    return w.segments(trace(spark, d), "torque_a").select(*KEY, "segment")


@query(T + f""", a AS (SELECT hole_id, step, idx, abs(pos_mm) * (1 + hole_id % 3) - lag(abs(pos_mm) * (1 + hole_id % 3)) OVER ({WH}) AS dp FROM trace)
SELECT hole_id, step, round(median(dp), 6) AS feed, CAST(round(1.5 / median(dp)) AS BIGINT) AS samples FROM a GROUP BY ALL""")
def w17_feed_window(spark, d):
    """Median feed of each step and the number of samples that 1.5 mm take."""
    p = F.abs("pos_mm") * (1 + F.col("hole_id") % 3)
    a = trace(spark, d).withColumn("p", p).withColumn("dp", F.col("p") - F.lag("p").over(w.by_hole()))
    g = a.groupBy("hole_id", "step").agg(F.percentile("dp", F.lit(0.5)).alias("f"))
    return g.select("hole_id", "step", F.round("f", 6).alias("feed"), F.round(1.5 / F.col("f")).cast("bigint").alias("samples"))


@query(T + f""", c AS (SELECT hole_id, idx, torque_a AS y, CASE WHEN torque_a IS NOT DISTINCT FROM lag(torque_a) OVER ({WH}) AND idx > 0 THEN 0 ELSE 1 END AS n FROM trace),
r AS (SELECT *, sum(n) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS run FROM c),
f AS (SELECT hole_id, run, min(idx) AS lo, max(idx) AS hi, any_value(y) AS y FROM r GROUP BY 1, 2),
m AS (SELECT *, lag(y) OVER o AS a, lead(y) OVER o AS b, max(y) OVER (PARTITION BY hole_id) AS top FROM f WINDOW o AS (PARTITION BY hole_id ORDER BY run))
SELECT hole_id, CAST((lo + hi) // 2 AS BIGINT) AS idx, y AS torque_a FROM m WHERE y > a AND y > b AND y >= 0.9 * top""")
def w18_peaks(spark, d):
    return w.peaks(trace(spark, d), "torque_a", 0.9)


@query(T + f""", c AS (SELECT hole_id, idx, torque_a, sum(CASE WHEN torque_a < 0.4 THEN 1 ELSE 0 END) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS g FROM trace),
k AS (SELECT hole_id, CAST(g AS BIGINT) AS cycle, count(*) AS n, max(torque_a) AS high FROM c WHERE torque_a >= 0.4 GROUP BY 1, 2)
SELECT hole_id, cycle, n, round(high, 6) AS high FROM (SELECT *, max(high) OVER (PARTITION BY hole_id) AS top FROM k) WHERE n > 5 AND high > 0.3 * top""")
def w19_power_cycles(spark, d):
    """Cycles between samples of hardly any torque, without the short and the weak ones."""
    gap = (F.col("torque_a") < 0.4).cast("int")
    run = w.by_hole().rowsBetween(Window.unboundedPreceding, 0)
    c = trace(spark, d).withColumn("cycle", F.sum(gap).over(run)).where("torque_a >= 0.4")
    k = c.groupBy("hole_id", "cycle").agg(F.count("*").alias("n"), F.max("torque_a").alias("high"))
    k = k.withColumn("top", F.max("high").over(Window.partitionBy("hole_id"))).where("n > 5 and high > 0.3 * top")
    return k.select("hole_id", "cycle", "n", F.round("high", 6).alias("high"))


@query("""SELECT o_custkey AS head, o_orderkey AS hole, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS UNBOUNDED PRECEDING), 2) AS total, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS nth FROM orders""")
def w20_cumulative_depth(spark, d):
    """Running depth of each head in hole order, and the rank of the day (W21)."""
    o = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    run = F.sum("o_totalprice").over(o.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).cast("bigint")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("head"), F.col("o_orderkey").alias("hole"), F.round(run, 2).alias("total"), nth.alias("nth")
    )


@query("SELECT DISTINCT o_custkey AS head, o_orderdate AS day, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS nth FROM orders")
def w21_dense_rank(spark, d):
    nth = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).cast("bigint")
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("head"), F.col("o_orderdate").alias("day"), nth.alias("nth")).distinct()


_LAGS = ", ".join(f"coalesce(lag(p{p}, {k}) OVER o, 0) AS torque{3 * k + p + 1}" for k in range(5) for p in range(3))


@query(T + f""", r AS (SELECT hole_id, torque_a, row_number() OVER ({WH}) - 1 AS r FROM trace WHERE step = 2),
x AS (SELECT hole_id, r // 3 AS "row", max(CASE WHEN r % 3 = 0 THEN torque_a END) AS p0, max(CASE WHEN r % 3 = 1 THEN torque_a END) AS p1,
    max(CASE WHEN r % 3 = 2 THEN torque_a END) AS p2 FROM r GROUP BY 1, 2)
SELECT hole_id, "row", {_LAGS} FROM x WHERE p2 IS NOT NULL WINDOW o AS (PARTITION BY hole_id ORDER BY "row")""")
def w22_lagged_features(spark, d):
    return w.lagged_features(trace(spark, d), "torque_a")


@query(T + f""", e AS (SELECT hole_id, step, max(idx) AS e FROM trace GROUP BY 1, 2),
m AS (SELECT t.hole_id, t.idx, t.torque_a, min(e.e) AS e FROM trace t LEFT JOIN e ON t.hole_id = e.hole_id AND t.idx BETWEEN e.e - 10 AND e.e + 10 GROUP BY ALL),
b AS (SELECT m.*, a.torque_a AS y0, z.torque_a AS y1 FROM m LEFT JOIN trace a ON a.hole_id = m.hole_id AND a.idx = m.e - 10
    LEFT JOIN trace z ON z.hole_id = m.hole_id AND z.idx = m.e + 10)
SELECT hole_id, idx, round(CASE WHEN y0 IS NULL OR y1 IS NULL THEN torque_a ELSE y0 + (y1 - y0) * (idx - e + 10) / 20 END, 6) AS masked FROM b""")
def w23_step_change_mask(spark, d):
    """Torque within half a millimetre of a step's end is replaced by the line that joins both sides."""
    t = trace(spark, d)
    o = w.by_hole()
    last = F.lead("step").over(o)
    end = F.when(last.isNull() | (last != F.col("step")), F.col("idx"))
    near = w.by_hole().rowsBetween(-10, 10)
    t = t.withColumn("end", end).withColumn("e", F.min("end").over(near))
    t = t.withColumn("off", F.col("idx") - F.col("e"))
    low, high = F.expr("collect_list(torque_a) over (partition by hole_id order by idx rows between 20 preceding and current row)"), F.expr(
        "collect_list(torque_a) over (partition by hole_id order by idx rows between current row and 20 following)"
    )
    t = t.withColumns({"back": low, "ahead": high})
    y0 = F.when(F.size("back") > F.col("off") + 10, F.get(F.reverse("back"), (F.col("off") + 10).cast("int")))
    y1 = F.get("ahead", (10 - F.col("off")).cast("int"))
    line = y0 + (y1 - y0) * (F.col("off") + 10) / 20
    return out(t, ("masked", F.when(F.col("e").isNull() | y0.isNull() | y1.isNull(), F.col("torque_a")).otherwise(line)))


@query(T + f""", b AS (SELECT hole_id, idx, row_number() OVER ({WH}) - 1 AS r FROM trace WHERE torque_a > 4.9),
p AS (SELECT hole_id, r // 2 AS pair, min(idx) AS a, max(idx) AS b FROM b GROUP BY 1, 2)
SELECT hole_id, CASE WHEN b - a < 4 THEN (a + b) / 2 ELSE v END AS breakpoint FROM (SELECT hole_id, a, b, unnest(CASE WHEN b - a < 4 THEN [a] ELSE [a, b] END) AS v FROM p)""")
def w24_merge_breakpoints(spark, d):
    """Neighbouring pairs of breakpoints closer than 4 samples become their mean."""
    b = trace(spark, d).where("torque_a > 4.9").withColumn("r", F.row_number().over(w.by_hole()) - 1)
    p = b.groupBy("hole_id", F.floor(F.col("r") / 2).alias("pair")).agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    mean = F.array((F.col("a") + F.col("b")) / 2)
    both = F.array(F.col("a").cast("double"), F.col("b").cast("double"))
    return p.select("hole_id", F.explode(F.when(F.col("b") - F.col("a") < 4, mean).otherwise(both)).alias("breakpoint"))


@query(T + f""", g AS (SELECT *, coalesce((torque_a - lag(torque_a, 9) OVER ({WH})) / 9, 0) AS g FROM trace),
c AS (SELECT hole_id, step, min(idx) AS c FROM trace WHERE step > 0 GROUP BY 1, 2),
m AS (SELECT c.hole_id, c.step, arg_max(g.idx, struct_pack(a := round(g.g, 9), b := -g.idx)) AS i, any_value(c.c) AS c
    FROM c JOIN g ON g.hole_id = c.hole_id AND g.idx BETWEEN c.c - 20 AND c.c + 20 GROUP BY 1, 2)
SELECT hole_id, step, round(abs(i - c) * 0.05::DOUBLE, 4) AS distance FROM m""")
def w25_peak_correction(spark, d):
    """Distance from each step change to the steepest rise within a millimetre."""
    g = trace(spark, d).withColumn("g", w.slope_ends(F.col("torque_a"), 10))
    c = g.where("step > 0").groupBy("hole_id", "step").agg(F.min("idx").alias("c"))
    # equi-join on the neighbourhood's samples, not a range join
    near = c.withColumn("idx", F.explode(F.sequence(F.col("c") - 20, F.col("c") + 20)))
    m = near.join(g.select("hole_id", "idx", "g"), ["hole_id", "idx"]).groupBy("hole_id", "step", "c")
    m = m.agg(F.max(F.struct(F.round("g", 9).alias("g"), (-F.col("idx")).alias("i"))).alias("m"))
    return m.select("hole_id", "step", F.round(F.abs(-F.col("m.i") - F.col("c")) * 0.05, 4).alias("distance"))


@query(T + """, n AS (SELECT hole_id, count(*) AS n FROM trace GROUP BY 1), k AS (SELECT unnest(range(40)) AS k)
SELECT hole_id, idx + 40 AS idx, torque_a FROM trace UNION ALL SELECT hole_id, k, -1 FROM n, k UNION ALL SELECT hole_id, k + 40 + n, -1 FROM n, k""")
def w26_padding(spark, d):
    return w.reindexed_padding(trace(spark, d), ["torque_a"], 40)


@query(T + """, p AS (SELECT hole_id, arg_max(idx, struct_pack(a := torque_a, b := -idx)) AS p FROM trace GROUP BY 1),
s AS (SELECT hole_id, p - 100 + j * 5 AS s, j FROM p, (SELECT unnest(range(40)) AS j))
SELECT s.hole_id, s.j AS window_nr, count(*) AS n, round(sum(torque_a), 4) AS total FROM s JOIN trace t ON t.hole_id = s.hole_id
    AND t.idx BETWEEN s.s AND s.s + 63 GROUP BY 1, 2""")
def w27_sliding_extracts(spark, d):
    """40 windows of 64 samples about the highest torque, each 5 samples on."""
    t = trace(spark, d)
    p = t.groupBy("hole_id").agg((-F.max(F.struct("torque_a", (-F.col("idx")).alias("i")))["i"]).alias("p"))
    s = p.select("hole_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j"), "p")
    s = s.select("hole_id", F.col("j").cast("bigint").alias("window_nr"), F.explode(F.sequence(F.col("p") - 100 + F.col("j") * 5, F.col("p") - 37 + F.col("j") * 5)).alias("idx"))
    g = s.join(t, ["hole_id", "idx"]).groupBy("hole_id", "window_nr")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("torque_a"), 4).alias("total"))


@query(T + """SELECT hole_id, idx, round((torque_a - min(torque_a) OVER h) / (max(torque_a) OVER h - min(torque_a) OVER h), 6) AS scaled,
    round((torque_a - avg(torque_a) OVER h) / stddev_pop(torque_a) OVER h, 4) AS z FROM trace WINDOW h AS (PARTITION BY hole_id)""")
def w28_scaling(spark, d):
    h, x = w.whole(), F.col("torque_a")
    span = F.max(x).over(h) - F.min(x).over(h)
    return trace(spark, d).select(
        *KEY, F.round((x - F.min(x).over(h)) / span, 6).alias("scaled"), F.round((x - F.avg(x).over(h)) / F.stddev_pop(x).over(h), 4).alias("z")
    )
