"""Aggregate, sort, top-k and set queries over the trace, program and order views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boreflow.operators import aggregates as a
from boreflow.operators import windows as w
from boreflow.operators.places import places
from boreflow.plans.bindings import MSG, PROGRAM, TRACE, messages, program, table, trace
from boreflow.plans.paths import scratch_path
from boreflow.queries import query

T = f"WITH {TRACE} "
P = f"WITH {PROGRAM} "
WH = "PARTITION BY hole_id ORDER BY idx"


def r(c, n=4):
    return F.round(c, n)


@query(T + """SELECT h.hole_id, s.step, n FROM (SELECT DISTINCT hole_id FROM trace) h CROSS JOIN (SELECT unnest(range(6))::INTEGER AS step) s
    LEFT JOIN (SELECT hole_id, step, count(*) AS n FROM trace GROUP BY 1, 2) c ON c.hole_id = h.hole_id AND c.step = s.step""")
def a01_samples_per_step(spark, d):
    """Counts of requested steps; null where a hole has none."""
    t = trace(spark, d)
    counts = t.groupBy("hole_id", "step").agg(F.count("*").alias("n"))
    asked = counts.select("hole_id").distinct().select("hole_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("step"))
    return asked.join(counts, ["hole_id", "step"], "left")


@query(T + "SELECT hole_id, step, round(arg_min(pos_mm, idx), 4) AS first_pos FROM trace GROUP BY 1, 2")
def a02_first_position(spark, d):
    return trace(spark, d).groupBy("hole_id", "step").agg(r(a.first_by("pos_mm")).alias("first_pos"))


@query(T + "SELECT hole_id, step, round(arg_max(pos_mm, idx), 4) AS last_pos FROM trace GROUP BY 1, 2")
def a03_final_position(spark, d):
    return trace(spark, d).groupBy("hole_id", "step").agg(r(a.last_by("pos_mm")).alias("last_pos"))


@query(T + """SELECT hole_id, step, round(arg_min(torque_a + torque_empty_a, idx), 4) AS first_torque, round(arg_max(torque_a + torque_empty_a, idx), 4) AS last_torque,
    round(arg_min(thrust_a + thrust_empty_a, idx), 4) AS first_thrust, round(arg_max(thrust_a + thrust_empty_a, idx), 4) AS last_thrust FROM trace GROUP BY 1, 2""")
def a04_step_signals(spark, d):
    t = trace(spark, d).withColumns({"q": F.col("torque_a") + F.col("torque_empty_a"), "u": F.col("thrust_a") + F.col("thrust_empty_a")})
    return t.groupBy("hole_id", "step").agg(
        r(a.first_by("q")).alias("first_torque"), r(a.last_by("q")).alias("last_torque"),
        r(a.first_by("u")).alias("first_thrust"), r(a.last_by("u")).alias("last_thrust"),
    )


@query(T + """, c AS (SELECT hole_id, step, count(*) AS n FROM trace GROUP BY 1, 2)
SELECT step, string_agg(hole_id || ':' || n, ',' ORDER BY hole_id) AS counts FROM c GROUP BY 1""")
def a05_batch_step_table(spark, d):
    c = trace(spark, d).groupBy("step", "hole_id").agg(F.count("*").alias("n"))
    c = c.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("hole_id", "n"))).alias("x"))
    text = F.transform("x", lambda x: F.concat_ws(":", x["hole_id"], x["n"]))
    return c.select("step", F.array_join(text, ",").alias("counts"))


@query(T + """SELECT step, dense_rank() OVER (ORDER BY hole_id) AS place, hole_id, n, round(start, 4) AS start
FROM (SELECT hole_id, step, count(*) AS n, arg_min(pos_mm, idx) AS start FROM trace GROUP BY 1, 2)""")
def a05_step_rows(spark, d):
    """The flattened step table as rows, so that no step is one row of all holes."""
    x = a.batch_steps(trace(spark, d), "pos_mm", scratch_path(spark, "a05"))
    return x.select("step", "place", "hole_id", "n", r("start").alias("start"))


@query(T + f""", x AS (SELECT *, (pos_mm - lag(pos_mm) OVER ({WH})) * (torque_a + lag(torque_a) OVER ({WH})) / 2 AS t FROM trace)
SELECT hole_id, min(torque_a) AS low, max(torque_a) AS high, round(avg(torque_a), 4) AS mean, round(sum(torque_a * torque_a), 3) AS energy,
    round(sum(t), 6) AS area, count(*) AS n FROM x GROUP BY 1""")
def a06_hole_features(spark, d):
    f = a.hole_features(trace(spark, d), "torque_a", "pos_mm")
    return f.select("hole_id", "low", "high", r("mean").alias("mean"), r("energy", 3).alias("energy"), r("area", 6).alias("area"), "n")


@query(T + """SELECT hole_id, round(sum(torque_a * torque_a), 3) AS torque_energy, round(var_pop(torque_a), 4) AS torque_var,
    round(sum(thrust_a * thrust_a), 3) AS thrust_energy, round(var_pop(thrust_a), 4) AS thrust_var FROM trace GROUP BY 1""")
def a07_signal_energy(spark, d):
    cols = []
    for c in ("torque", "thrust"):
        x = F.col(f"{c}_a")
        cols += [r(F.sum(x * x), 3).alias(f"{c}_energy"), r(F.var_pop(x)).alias(f"{c}_var")]
    return trace(spark, d).groupBy("hole_id").agg(*cols)


@query(T + """, x AS (SELECT hole_id, step, (pos_mm - lag(pos_mm) OVER o) * (torque_a + lag(torque_a) OVER o) / 2 AS t FROM trace
    WINDOW o AS (PARTITION BY hole_id, step ORDER BY idx)) SELECT hole_id, step, round(coalesce(sum(t), 0), 6) AS area FROM x GROUP BY 1, 2""")
def a08_trapezoid(spark, d):
    return a.trapezoid(trace(spark, d), "torque_a", "pos_mm", ["hole_id", "step"]).select("hole_id", "step", r("area", 6).alias("area"))


@query(T + f""", x AS (SELECT hole_id, 48 * (torque_a + torque_empty_a + thrust_a) AS p, idx FROM trace),
e AS (SELECT hole_id, sum(0.01 * (p + q) / 2) AS e FROM (SELECT *, lag(p) OVER ({WH}) AS q FROM x) GROUP BY 1)
SELECT hole_id, round(e, 2) AS joule, round(0.7521 * e + 959.86, 2) AS corrected FROM e""")
def a09_electrical_energy(spark, d):
    """48 V times the currents over time at 100 samples a second, plain and with the linear correction."""
    p = 48 * (F.col("torque_a") + F.col("torque_empty_a") + F.col("thrust_a"))
    x = trace(spark, d).select("hole_id", "idx", F.coalesce(p, F.lit(0.0)).alias("p"), (F.col("idx") / 100).alias("t"))
    e = a.trapezoid(x, "p", "t", ["hole_id"], "e")
    return e.select("hole_id", r("e", 2).alias("joule"), r(0.7521 * F.col("e") + 959.86, 2).alias("corrected"))


@query(T + """, c AS (SELECT hole_id, torque_a, count(*) AS n FROM trace GROUP BY 1, 2)
SELECT hole_id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 5) AS entropy FROM c GROUP BY 1""")
def a10_entropy(spark, d):
    return a.entropy(trace(spark, d), "torque_a").select("hole_id", r("entropy", 5).alias("entropy"))


@query(T + "SELECT hole_id, round(CASE WHEN stddev_pop(torque_a) = 0 THEN 0 ELSE avg(torque_a) / stddev_pop(torque_a) END, 4) AS snr FROM trace GROUP BY 1")
def a11_snr(spark, d):
    return trace(spark, d).groupBy("hole_id").agg(r(a.snr("torque_a")).alias("snr"))


@query(T + """, m AS (SELECT hole_id, torque_a, avg(torque_a) OVER (PARTITION BY hole_id) AS m FROM trace)
SELECT hole_id, round(avg(abs(torque_a - m)), 4) AS mad FROM m GROUP BY 1""")
def a12_mean_abs_deviation(spark, d):
    return a.mean_abs_deviation(trace(spark, d), "torque_a").select("hole_id", r("mad").alias("mad"))


@query(T + f""", s AS (SELECT hole_id, torque_a, CASE WHEN count(*) OVER f = 5 THEN avg(torque_a) OVER f END AS s FROM trace
    WINDOW f AS ({WH} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT hole_id, round(sqrt(avg((s - torque_a) * (s - torque_a))), 4) AS rmse FROM s WHERE s IS NOT NULL GROUP BY 1""")
def a13_rmse(spark, d):
    s = trace(spark, d).withColumn("s", w.rolling("mean", F.col("torque_a"), 5)).where("s is not null")
    return s.groupBy("hole_id").agg(r(F.sqrt(F.avg(F.pow(F.col("s") - F.col("torque_a"), 2)))).alias("rmse"))


@query("""SELECT p_type AS material, p_size % 3 AS diameter, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY ROLLUP(1, 2)""")
def a14_material_rollup(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("material"), (F.col("p_size") % 3).alias("diameter"), "p_retailprice")
    return p.rollup("material", "diameter").agg(F.count("*").alias("n"), r(F.sum("p_retailprice"), 2).alias("total"))


@query(P + "SELECT program_id, round(sum(stroke * 0.8), 3) AS low, round(sum(stroke * 1.2), 3) AS high FROM program GROUP BY 1")
def a15_thickness_range(spark, d):
    return program(spark, d).groupBy("program_id").agg(r(F.sum(F.col("stroke") * 0.8), 3).alias("low"), r(F.sum(F.col("stroke") * 1.2), 3).alias("high"))


@query(P + """, x AS (SELECT * FROM program WHERE "on"), y AS (SELECT program_id - 1 AS program_id, step, stroke, feed FROM program WHERE "on")
SELECT program_id, round(sum(sqrt(pow(coalesce(x.stroke, 0) - coalesce(y.stroke, 0), 2) + pow(coalesce(x.feed, 0) - coalesce(y.feed, 0), 2))), 4) AS distance
FROM x FULL JOIN y USING (program_id, step) GROUP BY 1""")
def a16_program_distance(spark, d):
    """Each program against the next one, active steps."""
    p = program(spark, d).where("on").select("program_id", "step", "stroke", "feed")
    follower = p.withColumn("program_id", F.col("program_id") - 1)
    return a.step_distance(p, follower, "step", ["stroke", "feed"], ["program_id"]).select("program_id", r("distance").alias("distance"))


@query(P + "SELECT program_id, step, round(sum(sqrt(stroke * stroke + feed * feed)), 4) AS norm FROM program GROUP BY ROLLUP(1, 2) HAVING program_id IS NOT NULL")
def a17_distance_from_origin(spark, d):
    n = F.sqrt(F.col("stroke") * F.col("stroke") + F.col("feed") * F.col("feed"))
    return program(spark, d).rollup("program_id", "step").agg(r(F.sum(n)).alias("norm")).where("program_id is not null")


@query(T + "SELECT hole_id, count(DISTINCT step) AS steps, count(DISTINCT torque_a) AS torques FROM trace GROUP BY 1")
def a18_unique_counts(spark, d):
    return trace(spark, d).groupBy("hole_id").agg(F.count_distinct("step").alias("steps"), F.count_distinct("torque_a").alias("torques"))


@query("SELECT l_suppkey AS hole_id, min(l_orderkey) AS first_row, max(l_orderkey) AS last_row FROM lineitem GROUP BY 1")
def a19_group_range(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("hole_id")).agg(F.min("l_orderkey").alias("first_row"), F.max("l_orderkey").alias("last_row"))


@query("SELECT o_orderpriority AS folder, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS nok FROM orders GROUP BY 1")
def a20_ok_counts(spark, d):
    good = F.col("o_orderstatus") == "F"
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("folder"))
    return o.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("nok"))


@query("""SELECT o_custkey AS head, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS holes FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def a21_head_groups(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    g = o.groupBy(F.col("o_custkey").alias("head")).agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"))
    return g.select("head", F.array_join(F.transform("x", lambda x: x["o_orderkey"].cast("string")), ",").alias("holes"))


BIN = "CAST(idx // 40 AS BIGINT)"


@query(T + f"""SELECT hole_id, {BIN} AS bin, round(max(torque_a) - min(torque_a), 4) AS range, round(abs(arg_max(torque_a, idx) - arg_min(torque_a, idx)), 4) AS change
FROM trace GROUP BY 1, 2""")
def a22_position_bins(spark, d):
    """Bins of 2 mm (40 samples of 0.05 mm)."""
    b = F.floor(F.col("idx") / 40).alias("bin")
    return trace(spark, d).groupBy("hole_id", b).agg(
        r(F.max("torque_a") - F.min("torque_a")).alias("range"),
        r(F.abs(a.last_by("torque_a") - a.first_by("torque_a"))).alias("change"),
    )


@query(T + f"SELECT hole_id, {BIN} AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY hole_id), 5) AS share FROM trace GROUP BY 1, 2")
def a23_sample_density(spark, d):
    c = trace(spark, d).groupBy("hole_id", F.floor(F.col("idx") / 40).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("hole_id"))
    return c.select("hole_id", "bin", "n", r(F.col("n") / total, 5).alias("share"))


@query(T + f"""SELECT hole_id, {BIN} AS bin, round((arg_max(torque_a, idx) - arg_min(torque_a, idx)) / greatest(1, max(idx) - min(idx)), 5) AS gradient FROM trace GROUP BY 1, 2""")
def a24_bin_gradient(spark, d):
    g = (a.last_by("torque_a") - a.first_by("torque_a")) / F.greatest(F.lit(1), F.max("idx") - F.min("idx"))
    return trace(spark, d).groupBy("hole_id", F.floor(F.col("idx") / 40).alias("bin")).agg(r(g, 5).alias("gradient"))


@query(T + "SELECT hole_id, CAST(least(9, floor(torque_a / 0.5)) AS BIGINT) AS bin, count(*) AS n FROM trace GROUP BY 1, 2")
def a25_histogram(spark, d):
    bin_ = F.least(F.lit(9), F.floor(F.col("torque_a") / 0.5)).alias("bin")
    return trace(spark, d).groupBy("hole_id", bin_).agg(F.count("*").alias("n"))


@query("""SELECT l_linenumber AS n_window, round(avg(CASE WHEN abs(l_quantity - 25) <= 5 THEN 1 ELSE 0 END), 5) AS within, round(avg(abs(l_quantity - 25)), 4) AS mean,
    round(var_pop(abs(l_quantity - 25)), 4) AS variance, min(abs(l_quantity - 25)) AS low, max(abs(l_quantity - 25)) AS high FROM lineitem GROUP BY 1""")
def a26_accuracy(spark, d):
    e = F.abs(F.col("l_quantity") - 25)
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n_window")).agg(
        r(F.avg((e <= 5).cast("int")), 5).alias("within"), r(F.avg(e)).alias("mean"), r(F.var_pop(e)).alias("variance"),
        F.min(e).alias("low"), F.max(e).alias("high"),
    )


@query(T + "SELECT hole_id, round(corr(torque_a, thrust_a), 4) AS r FROM trace GROUP BY 1")
def a27_correlation(spark, d):
    return trace(spark, d).groupBy("hole_id").agg(r(F.corr("torque_a", "thrust_a")).alias("r"))


@query("""SELECT l_returnflag AS truth, l_linestatus AS guess, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM lineitem), 4) AS percent
FROM lineitem GROUP BY GROUPING SETS ((1, 2), (1), (2), ())""")
def a28_confusion(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("guess"))
    c = li.cube("truth", "guess").agg(F.count("*").alias("n"))
    total = F.max("n").over(Window.partitionBy(F.lit(1)))  # the cube has as many rows as classes squared
    return c.select("truth", "guess", "n", r(100 * F.col("n") / total).alias("percent"))


@query(T + """, s AS (SELECT hole_id, min(abs(pos_mm)) FILTER (step = 1) - min(abs(pos_mm)) AS x FROM trace GROUP BY 1)
SELECT count(x) AS holes, round(max(x), 4) AS xstart, round(avg(x), 4) AS mean FROM s""")
def a29_xstart(spark, d):
    p = F.abs("pos_mm")
    s = trace(spark, d).groupBy("hole_id").agg((F.min(F.when(F.col("step") == 1, p)) - F.min(p)).alias("x"))
    return s.agg(F.count("x").alias("holes"), r(F.max("x")).alias("xstart"), r(F.avg("x")).alias("mean"))


@query(f"WITH {MSG} SELECT topic, count(*) AS n, min(ts) AS oldest, max(ts) AS newest, round(avg(value), 4) AS mean FROM msg GROUP BY 1")
def a30_buffer_statistics(spark, d):
    return messages(spark, d).groupBy("topic").agg(
        F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("oldest"), F.max("ts").cast("timestamp_ntz").alias("newest"), r(F.avg("value")).alias("mean")
    )


@query(f"WITH {MSG} SELECT kind, count(*) AS n, count(*) FILTER (k % 7 = 0) AS unprocessed FROM msg GROUP BY 1")
def a31_correlation_statistics(spark, d):
    return messages(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("k") % 7 == 0).alias("unprocessed"))


@query(T + """, m AS (SELECT hole_id, max(torque_a) + max(torque_empty_a) AS m FROM trace GROUP BY 1)
SELECT hole_id % 4 AS x, s_nationkey AS trace_factor, round(avg(m), 4) AS mean FROM m JOIN supplier ON s_suppkey = hole_id GROUP BY 1, 2""")
def a32_interaction_means(spark, d):
    m = trace(spark, d).groupBy("hole_id").agg((F.max("torque_a") + F.max("torque_empty_a")).alias("m"))
    m = m.join(table(spark, d, "supplier"), F.col("hole_id") == F.col("s_suppkey"))
    return m.groupBy((F.col("hole_id") % 4).alias("x"), F.col("s_nationkey").alias("trace_factor")).agg(r(F.avg("m")).alias("mean"))


@query(T + f""", g AS (SELECT hole_id, CASE WHEN count(*) OVER f = 30 THEN regr_slope(torque_a, idx) OVER f ELSE 0 END AS g FROM trace
    WINDOW f AS ({WH} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT hole_id, round(min(g), 6) AS low, round(max(g), 6) AS high, round(avg(g), 6) AS mean, round(var_pop(g), 6) AS variance FROM g GROUP BY 1""")
def a33_gradient_summary(spark, d):
    g = trace(spark, d).select("hole_id", w.slope_ols(F.col("torque_a"), 30).alias("g"))
    return g.groupBy("hole_id").agg(*(r(f("g"), 6).alias(n) for f, n in ((F.min, "low"), (F.max, "high"), (F.avg, "mean"), (F.var_pop, "variance"))))


@query(T + """, e AS (SELECT hole_id, CAST(idx // 25 AS BIGINT) AS win, sum(torque_a * torque_a) AS e, count(*) AS n FROM trace GROUP BY 1, 2)
SELECT hole_id, win, round(e / n, 4) AS power, e >= 0.8 * max(e) OVER (PARTITION BY hole_id) AS hot FROM e""")
def a34_hot_windows(spark, d):
    x = F.col("torque_a")
    e = trace(spark, d).groupBy("hole_id", F.floor(F.col("idx") / 25).alias("win")).agg(F.sum(x * x).alias("e"), F.count("*").alias("n"))
    top = F.max("e").over(Window.partitionBy("hole_id"))
    return e.select("hole_id", "win", r(F.col("e") / F.col("n")).alias("power"), (F.col("e") >= 0.8 * top).alias("hot"))


@query("""WITH x AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS t, CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS g FROM lineitem),
c AS (SELECT count(*) FILTER (t = 1 AND g = 1) AS tp, count(*) FILTER (t = 0 AND g = 1) AS fp, count(*) FILTER (t = 1 AND g = 0) AS fn, count(*) FILTER (t = g) AS ok, count(*) AS n FROM x)
SELECT round(ok / n, 5) AS accuracy, round(tp / (tp + fp), 5) AS precision, round(tp / (tp + fn), 5) AS recall, round(2 * tp / (2 * tp + fp + fn), 5) AS f1 FROM c""")
def a35_scores(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("t"), (F.col("l_quantity") > 30).cast("int").alias("g"))
    s = x.agg(*a.scores("t", "g"))
    return s.select(*(r(c, 5).alias(c) for c in s.columns))


# sorts, limits, top-k


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place FROM lineitem")
def t01_sort_by_counters(spark, d):
    """Global then local counter, as numbers; the place in the sorted list of all files."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return places(table(spark, d, "lineitem").select(order), order, scratch_path(spark, "t01")).select("l_orderkey", "l_linenumber", "l_partkey", "place")


@query("SELECT o_custkey, max(o_orderkey) AS hole, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def t03_max_hole(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("hole"), F.max_by("o_totalprice", "o_orderkey").alias("price"))


@query("""SELECT o_custkey, o_orderkey, round(abs(o_totalprice - 250000), 2) AS off FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY abs(o_totalprice - 250000), o_orderkey) AS k FROM orders) WHERE k <= 3""")
def t04_n_best(spark, d):
    """The three holes of each head nearest to nominal."""
    off = F.abs(F.col("o_totalprice") - 250000)
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("off", "o_orderkey"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", off.alias("off")).withColumn("k", k).where("k <= 3")
    return o.select("o_custkey", "o_orderkey", r("off", 2).alias("off"))


@query(T + f""", c AS (SELECT hole_id, idx, -torque_a AS y, CASE WHEN torque_a IS NOT DISTINCT FROM lag(torque_a) OVER ({WH}) AND idx > 0 THEN 0 ELSE 1 END AS n FROM trace),
q AS (SELECT *, sum(n) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS run FROM c), f AS (SELECT hole_id, run, min(idx) AS lo, max(idx) AS hi, any_value(y) AS y FROM q GROUP BY 1, 2),
m AS (SELECT *, lag(y) OVER o AS a, lead(y) OVER o AS b FROM f WINDOW o AS (PARTITION BY hole_id ORDER BY run)),
v AS (SELECT hole_id, (lo + hi) // 2 AS idx, -y AS torque_a FROM m WHERE y > a AND y > b)
SELECT hole_id, CAST(idx AS BIGINT) AS idx, torque_a FROM (SELECT *, row_number() OVER (PARTITION BY hole_id ORDER BY torque_a, idx) AS k FROM v) WHERE k <= 5""")
def t05_lowest_valleys(spark, d):
    t = trace(spark, d).withColumn("y", -F.col("torque_a"))
    v = w.peaks(t, "y", None).select("hole_id", "idx", (-F.col("y")).alias("torque_a"))
    k = F.row_number().over(Window.partitionBy("hole_id").orderBy("torque_a", "idx"))
    return v.withColumn("k", k).where("k <= 5").drop("k")


@query(f"""WITH {MSG} SELECT topic, event_id FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ts DESC, event_id DESC) AS nth FROM msg) WHERE nth <= 10""")
def t06_newest_per_buffer(spark, d):
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("ts"), F.desc("event_id")))
    return messages(spark, d).select("topic", "event_id", k.alias("k")).where("k <= 10").drop("k")


@query(T + """SELECT hole_id, round(avg(torque_a), 4) AS mean, round(stddev_samp(torque_a), 4) AS sd FROM trace GROUP BY 1 HAVING abs(avg(torque_a) - 2.55) <= 0.05 AND stddev_samp(torque_a) <= 1.45""")
def t07_run_search(spark, d):
    """Holes whose mean lies within both bounds, these included; it is a decimal, so that no order of summing decides at a bound or a tie."""
    exact = F.col("torque_a").cast("decimal(28,12)")
    g = trace(spark, d).groupBy("hole_id").agg(F.avg(exact).alias("m"), F.stddev_samp("torque_a").alias("s"))
    return g.where("abs(m - 2.55BD) <= 0.05BD and s <= 1.45").select("hole_id", r("m").cast("double").alias("mean"), r("s").alias("sd"))


# set operations


@query("""SELECT 'head' AS origin, o_custkey AS id, o_totalprice AS price, NULL::DOUBLE AS balance FROM orders UNION ALL SELECT 'box', s_suppkey, NULL, s_acctbal FROM supplier""")
def u01_union_by_name(spark, d):
    o = table(spark, d, "orders").select(F.lit("head").alias("origin"), F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"))
    s = table(spark, d, "supplier").select(F.lit("box").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return o.unionByName(s, allowMissingColumns=True)


@query(T + "SELECT hole_id, string_agg(DISTINCT step::VARCHAR, ',' ORDER BY step::VARCHAR) AS found FROM trace WHERE step IN (1, 3, 9) GROUP BY 1")
def u02_intersect_codes(spark, d):
    g = trace(spark, d).groupBy("hole_id").agg(F.collect_set("step").alias("s"))
    both = F.sort_array(F.array_intersect("s", F.array(*map(F.lit, (1, 3, 9)))).cast("array<string>"))
    return g.where(F.size(both) > 0).select("hole_id", F.array_join(both, ",").alias("found"))


@query("SELECT DISTINCT p_type, p_size FROM part")
def u03_distinct(spark, d):
    return table(spark, d, "part").select("p_type", "p_size").distinct()


@query("SELECT tool, k FROM msg WHERE kind = 'result' EXCEPT ALL SELECT tool, k FROM msg WHERE kind = 'trace'".replace("SELECT tool, k FROM msg WHERE kind = 'result'", f"WITH {MSG} SELECT tool, k FROM msg WHERE kind = 'result'", 1))
def u04_difference(spark, d):
    """Results of a tool and count that no trace of the same tool and count takes, as often as they are left over."""
    m = messages(spark, d)
    return m.where("kind = 'result'").select("tool", "k").exceptAll(m.where("kind = 'trace'").select("tool", "k"))
