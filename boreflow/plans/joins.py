"""Join queries over the trace, message and program views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from boreflow.operators import joins as j
from boreflow.operators.places import bounded, places
from boreflow.plans.bindings import MSG, PROGRAM, TRACE, messages, program, table, trace
from boreflow.plans.paths import scratch_path
from boreflow.queries import query

M = f"WITH {MSG} "
T = f"WITH {TRACE} "
WINDOW_S = 1800


def side(spark, d, kind, name):
    m = messages(spark, d).where(F.col("kind") == kind)
    return m.select("tool", F.col("event_id").alias(name), F.col("ts").alias(f"ts_{name}"))


PAIRS = f"""r AS (SELECT tool, event_id AS result, ts AS ts_r FROM msg WHERE kind = 'result'), t AS (SELECT tool, event_id AS trace, ts AS ts_t FROM msg WHERE kind = 'trace'),
p AS (SELECT r.tool, result, trace, ts_r, ts_t FROM r JOIN t ON r.tool = t.tool AND abs(epoch_us(ts_r) - epoch_us(ts_t)) <= {WINDOW_S} * 1000000)"""


@query(T + "SELECT hole_id, s_name AS head, s_nationkey AS nation, count(*) AS n FROM trace JOIN supplier ON s_suppkey = hole_id GROUP BY ALL")
def j01_metadata(spark, d):
    meta = table(spark, d, "supplier").select(F.col("s_suppkey").alias("hole_id"), F.col("s_name").alias("head"), F.col("s_nationkey").alias("nation"))
    return trace(spark, d).groupBy("hole_id").agg(F.count("*").alias("n")).join(meta, "hole_id")


@query(f"""WITH {TRACE}, {PROGRAM} SELECT hole_id, t.step, count(*) AS n, max(rpm) AS rpm FROM trace t LEFT JOIN program p ON p.program_id = t.hole_id AND p.step = t.step AND "on" GROUP BY 1, 2""")
def j02_program_of_step(spark, d):
    p = program(spark, d).where("on").select(F.col("program_id").alias("hole_id"), F.col("step").alias("step_nb"), "rpm")
    t = trace(spark, d)
    joined = t.join(p, (t["hole_id"] == p["hole_id"]) & (t["step"] == p["step_nb"]), "left").drop(p["hole_id"])
    return joined.groupBy("hole_id", "step").agg(F.count("*").alias("n"), F.max("rpm").alias("rpm"))


@query(f"""WITH {PROGRAM}, a AS (SELECT program_id, step, stroke FROM program WHERE "on"), b AS (SELECT program_id, step, delay FROM program WHERE delay > 0)
SELECT program_id, step, stroke, delay FROM a FULL JOIN b USING (program_id, step)""")
def j03_full_outer_on_step(spark, d):
    p = program(spark, d)
    a, b = p.where("on").select("program_id", "step", "stroke"), p.where("delay > 0").select("program_id", "step", "delay")
    return a.join(b, ["program_id", "step"], "full_outer")


@query(M + f", {PAIRS} SELECT tool, result, trace FROM p")
def j04_interval_join(spark, d):
    return j.interval_join(side(spark, d, "result", "result"), side(spark, d, "trace", "trace"), "tool", "ts_result", "ts_trace", WINDOW_S).select("tool", "result", "trace")


def _greedy(spark, d):
    return j.greedy_sweep(side(spark, d, "result", "result"), side(spark, d, "trace", "trace"), "tool", "result", "trace", "ts_result", "ts_trace", WINDOW_S)


GREEDY = """RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts_r, result, ts_t, trace) AS n FROM p),
g(tool, n, ls, rs) AS (SELECT tool, 1::BIGINT, [result], [trace] FROM q WHERE n = 1 UNION ALL
    SELECT q.tool, q.n, CASE WHEN list_contains(ls, result) OR list_contains(rs, trace) THEN ls ELSE list_append(ls, result) END,
        CASE WHEN list_contains(ls, result) OR list_contains(rs, trace) THEN rs ELSE list_append(rs, trace) END FROM g JOIN q ON q.tool = g.tool AND q.n = g.n + 1),
z AS (SELECT tool, arg_max(ls, n) AS ls, arg_max(rs, n) AS rs FROM g GROUP BY 1)
SELECT tool, unnest(ls) AS result, unnest(rs) AS trace FROM z"""


@query(f"WITH RECURSIVE {MSG}, {PAIRS}, {GREEDY.removeprefix('RECURSIVE ')}")
def j05_greedy_match(spark, d):
    return _greedy(spark, d)


@query(M + f""", r AS (SELECT tool, event_id AS result, ts AS a FROM msg WHERE kind = 'result'), h AS (SELECT tool, event_id AS heads, ts AS b FROM msg WHERE kind = 'heads'),
x AS (SELECT r.tool, result, heads, row_number() OVER (PARTITION BY result ORDER BY b, heads) AS k FROM r LEFT JOIN h ON r.tool = h.tool AND abs(epoch_us(a) - epoch_us(b)) <= {WINDOW_S} * 1000000)
SELECT tool, result, heads FROM x WHERE k = 1""")
def j06_optional_heads(spark, d):
    x = j.interval_join(side(spark, d, "result", "result"), side(spark, d, "heads", "heads"), "tool", "ts_result", "ts_heads", WINDOW_S, "left")
    k = F.row_number().over(Window.partitionBy("result").orderBy("ts_heads", "heads"))
    return x.withColumn("k", k).where("k = 1").select("tool", "result", "heads")


@query(M + """, r AS (SELECT event_id AS result, ts AS a FROM msg WHERE kind = 'result'), h AS (SELECT event_id AS heads, ts AS b FROM msg WHERE kind = 'heads')
SELECT result, heads FROM r JOIN h ON abs(epoch_us(a) - epoch_us(b)) <= 60000000""")
def j07_time_buckets(spark, d):
    """Heads near a result in time alone."""
    one = F.lit(1).alias("all")
    r = messages(spark, d).where("kind = 'result'").select(one, F.col("event_id").alias("result"), F.col("ts").alias("a"))
    h = messages(spark, d).where("kind = 'heads'").select(one, F.col("event_id").alias("heads"), F.col("ts").alias("b"))
    return j.interval_join(r, h, "all", "a", "b", 60).select("result", "heads")


@query(M + """SELECT tool, arg_max(value, ts) FILTER (kind = 'result') AS result, arg_max(value, ts) FILTER (kind = 'trace') AS trace FROM msg
WHERE kind IN ('result', 'trace') GROUP BY 1 HAVING count(DISTINCT kind) = 2""")
def j08_key_complete(spark, d):
    return j.latest_per_type(messages(spark, d), "tool", "kind", "ts", "value", ["result", "trace"])


@query("SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def j09_by_hole_count(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return table(spark, d, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("""WITH g AS (SELECT i AS code, i * 1.5875::DOUBLE + 0.127 AS hi, lag(i * 1.5875::DOUBLE + 0.127, 1, 0.127::DOUBLE) OVER (ORDER BY i) AS lo FROM (SELECT unnest(range(1, 26)) AS i))
SELECT p_partkey, coalesce(code, 0) AS code FROM (SELECT p_partkey, p_size / 1.1 AS depth FROM part) LEFT JOIN g ON depth > lo AND depth <= hi""")
def j10_grip_code(spark, d):
    return table(spark, d, "part").select("p_partkey", j.grip_code(F.col("p_size") / 1.1).cast("bigint").alias("code"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS i, s_name FROM supplier), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_name FROM nation)
SELECT i, s_name, n_name FROM a JOIN b USING (i)""")
def j11_positional(spark, d):
    """Two frames side by side by position; the shorter one decides."""
    a = places(table(spark, d, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"], scratch_path(spark, "left"), "i")
    b = places(table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], scratch_path(spark, "right"), "i")
    return a.join(b, "i").select("i", "s_name", "n_name")


@query(T + """SELECT hole_id // 3 AS part, idx, coalesce(max(torque_a) FILTER (hole_id % 3 = 0), 0) AS c0, coalesce(max(torque_a) FILTER (hole_id % 3 = 1), 0) AS c1,
    coalesce(max(torque_a) FILTER (hole_id % 3 = 2), 0) AS c2 FROM trace GROUP BY 1, 2""")
def j12_ragged_channels(spark, d):
    t = trace(spark, d).select(F.floor(F.col("hole_id") / 3).alias("part"), "idx", (F.col("hole_id") % 3).alias("c"), "torque_a")
    t = bounded(t, "part", "idx", counted=table(spark, d, "lineitem"))
    wide = t.groupBy("part", "idx").pivot("c", [0, 1, 2]).agg(F.max("torque_a")).fillna(0.0)
    return wide.toDF("part", "idx", "c0", "c1", "c2")


@query(f"""WITH {PROGRAM}, s AS (SELECT program_id // 8 AS family, program_id, string_agg(stroke::VARCHAR, ',' ORDER BY step) AS strokes FROM program GROUP BY 1, 2)
SELECT a.program_id AS a, b.program_id AS b, a.strokes || ',' || b.strokes AS strokes FROM s a JOIN s b ON a.family = b.family AND a.program_id <> b.program_id""")
def j13_ordered_pairs(spark, d):
    """Pairs within a family of eight programs, in either order, their signals one after the other."""
    s = program(spark, d).groupBy(F.floor(F.col("program_id") / 8).alias("family"), "program_id").agg(F.sort_array(F.collect_list(F.struct("step", "stroke"))).alias("x"))
    s = s.select("family", "program_id", F.transform("x", lambda x: x["stroke"].cast("string")).alias("x"))
    a, b = s.toDF("family", "a", "xa"), s.toDF("family", "b", "xb")
    return a.join(b, "family").where("a <> b").select("a", "b", F.array_join(F.concat("xa", "xb"), ",").alias("strokes"))


@query(f"""WITH {PROGRAM}, x AS (SELECT a.program_id AS src, b.program_id AS dst, sqrt(pow(a.stroke - b.stroke, 2) + pow(a.feed - b.feed, 2)) AS d
    FROM program a JOIN program b ON a.step = b.step AND a.program_id // 8 = b.program_id // 8 AND a.program_id < b.program_id)
SELECT src, dst, round(CASE WHEN sum(d) = 0 THEN 100000 ELSE 1 / sum(d) END, 6) AS weight FROM x GROUP BY 1, 2""")
def j14_program_graph(spark, d):
    """Edges between the programs of a family, weighted by the inverse distance."""
    p = program(spark, d).select(F.floor(F.col("program_id") / 8).alias("family"), "program_id", "step", "stroke", "feed")
    a, b = p.toDF("family", "src", "step", "s1", "f1"), p.toDF("family", "dst", "step", "s2", "f2")
    x = a.join(b, ["family", "step"]).where("src < dst").withColumn("d", F.sqrt(F.pow(F.col("s1") - F.col("s2"), 2) + F.pow(F.col("f1") - F.col("f2"), 2)))
    g = x.groupBy("src", "dst").agg(F.sum("d").alias("d"))
    return g.select("src", "dst", F.round(F.when(F.col("d") == 0, 1e5).otherwise(1 / F.col("d")), 6).alias("weight"))


@query(M + f", {PAIRS} SELECT event_id, event_id IN (SELECT result FROM p) AS matched FROM msg WHERE kind = 'result'")
def j15_matched_and_not(spark, d):
    r = side(spark, d, "result", "result")
    p = j.interval_join(r, side(spark, d, "trace", "trace"), "tool", "ts_result", "ts_trace", WINDOW_S).select("result").distinct()
    yes = r.join(p, "result", "left_semi").select(F.col("result").alias("event_id"), F.lit(True).alias("matched"))
    return yes.union(r.join(p, "result", "left_anti").select(F.col("result"), F.lit(False)))


@query(T + """, m AS (SELECT hole_id, max(torque_a) AS m, avg(torque_a) AS a FROM trace GROUP BY 1), t AS (SELECT * FROM (VALUES ('low', 2.0::DOUBLE), ('mid', 2.5::DOUBLE), ('high', 3.0::DOUBLE)) AS v(name, level))
SELECT hole_id, name, round(a - level, 4) AS above FROM m, t""")
def j16_templates_by_signal(spark, d):
    """Each of the given templates against each signal; the templates are a fixed list."""
    levels = {"low": 2.0, "mid": 2.5, "high": 3.0}
    m = trace(spark, d).groupBy("hole_id").agg(F.avg("torque_a").alias("a"))
    t = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("level")) for n, v in levels.items()))).alias("t")
    return m.select("hole_id", "a", t).select("hole_id", "t.name", F.round(F.col("a") - F.col("t.level"), 4).alias("above"))


@query(M + """, p AS (SELECT n_nationkey * 100000 AS s, n_nationkey * 100000 + 40000 AS e, n_name AS label FROM nation)
SELECT event_id, label FROM (SELECT event_id, epoch_us(ts) // 1000000 - 1704067200 AS t FROM msg) LEFT JOIN p ON t BETWEEN s AND e""")
def j17_label_periods(spark, d):
    m = messages(spark, d).select("event_id", (F.unix_seconds("ts") - 1704067200).alias("t"))
    n = table(spark, d, "nation")
    p = n.select((F.col("n_nationkey") * 100000).alias("s"), (F.col("n_nationkey") * 100000 + 40000).alias("e"), F.col("n_name").alias("label"))
    return j.label_periods(m, p, "t", "s", "e", "label").select("event_id", "label")


@query(f"""WITH RECURSIVE {MSG}, q AS (SELECT event_id, tool, k, epoch_us(ts) // 3600000000 * 3600000000 AS t,
    row_number() OVER (PARTITION BY tool, k ORDER BY epoch_us(ts) // 3600000000, event_id) AS n FROM msg),
g(tool, k, n, event_id, kept_at, dup) AS (SELECT tool, k, 1::BIGINT, event_id, t, false FROM q WHERE n = 1 UNION ALL
    SELECT q.tool, q.k, q.n, q.event_id, CASE WHEN q.t - kept_at < 86400000000 THEN kept_at ELSE q.t END, q.t - kept_at < 86400000000 FROM g JOIN q ON q.tool = g.tool AND q.k IS NOT DISTINCT FROM g.k AND q.n = g.n + 1)
SELECT event_id, dup AS is_duplicate FROM g""")
def u05_duplicates(spark, d):
    """Same tool and content (or none) within a day of the last one kept; times are whole hours, so that many are equal."""
    m = messages(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))
    return j.duplicates(m, "tool", "ts", "k", 86400, "event_id").select("event_id", "is_duplicate")
