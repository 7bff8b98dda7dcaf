"""Model windows and their heat maps, line fits with ends, deep equality, keys at any depth."""

from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators import joins as j
from boreflow.operators import model_windows as mw
from boreflow.operators import segments as sg
from boreflow.operators import windows as w
from boreflow.plans.bindings import MSG, TRACE, messages, table, trace
from boreflow.plans.templates import PECKED, pecked
from boreflow.plans.windows import _LAGS, WH
from boreflow.queries import query

T = f"WITH {TRACE} "
M = f"WITH {MSG} "
#: Heat below this counts as none.
LEVEL = 0.25

_HEAT = " + ".join(
    f"CASE WHEN abs(torque{i} - lag(torque{i}) OVER o) >= {LEVEL} THEN abs(torque{i} - lag(torque{i}) OVER o) ELSE 0 END" for i in range(1, mw.COLUMNS + 1)
)
WINDOWS = f"""r AS (SELECT hole_id, torque_a, abs(pos_mm) AS p, row_number() OVER ({WH}) - 1 AS r FROM trace WHERE step = 2),
x AS (SELECT hole_id, r // 3 AS "row", max(CASE WHEN r % 3 = 0 THEN torque_a END) AS p0, max(CASE WHEN r % 3 = 1 THEN torque_a END) AS p1,
    max(CASE WHEN r % 3 = 2 THEN torque_a END) AS p2, max(CASE WHEN r % 3 = 1 THEN p END) AS p FROM r GROUP BY 1, 2),
fr AS (SELECT hole_id, "row", coalesce(lag(p, 2) OVER o, 0) AS xpos, {_LAGS} FROM x WHERE p2 IS NOT NULL WINDOW o AS (PARTITION BY hole_id ORDER BY "row")),
hr AS (SELECT hole_id, "row" + 400 AS at_, xpos, torque8, round({_HEAT}, 4) AS h FROM fr WINDOW o AS (PARTITION BY hole_id ORDER BY "row")),
pk AS (SELECT hole_id, arg_max(at_, struct_pack(t := torque8, i := -at_)) AS peak, count(*) + 800 AS n FROM hr GROUP BY 1),
wn AS (SELECT * FROM (SELECT hole_id, n, k AS window_nr, peak - 330 + k * 5 AS b FROM pk, (SELECT unnest(range(40)) AS k)) WHERE b >= 0 AND b + 512 <= n),
be AS (SELECT wn.hole_id, window_nr, b AS "begin", arg_max(at_, struct_pack(h := coalesce(h, 0), i := -at_)) AS at_ FROM wn JOIN hr ON hr.hole_id = wn.hole_id AND at_ > b AND at_ < b + 512 GROUP BY 1, 2, 3),
sc AS (SELECT be.hole_id, window_nr, "begin", be.at_ AS "at", xpos FROM be JOIN hr ON hr.hole_id = be.hole_id AND hr.at_ = be.at_)"""


def _scored(spark, d, step=2):
    t = trace(spark, d).withColumn("pos_mm", F.abs("pos_mm"))
    frame = mw.model_frame(t.withColumns({"local": F.col("hole_id") * 0.034 - 1.7, "predrilled": F.lit(0.69)}), "torque_a", "pos_mm", "local", "predrilled", step)
    return mw.score_windows(frame, mw.torque_gradient, LEVEL)


@query(T + f""", {WINDOWS} SELECT hole_id, window_nr, "begin", "at", round(xpos, 4) AS xpos FROM sc""")
def x01_model_windows(spark, d):
    """512 x 17 windows through the model hook: hottest row of each."""
    return _scored(spark, d).select("hole_id", "window_nr", "begin", "at", F.round("xpos", 4).alias("xpos"))


@query(T + f""", {WINDOWS} SELECT hole_id, round(avg(xpos), 4) AS exit, count(*) AS windows FROM sc GROUP BY 1""")
def d09_model_exits(spark, d):
    """Exit of a hole: the mean over its 40 windows of the position where the heat map is hottest."""
    return mw.exits(_scored(spark, d)).select("hole_id", F.round("exit", 4).alias("exit"), "windows")


def _exit_sql(step):
    return f"(WITH {WINDOWS.replace('step = 2', f'step = {step}')} SELECT hole_id, avg(xpos) AS v FROM sc GROUP BY 1)"


@query(T + f""", {PECKED}, f AS {_exit_sql(1)}, l AS {_exit_sql(2)},
y AS (SELECT hole_id, max(mean_max) FILTER (segment = 1) AS a, max(mean_max) FILTER (segment = 2) AS b, max(mean_min) FILTER (segment = 2) AS c FROM z GROUP BY 1),
m AS (SELECT y.hole_id, a, c, CASE WHEN a < b AND b < c THEN b END AS b, f.v AS f, l.v AS l FROM y LEFT JOIN f USING (hole_id) LEFT JOIN l USING (hole_id))
SELECT hole_id, round(CASE WHEN b - f - l IS NOT NULL THEN f WHEN b IS NULL AND c - a IS NOT NULL THEN a END, 3) AS entry,
    round(CASE WHEN b - f - l IS NOT NULL THEN b - (a - f + c - l) / 2 WHEN b IS NULL AND c - a IS NOT NULL THEN 0 END, 3) AS transition,
    round(CASE WHEN b - f - l IS NOT NULL THEN l WHEN b IS NULL AND c - a IS NOT NULL THEN c END, 3) AS exit FROM m""")
def d10_model_and_segments(spark, d):
    """Ends by the model, and the transition of the segments moved by the mean delay; one out of order does not count."""
    ends = [mw.exits(_scored(spark, d, step)).select("hole_id", F.col("exit").alias(n)) for step, n in ((1, "first"), (2, "last"))]
    layers = sg.layer_depths(sg.segment_statistics(pecked(spark, d), "torque_a", 0.72, only=(1, 2)), "mean")
    layers = layers.withColumn("transition", F.when(F.col("total").isNotNull(), F.col("transition")))
    x = sg.combined_depths(layers, ends[0].join(ends[1], "hole_id", "full_outer"))
    return x.select("hole_id", *(F.round(n, 3).alias(n) for n in ("entry", "transition", "exit")))


def _ends(n, sign):
    of = lambda k: w.line_coefficients(n, k if sign > 0 else n - 1 - k, w.hann(n))
    at = lambda k, i: i - k if sign > 0 else k - (n - 1) + i
    shift = lambda o: f"lag(torque_a, {-o}) OVER o" if o < 0 else f"lead(torque_a, {o}) OVER o"
    count = "i" if sign > 0 else "n - 1 - i"
    return " ".join(f"WHEN {count} = {k} THEN {' + '.join(f'{x!r}::DOUBLE * {shift(at(k, i))}' for i, x in enumerate(of(k)))}" for k in range(n // 2))


@query(T + f""", i AS (SELECT *, row_number() OVER ({WH}) - 1 AS i, count(*) OVER (PARTITION BY hole_id) AS n FROM trace)
SELECT hole_id, idx, round(CASE {_ends(9, 1)} {_ends(9, -1)} WHEN count(*) OVER f = 9 THEN avg(torque_a) OVER f END, 6) AS smooth
FROM i WINDOW o AS ({WH}), f AS ({WH} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""")
def w12_fit_with_ends(spark, d):
    """Line fit over nine samples; the first and last four lie on the weighted line of the first and last window."""
    return trace(spark, d).select("hole_id", "idx", F.round(w.line_fit("torque_a", 9), 6).alias("smooth"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice
    AND (a.p_partkey % 5 = 0) = (b.p_partkey % 5 = 0) AND a.p_partkey < b.p_partkey""")
def f14_deep_pairs(spark, d):
    """Nested documents that are equal but for differences of numbers under 1e-10, which lie on both sides of bounds; each fifth is off by more."""
    k = F.col("p_partkey")
    off = F.when(k % 5 == 0, 1e-7).otherwise(0.0) + F.when(k % 2 == 0, 2e-11).otherwise(-2e-11)
    numbers = F.to_json(F.struct(F.struct(F.array(F.col("p_size").cast("double") + off, F.lit(0.5)).alias("n"), F.lit("x").alias("s")).alias("m")))
    doc = F.concat(F.lit('{"p":'), F.col("p_retailprice").cast("string"), F.lit(',"d":['), numbers, F.lit(",{},[]]}"))
    return j.deep_equal_pairs(table(spark, d, "part").select("p_partkey", doc.alias("doc")), "p_partkey", "doc")


@query(M + "SELECT event_id, tool::VARCHAR AS value FROM msg")
def f06_deep_key(spark, d):
    """A value under twenty levels of lists and objects."""
    doc = F.concat(F.lit('{"a":[' * 10), F.to_json(F.struct(F.col("tool").alias("Value"))), F.lit("]}" * 10))
    return messages(spark, d).select("event_id", F.get(c.find_values(doc, "Value"), F.lit(0)).alias("value"))
