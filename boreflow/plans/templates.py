"""Segment and template queries: windows that follow the feed, templates cut from one hole and matched in all."""

from pyspark.sql import functions as F

from boreflow.operators import segments as sg
from boreflow.operators import templates as tp
from boreflow.plans.bindings import TRACE, trace
from boreflow.queries import query

T = f"WITH {TRACE} "
WH = "PARTITION BY hole_id ORDER BY idx"
SEG = "PARTITION BY hole_id, segment ORDER BY idx"


def pecked(spark, d):
    """The trace with a retract at each step and a feed that differs by hole and step: segments of their own window."""
    feed = 0.03 + 0.01 * ((F.col("hole_id") + F.col("step")) % 4)
    return trace(spark, d).withColumn("pos_mm", -(F.col("step") * 4.0 + (F.col("idx") % 150) * feed))


PECKED = f"""k AS (SELECT hole_id, idx, torque_a, abs(-(step * 4.0::DOUBLE + (idx % 150) * (0.03::DOUBLE + 0.01::DOUBLE * ((hole_id + step) % 4)))) AS p FROM trace),
s AS (SELECT *, sum(back) OVER ({WH} ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, CASE WHEN p < lag(p) OVER ({WH}) THEN 1 ELSE 0 END AS back FROM k)),
g AS (SELECT *, (torque_a - lag(torque_a) OVER ({SEG})) / (p - lag(p) OVER ({SEG})) AS g, p - lag(p) OVER ({SEG}) AS dp FROM s),
n AS (SELECT hole_id, segment, CAST(round_even(0.72::DOUBLE / median(dp), 0) AS INTEGER) AS width FROM g GROUP BY 1, 2),
w AS (SELECT a.hole_id, a.segment, n.width, a.idx, a.p, round(avg(b.g), 6) AS mean, round(median(b.g), 6) AS med
    FROM g a JOIN n ON a.hole_id = n.hole_id AND a.segment = n.segment JOIN g b ON a.hole_id = b.hole_id AND a.segment = b.segment AND b.idx BETWEEN a.idx - n.width + 1 AND a.idx
    GROUP BY ALL HAVING count(b.g) = n.width),
z AS (SELECT hole_id, CAST(segment AS BIGINT) AS segment, width, arg_min(p, struct_pack(v := -mean, i := idx)) AS mean_max, arg_min(p, struct_pack(v := mean, i := idx)) AS mean_min,
    arg_min(p, struct_pack(v := -med, i := idx)) AS median_max, arg_min(p, struct_pack(v := med, i := idx)) AS median_min FROM n LEFT JOIN w USING (hole_id, segment, width) GROUP BY 1, 2, 3)"""
PLACES = ("mean_max", "mean_min", "median_max", "median_min")


@query(T + f", {PECKED} SELECT hole_id, segment, width, {', '.join(f'round({x}, 3) AS {x}' for x in PLACES)} FROM z")
def d06_segment_statistics(spark, d):
    """Window of each segment, and where its mean and median gradient are largest and smallest."""
    x = sg.segment_statistics(pecked(spark, d), "torque_a", 0.72)
    return x.select("hole_id", "segment", "width", *(F.round(n, 3).alias(n) for n in PLACES))


def _layers(stat):
    return f"""SELECT hole_id, '{stat}' AS stat, round(a, 3) AS entry, round(b, 3) AS transition, round(c, 3) AS exit, round(CASE WHEN a < b AND b < c THEN c - a END, 3) AS total,
    round(CASE WHEN a < b AND b < c THEN b - a END, 3) AS upper, round(CASE WHEN a < b AND b < c THEN c - b END, 3) AS lower
FROM (SELECT hole_id, max({stat}_max) FILTER (segment = 1) AS a, max({stat}_max) FILTER (segment = 2) AS b, max({stat}_min) FILTER (segment = 2) AS c FROM z GROUP BY 1)"""


@query(T + f", {PECKED} {_layers('mean')} UNION ALL {_layers('median')}")
def d06_layer_depths(spark, d):
    """Total, upper and lower depth from the second and third segment, by mean and by median; null unless in order."""
    x = sg.layer_depths(sg.segment_statistics(pecked(spark, d), "torque_a", 0.72, only=(1, 2)), "mean", "median")
    return x.select("hole_id", "stat", *(F.round(n, 3).alias(n) for n in ("entry", "transition", "exit", "total", "upper", "lower")))


#: Name, first sample, samples and target of the ranges that templates are cut from, in the smallest hole's signal.
RANGES = [("entry", 40, 24, 52), ("transition", 200, 40, 215), ("exit", 420, 16, 430)]


def _ranges(spark, d):
    t = trace(spark, d)
    rows = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("name", "start", "width", "target"), r, strict=True))) for r in RANGES)))
    return t.agg(F.min("hole_id").alias("hole_id")).select("hole_id", rows.alias("r")).select("hole_id", "r.*")


def _matches(spark, d):
    t = trace(spark, d)
    return t, tp.match(t, "torque_a", tp.cut_templates(t, "torque_a", _ranges(spark, d)), valleys=6)


VALUES = ", ".join(f"('{n}', {s}, {m}, {t})" for n, s, m, t in RANGES)
MATCHES = f"""rg AS (SELECT * FROM (VALUES {VALUES}) AS v(name, start, width, target)),
tp AS (SELECT name, width AS m, target - start AS t, idx - start AS j, torque_a AS y, avg(torque_a) OVER q AS mu, stddev_pop(torque_a) OVER q AS sd
    FROM rg JOIN trace ON hole_id = (SELECT min(hole_id) FROM trace) AND idx >= start AND idx < start + width WINDOW q AS (PARTITION BY name)),
pr AS (SELECT hole_id, name, m, t, idx - j AS pl, round(sqrt(greatest(0, 2 * m * (1 - CASE WHEN stddev_pop(torque_a) > 1e-9
    THEN sum((y - mu) / sd * torque_a) / (m * stddev_pop(torque_a)) ELSE 0 END))), 6) AS dist FROM trace, tp WHERE idx >= j GROUP BY hole_id, name, m, t, idx - j HAVING count(*) = m),
be AS (SELECT hole_id, name, min(dist) AS distance, max(dist) AS high, arg_min(pl, struct_pack(d := dist, i := pl)) AS start, arg_min(pl + t, struct_pack(d := dist, i := pl)) AS target
    FROM pr GROUP BY 1, 2),
ru AS (SELECT hole_id, name, run, any_value(dist) AS y FROM (SELECT *, sum(n) OVER (PARTITION BY hole_id, name ORDER BY pl ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT *, CASE WHEN dist = lag(dist) OVER (PARTITION BY hole_id, name ORDER BY pl) THEN 0 ELSE 1 END AS n FROM pr)) GROUP BY 1, 2, 3),
va AS (SELECT r.hole_id, r.name, y, row_number() OVER (PARTITION BY r.hole_id, r.name ORDER BY y) AS k FROM (SELECT *, lag(y) OVER o AS a, lead(y) OVER o AS b FROM ru
    WINDOW o AS (PARTITION BY hole_id, name ORDER BY run)) r JOIN be ON be.hole_id = r.hole_id AND be.name = r.name WHERE y < a AND y < b AND y <= 0.5 * high),
zs AS (SELECT hole_id, name, CASE WHEN stddev_pop(y) FILTER (k > 1) > 1e-12 THEN abs(max(y) FILTER (k = 1) - avg(y) FILTER (k > 1)) / stddev_pop(y) FILTER (k > 1) END AS z
    FROM va WHERE k <= 6 GROUP BY 1, 2),
ma AS (SELECT be.hole_id, be.name, start, target, distance, z, CASE WHEN z > 0 THEN distance / z END AS composite FROM be LEFT JOIN zs ON zs.hole_id = be.hole_id AND zs.name = be.name)"""
RAG = "CASE WHEN {0} < 1.4 THEN 2 WHEN {0} < 1.75 THEN 1 ELSE 0 END"


@query(T + f", {MATCHES} SELECT hole_id, name, start, target, distance, round(z, 4) AS z, round(composite, 4) AS composite, {RAG.format('composite')} AS rag FROM ma")
def j16_template_matches(spark, d):
    """Every template against every signal: best place, target, distance, z against the next valleys, composite and colour."""
    _, m = _matches(spark, d)
    scored = (F.round("z", 4).alias("z"), F.round("composite", 4).alias("composite"), tp.composite_rag(F.col("composite")).alias("rag"))
    return m.select("hole_id", "name", "start", "target", "distance", *scored)


def _layer_sql(k, a, b):
    return f"""SELECT hole_id, {k} AS layer, round(p{b} - p{a}, 3) AS depth, round(CASE WHEN q{a} IS NOT NULL AND q{b} IS NOT NULL THEN greatest(q{a}, q{b}) END, 4) AS quality,
    least({RAG.format(f'q{a}')}, {RAG.format(f'q{b}')}) AS rag FROM po"""


@query(T + f""", {MATCHES}, po AS (SELECT ma.hole_id, {', '.join(f"max(abs(pos_mm)) FILTER (name = '{r[0]}') AS p{i}, max(composite) FILTER (name = '{r[0]}') AS q{i}" for i, r in enumerate(RANGES))}
    FROM ma LEFT JOIN trace ON trace.hole_id = ma.hole_id AND idx = target GROUP BY 1) {_layer_sql(0, 0, 2)} UNION ALL {_layer_sql(1, 0, 1)} UNION ALL {_layer_sql(2, 1, 2)}""")
def d15_layer_quality(spark, d):
    """Depths between matched key points, with the worse composite and colour of both ends; layer 0 is the whole stack."""
    t, m = _matches(spark, d)
    x = tp.stack_depths(tp.target_positions(t, m), [r[0] for r in RANGES])
    return x.select("hole_id", "layer", F.round("depth", 3).alias("depth"), F.round("quality", 4).alias("quality"), "rag")


@query(T + f""", {MATCHES} SELECT ma.hole_id, name, rg.start + ma.target - rg.target AS "begin", string_agg(CAST(CAST(round(torque_a * 10) AS INTEGER) AS VARCHAR), ',' ORDER BY idx) AS segment
FROM ma JOIN rg USING (name) JOIN trace ON trace.hole_id = ma.hole_id AND idx >= rg.start + ma.target - rg.target AND idx < rg.start + ma.target - rg.target + width GROUP BY 1, 2, 3""")
def d16_estimated_segments(spark, d):
    """The ranges of the templates, shifted to the estimated targets of each hole and cut there (values in tenths)."""
    t, m = _matches(spark, d)
    x = tp.estimated_segments(t, "torque_a", _ranges(spark, d).drop("hole_id"), m)
    text = F.transform("segment", lambda y: F.round(y * 10).cast("int").cast("string"))
    return x.select("hole_id", "name", F.col("begin").cast("bigint").alias("begin"), F.array_join(text, ",").alias("segment"))
