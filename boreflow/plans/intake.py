"""Queries of further sources and of message flattening, and of the functions that other queries only use inside."""

from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.operators.places import bounded, places
from boreflow.plans.bindings import MSG, PROGRAM, TRACE, messages, program, table, trace
from boreflow.plans.paths import scratch_path
from boreflow.queries import query
from boreflow.sources import logs
from boreflow.streaming import live

M, T, P = f"WITH {MSG} ", f"WITH {TRACE} ", f"WITH {PROGRAM} "
#: Samples of a message.
PART = 64


def _as_lines(rows, key, order, text, head=()):
    """Rows (file, line, text) of one file for each key: fixed lines, then a line for each row."""
    x = rows.groupBy(F.col(key).cast("string").alias("file")).agg(F.sort_array(F.collect_list(F.struct(*order, text.alias("t")))).alias("x"))
    body = F.transform("x", lambda r: r["t"])
    return x.select("file", F.posexplode(F.concat(F.array(*head) if head else F.array().cast("array<string>"), body)).alias("line", "text"))


@query(T + """SELECT hole_id, idx, round(pos_mm, 6) AS pos_mm, torque_a, CASE hole_id % 3 WHEN 2 THEN thrust_empty_a + 0.5 END AS thrust_empty_a, step::DOUBLE AS step FROM trace""")
def s03_headerless(spark, d):
    """Sample blocks without a header: eight columns, or eleven of which the fifth is a step or not."""
    t = trace(spark, d)
    first, zero = ["pos_mm", "torque_a", "thrust_a", "torque_empty_a"], F.lit("0")
    kind = F.col("hole_id") % 3
    cells = lambda *cs: F.concat_ws("\t", *(F.regexp_replace(x.cast("string"), r"\.", ",") for x in cs))
    four = [F.col(x) for x in first]
    text = (
        F.when(kind == 0, cells(*four, F.col("step"), zero, zero, zero))
        .when(kind == 1, cells(*four, F.col("step"), *[zero] * 6))
        .otherwise(cells(*four, F.col("thrust_empty_a") + 0.5, F.col("step"), *[zero] * 5))
    )
    dealt = t.withColumns({"t": text, "file": F.col("hole_id").cast("string")}).select("file", "idx", "t")
    dealt = bounded(dealt, "file", counted=table(spark, d, "lineitem"))
    x = logs.samples(_as_lines(dealt, "file", ["idx"], F.col("t")))
    return x.select(F.col("file").cast("bigint").alias("hole_id"), "idx", F.round("pos_mm", 6).alias("pos_mm"), "torque_a", "thrust_empty_a", "step")


@query(T + """, h AS (SELECT hole_id, count(*) AS n FROM trace GROUP BY 1) SELECT hole_id, n,
    row_number() OVER (ORDER BY (hole_id % 2)::VARCHAR || hole_id::VARCHAR) - 1 AS hole_num, row_number() OVER (PARTITION BY hole_id % 2 ORDER BY hole_id::VARCHAR) - 1 AS dir_num FROM h""")
def s05_combine_files(spark, d):
    """Logs of two directories as one table, files numbered over all and by directory."""
    path = scratch_path(spark, "combine")
    for k in (0, 1):
        one = trace(spark, d).where(F.col("hole_id") % 2 == k).groupBy("hole_id").agg(F.collect_list(F.concat_ws("\t", "pos_mm", "torque_a")).alias("x"))
        text = F.concat(F.lit("*** Datas ***\nPosition (mm)\tI Torque (A)\n"), F.array_join("x", "\n"))
        logs.write_texts(one.select(F.concat(F.lit("h"), F.col("hole_id")).alias("hole"), text.alias("value")), f"{path}/dir={k}", "hole")
    lines = logs.log_lines(spark, path)  # a file stands in a folder of its hole, which is taken for its name
    x = logs.combine(lines.withColumn("file", F.regexp_extract("file", r"^(.*)/[^/]+$", 1)), scratch_path(spark, "files"))
    hole = F.regexp_extract("file", r"hole=h(\d+)", 1).cast("bigint")
    return x.groupBy(hole.alias("hole_id"), "hole_num", F.col("dir_num").cast("bigint").alias("dir_num")).agg(F.count("*").alias("n"))


def _fasteners(spark, d):
    """Curves written as text files: four lines of facts, a header, and rows of which each fifth lacks its label."""
    path, h = scratch_path(spark, "fasteners"), F.col("hole_id")
    head = F.concat(
        F.lit("Curve of "), F.lpad((h % 28 + 1).cast("string"), 2, "0"), F.lit("/02/24 10:11:12\nmachine\nStatus "), F.when(h % 3 == 0, "NOK").otherwise("OK"),
        F.lit("\nTrigger torque: "), (h / 4).cast("string"), F.lit(" Nm\tAngle\nAngle\tTorque\n"),
    )
    line = F.concat(F.when(F.col("idx") % 5 == 0, "").otherwise(F.concat(F.lit("P"), F.col("step"), F.lit("\t"))), F.col("idx"), F.lit("\t"), F.col("torque_a"))
    x = trace(spark, d).groupBy("hole_id").agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("t")))).alias("x"))
    text = F.concat(head, F.array_join(F.transform("x", lambda r: r["t"]), "\n"))
    logs.write_texts(x.select(h.alias("hole"), text.alias("value")), path, "hole")
    return logs.log_lines(spark, path)


@query(T + """SELECT hole_id, idx, CASE WHEN idx % 5 > 0 THEN 'P' || step END AS label, idx::DOUBLE AS angle, torque_a AS torque FROM trace""")
def s12_fastener_curves(spark, d):
    x = logs.fastener_curves(_fasteners(spark, d), ["Angle", "Torque"])
    return x.select(logs.hole_of("file").alias("hole_id"), "idx", "label", F.col("Angle").alias("angle"), F.col("Torque").alias("torque"))


@query(T + """SELECT DISTINCT hole_id, hole_id % 28 + 1 AS day, hole_id % 3 <> 0 AS ok, hole_id / 4 AS trigger_nm FROM trace""")
def s13_fastener_facts(spark, d):
    x = logs.fastener_facts(_fasteners(spark, d))
    return x.select(logs.hole_of("file").alias("hole_id"), F.dayofmonth("created").cast("bigint").alias("day"), "ok", "trigger_nm")


@query("""SELECT s_suppkey::VARCHAR AS folder, CASE WHEN s_suppkey % 5 = 0 THEN 'trace times differ' WHEN s_suppkey % 7 = 0 THEN 'no heads message' END AS error,
    CASE WHEN s_suppkey % 5 > 0 AND s_suppkey % 7 > 0 THEN '2024-01-01T00:00:' || lpad((s_suppkey % 60)::VARCHAR, 2, '0') || 'Z' END AS ts FROM supplier""")
def s15_message_triples(spark, d):
    """Result, trace and heads of a folder, whose source times must agree."""
    path, k = scratch_path(spark, "triples"), F.col("s_suppkey")
    time = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("Z"))
    value = lambda ts: F.struct(F.array(k, k).alias("Value"), ts.alias("SourceTimestamp"))
    text = lambda b: F.to_json(F.struct(F.struct(F.struct(value(time).alias("x.A"), value(b).alias("x.B")).alias("Payload")).alias("Messages")))
    late = F.when(k % 5 == 0, "2024-01-02T00:00:00Z").otherwise(time)
    kinds = [("ResultManagement", time), ("Trace", late), ("Heads", time)]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), text(b).alias("value")) for n, b in kinds))).alias("r")
    x = table(spark, d, "supplier").select(k.alias("k"), rows).select(F.concat(F.lit("f"), "k").alias("folder"), "r.kind", "r.value", "k")
    groups = logs.write_messages(x.where("kind <> 'Heads' or k % 7 > 0"), path)
    found = logs.grouped_triples(spark, groups, scratch_path(spark, "found"), "folder", "error", "ts")
    return found.select(F.regexp_extract("folder", r"(\d+)", 1).alias("folder"), "error", "ts")


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'click' THEN 'trace' ELSE 'heads' END AS kind FROM events
WHERE event_type IN ('purchase', 'click', 'view') AND event_id % 7 > 0""")
def s16_topic_stream(spark, d):
    """The events as a stream of (topic, value, ts), of which those under one root and three topics are taken."""
    ev = live.read_events(spark, d)
    tail = F.when(F.col("event_type") == "purchase", "ResultManagement").when(F.col("event_type") == "click", "ResultManagement/Trace")
    tail = tail.when(F.col("event_type") == "view", "AssetManagement/Heads").otherwise("Other")
    root = F.when(F.col("event_id") % 7 > 0, "plant").otherwise("lab")
    topic = c.result_topic(root, F.lit("box"), F.concat(F.lit("tool"), F.col("user_id")), tail)
    x = live.topic_messages(ev.select("event_id", topic.alias("topic"), "value", "ts"), "plant")
    return live.run_once(x.select("event_id", "kind"), scratch_path(spark, "s16"))


@query(T + """SELECT row_number() OVER (ORDER BY (hole_id * 7919) % 100003, hole_id) AS place, hole_id FROM (SELECT DISTINCT hole_id FROM trace)""")
def t02_sort_by_date(spark, d):
    """Logs in the order of the date in their head, of two forms."""
    h = F.col("hole_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + (h * 7919) % 100003 * 60)
    text = F.when(h % 2 == 0, F.date_format(ts, "yyyy-MM-dd:HH:mm:ss")).otherwise(F.date_format(ts, "dd/MM/yy : hh:mm a"))
    rows = trace(spark, d).select("hole_id").distinct().select("hole_id", F.lit(1).alias("n"), text.alias("t"))
    lines = _as_lines(rows, "hole_id", ["n"], F.concat(F.lit("Date\t"), "t"), [F.lit("*** General Infos ***"), F.lit("Version 1999-1-1")])
    dated = logs.write_dates(lines).withColumn("hole_id", F.col("file").cast("bigint"))
    return places(dated, ["written", "hole_id"], scratch_path(spark, "dates")).select("place", "hole_id")


@query(T + "SELECT hole_id AS HOLE_ID, torque_a AS i_torque, step, round(-pos_mm, 4) AS xpos, idx AS local FROM trace")
def p05_required_columns(spark, d):
    t = trace(spark, d).select("hole_id", F.col("torque_a").alias("I Torque (A)"), F.col("step").alias("Step (nb)"), (-F.col("pos_mm")).alias("Position (mm)"), F.col("idx").alias("local"), "thrust_a")
    names = {"I Torque (A)": "i_torque", "Step (nb)": "step", "Position (mm)": "xpos", "hole_id": "HOLE_ID"}
    return logs.required_columns(t, names, ["HOLE_ID", "i_torque", "step", "xpos", "local"]).withColumn("xpos", F.round("xpos", 4))


@query(P + """SELECT program_id, step, name, value FROM (SELECT program_id, step, 'Thrust Max (A)' AS name, stroke AS value FROM program WHERE "on"
    UNION ALL SELECT program_id, step, 'thrust min', feed FROM program WHERE "on")""")
def p17_program_search(spark, d):
    """Columns of programs whose name contains a key, of steps in use."""
    p = program(spark, d)
    text = F.concat_ws("\t", "step", F.col("on").cast("int"), "stroke", "rpm", "feed")
    head = [F.lit("*** Program ***"), F.lit("Step Nb\tStep On/Off\tThrust Max (A)\tRPM\tthrust min")]
    cells = logs.sections(_as_lines(p, "program_id", ["step"], text, head))
    step = cells.where("name = 'Step Nb'").select("file", "section", "row", F.col("value").cast("int").alias("step"))
    x = logs.program_values(cells, "Thrust").join(step, ["file", "section", "row"])
    return x.select(F.col("file").cast("bigint").alias("program_id"), "step", "name", F.col("value").cast("double").alias("value"))


@query(T + "SELECT hole_id, idx, torque_a AS torque, round(-pos_mm, 4) AS position FROM trace")
def p23_vendor_columns(spark, d):
    """Torque and position of two makers' frames in one table."""
    t = trace(spark, d)
    a = t.where("hole_id % 2 = 0").withColumnsRenamed({"torque_a": "I Torque (A)", "pos_mm": "Position (mm)"})
    b = t.where("hole_id % 2 <> 0").withColumns({"filtered": F.lit(0.0)}).withColumnsRenamed({"torque_a": "unfiltered", "pos_mm": "distance"})
    out = None
    for df in (a, b):
        torque, position = logs.torque_and_position(df)
        x = df.select("hole_id", "idx", F.col(torque).alias("torque"), F.round(-F.col(position), 4).alias("position"))
        out = x if out is None else out.union(x)
    return out


def _parts(spark, d):
    """Samples of each hole in parts of a message: (hole_id, part, x)."""
    item = F.struct("idx", "pos_mm", "torque_a", "torque_empty_a", "thrust_empty_a", "step")
    return trace(spark, d).groupBy("hole_id", F.floor(F.col("idx") / PART).alias("part")).agg(F.sort_array(F.collect_list(item)).alias("x"))


def _message(**values):
    """A payload with a value for each dotted key; null values are left out."""
    of = lambda v: F.struct(v.alias("Value"), F.lit("t").alias("SourceTimestamp"))
    fields = [F.when(v.isNotNull(), of(v)).alias("Unit." + k.replace("_", ".")) for k, v in values.items()]
    return F.to_json(F.struct(F.struct(F.struct(*fields).alias("Payload")).alias("Messages")))


@query(T + """SELECT hole_id::VARCHAR AS hole_id, idx // 64 AS part, CAST(idx % 64 AS INTEGER) AS pos, step, torque_empty_a AS torque_empty, thrust_empty_a AS thrust_empty,
    CAST(hole_id * 10 AS INTEGER) AS local, 1 AS predrilled FROM trace""")
def f10_flatten_result(spark, d):
    """Arrays of a result message to rows, with its ids."""
    x = F.col("x")
    m = _parts(spark, d).select("part", _message(
        Step_Nb=x["step"], Torque_Empty=x["torque_empty_a"], Thrust_Empty=x["thrust_empty_a"], Machine_ID=F.col("hole_id").cast("string"), Result_ID=F.col("hole_id") * 10,
    ).alias("payload"))
    f = c.flatten_result(F.col("payload"), {"step": "Step", "torque_empty": "Torque.Empty", "thrust_empty": "Thrust.Empty", "machine_id": "Machine.ID", "result_id": "Result.ID"})
    rows = m.select("part", c.parsed(f)).select("part", "f.hole_id", "f.local", "f.predrilled", F.posexplode("f.rows").alias("pos", "r"))
    return rows.select("hole_id", "part", "pos", "r.step", "r.torque_empty", "r.thrust_empty", "local", "predrilled")


@query(T + """SELECT CASE WHEN idx // 64 % 4 = 0 THEN 'UNKNOWN' ELSE hole_id::VARCHAR END AS hole_id, hole_id AS of, idx // 64 AS part, CAST(idx % 64 AS INTEGER) AS pos, round(-pos_mm, 4) AS position,
    torque_a AS torque, CASE WHEN idx // 64 % 4 <> 1 THEN torque_empty_a END AS torque_empty, CASE WHEN idx // 64 % 4 = 2 THEN 0 ELSE 7 END AS local, CASE WHEN idx // 64 % 4 = 3 THEN 1 ELSE 0 END AS predrilled FROM trace""")
def f12_flatten_raw(spark, d):
    """Raw messages by exact keys; each fourth lacks one and gets the default."""
    x, k = F.col("x"), F.col("part") % 4
    m = _parts(spark, d).select("hole_id", "part", _message(
        SerialNumber=F.when(k != 0, F.col("hole_id").cast("string")), Position=x["pos_mm"], Torque=x["torque_a"], TorqueEmpty=F.when(k != 1, x["torque_empty_a"]),
        StepNb=x["step"], ToolAge=F.when(k != 2, F.lit(7)), Predrilled=F.when(k != 3, F.lit(0)),
    ).alias("payload"))
    keys = {"hole_id": "SerialNumber", "position": "Position", "torque": "Torque", "torque_empty": "TorqueEmpty", "step": "StepNb", "local": "ToolAge", "predrilled": "Predrilled"}
    f = c.flatten_raw(F.col("payload"), {n: f"Unit.{v}" for n, v in keys.items()})
    done = m.select(F.col("hole_id").alias("of"), "part", c.parsed(f))
    rows = done.select("of", "part", "f.hole_id", "f.local", "f.predrilled", F.posexplode("f.rows").alias("pos", "r"))
    return rows.select("hole_id", "of", "part", "pos", F.round("r.position", 4).alias("position"), "r.torque", "r.torque_empty", "local", "predrilled")


@query(T + """, n AS (SELECT hole_id, idx // 64 AS part, count(*) AS n FROM trace GROUP BY 1, 2)
SELECT hole_id, idx, 'H' || hole_id AS serial, CASE WHEN n = 64 THEN (idx % 64)::VARCHAR ELSE '[' || array_to_string(range(64), ',') || ']' END AS temps FROM trace JOIN n ON n.hole_id = trace.hole_id AND n.part = idx // 64""".replace("SELECT hole_id, idx, 'H' || hole_id", "SELECT trace.hole_id, idx, 'H' || trace.hole_id"))
def f13_heads_enrichment(spark, d):
    """Fields of a heads message on each row of a frame: a list of its length by row, all else repeated."""
    t = trace(spark, d).withColumn("part", F.floor(F.col("idx") / PART))
    n = t.groupBy("hole_id", "part").agg(F.count("*").alias("n"))
    temps = F.sequence(F.lit(0), F.lit(PART - 1))
    heads = n.select("hole_id", "part", "n", F.to_json(F.struct(F.concat(F.lit("H"), "hole_id").alias("serial"), temps.alias("temps"))).alias("heads"))
    m = heads.select("hole_id", "part", "n", F.from_json("heads", "map<string,string>").alias("m"))
    fields = m.select("hole_id", "part", *(c.heads_field(F.col("m")[k], F.col("n")).alias(k) for k in ("serial", "temps")))  # once for each message
    x = t.join(fields, ["hole_id", "part"])
    return x.select("hole_id", "idx", *(c.heads_value(F.col(k), F.col("idx") % PART).alias(k) for k in ("serial", "temps")))


# functions that other queries use inside


@query(T + "SELECT hole_id, idx, round(torque_a + torque_empty_a, 4) AS torque, round(thrust_a + thrust_empty_a, 4) AS thrust FROM trace")
def p04_total_signals(spark, d):
    total = lambda s: F.round(F.col(f"{s}_a") + F.col(f"{s}_empty_a"), 4).alias(s)
    return trace(spark, d).select("hole_id", "idx", total("torque"), total("thrust"))


@query(M + """SELECT event_id, kind = 'trace' AS is_trace, kind = 'result' AND event_id % 3 > 0 AS is_result FROM msg""")
def p07_exact_topics(spark, d):
    """Exact suffixes; each third topic has a part more or too few."""
    t = F.when(F.col("event_id") % 3 > 0, F.col("topic")).when(F.col("kind") == "result", F.concat("topic", F.lit("/More"))).otherwise(F.col("topic"))
    return messages(spark, d).select("event_id", c.is_exact_topic(t, "ResultManagement/Trace").alias("is_trace"), c.is_exact_topic(t, "ResultManagement").alias("is_result"))


@query(M + "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 'box' || tool % 3 || '/tool' || tool END AS tool_key FROM msg")
def p08_tool_keys(spark, d):
    t = F.when(F.col("event_id") % 4 > 0, F.col("topic")).when(F.col("event_id") % 8 == 0, "plant/box")
    return messages(spark, d).select("event_id", c.tool_key(t).alias("tool_key"))


@query(T + """SELECT hole_id, part, n AS n_step, n - CASE WHEN part % 3 = 0 THEN n // 2 ELSE 0 END AS n_torque, part % 3 = 0 AND n // 2 > 0 AS mismatch, part % 3 = 0 AND n // 2 > 10 AS warn
FROM (SELECT hole_id, idx // 64 AS part, count(*) AS n FROM trace GROUP BY 1, 2)""")
def p12_array_lengths(spark, d):
    """Lengths of the arrays of a message against each other; a difference over ten is a warning."""
    x = _parts(spark, d).select("hole_id", "part", F.col("x.step").alias("step"), F.col("x.torque_a").alias("torque"))
    half = F.slice("torque", F.lit(1), (F.size("torque") - F.floor(F.size("torque") / 2)).cast("int"))
    x = x.withColumn("torque", F.when(F.col("part") % 3 == 0, half).otherwise(F.col("torque")))
    off = F.abs(F.size("step") - F.size("torque"))
    return x.select("hole_id", "part", F.size("step").cast("bigint").alias("n_step"), F.size("torque").cast("bigint").alias("n_torque"), (off > 0).alias("mismatch"), (off > 10).alias("warn"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing_message' WHEN 1 THEN 'empty_data' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'invalid_structure' ELSE 'unknown' END AS category FROM events""")
def p14_failure_categories(spark, d):
    k = F.col("event_id") % 6
    said = F.when(k == 0, "Missing result message").when(k == 1, "data is EMPTY").when(k == 2, "no valid JSON").when(k == 3, "no Messages.Payload").when(k == 4, "late")
    return table(spark, d, "events").select("event_id", F.coalesce(c.failure_category(said), F.lit("unknown")).alias("category"))


@query("SELECT o_orderkey, 'H' || o_custkey AS head, CAST(o_custkey AS INTEGER) AS global_count, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderkey AS INTEGER) END AS local_count FROM orders")
def f02_filename_parts(spark, d):
    last = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey").cast("string")).otherwise("x")
    name = F.concat(F.lit("/a/b_c/E00_H"), "o_custkey", F.lit("_ST_"), "o_custkey", F.lit("_"), last, F.lit(".xls"))
    parts = c.filename_parts(name)
    return table(spark, d, "orders").select("o_orderkey", *(parts[k].alias(k) for k in ("head", "global_count", "local_count")))


@query(M + "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN coalesce(k::VARCHAR, '') END AS value, 'q \"w\", [1,2]' AS text FROM msg")
def f07_dotted_path(spark, d):
    """Paths with array indices; each third message lacks the entry."""
    item = F.struct(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("C"))
    items = F.when(F.col("event_id") % 3 > 0, F.array(F.struct(F.lit("x").alias("C")), item)).otherwise(F.array(F.struct(F.lit("x").alias("C"))))
    text = F.to_json(F.struct(F.struct(items.alias("B"), F.lit('q "w", [1,2]').alias("D")).alias("A")))
    return messages(spark, d).select("event_id", c.json_path(text, "A.B.1.C").alias("value"), c.json_path(text, "A.D").alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'field_' || p_size || '_mm' WHEN 1 THEN 'a_b_c' || p_size ELSE 'size' || p_size END AS name FROM part")
def f09_clean_keys(spark, d):
    k = F.col("p_partkey") % 3
    key = F.when(k == 0, F.concat(F.lit("X."), "p_size", F.lit(" mm"))).when(k == 1, F.concat(F.lit("Y.A-b/(C)"), "p_size")).otherwise(F.concat(F.lit("Size#"), "p_size"))
    return table(spark, d, "part").select("p_partkey", c.clean_key(key).alias("name"))


@query(P + "SELECT program_id, step, round(stroke / (feed * rpm / 60 / 100)) AS samples FROM program")
def f18_mm_to_samples(spark, d):
    return program(spark, d).select("program_id", "step", c.mm_to_samples(F.col("stroke"), F.col("feed"), F.col("rpm")).alias("samples"))


@query("SELECT p_partkey, CASE WHEN p_size / 20 < 1.4 THEN 2 WHEN p_size / 20 < 1.75 THEN 1 ELSE 0 END AS rag FROM part")
def f20_rag(spark, d):
    return table(spark, d, "part").select("p_partkey", c.rag(F.col("p_size") / 20).alias("rag"))


@query("SELECT p_partkey, least(p_size::DOUBLE, 40 - p_size, p_retailprice / 50, 30 - p_retailprice / 50) AS edge FROM part")
def f23_edge_distance(spark, d):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice") / 50
    return table(spark, d, "part").select("p_partkey", c.edge_distance(x, y, F.lit(40.0), F.lit(30.0)).alias("edge"))


@query("SELECT s_suppkey, 'plant/box' || s_nationkey || '/' || s_name || '/Estimation/Keypoints' AS topic FROM supplier")
def f24_result_topics(spark, d):
    toolbox = F.concat(F.lit("box"), "s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", c.result_topic(F.lit("plant"), toolbox, F.col("s_name"), F.lit("Estimation/Keypoints")).alias("topic"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN (p_size - 1)::VARCHAR ELSE (p_size - 1) || ',' || (p_size * p_size - p_size) END AS depths FROM part""")
def d11_depths(spark, d):
    """Successive differences of one, two or three key points."""
    s = F.col("p_size")
    points = F.slice(F.array(F.lit(1), s, s * s), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(c.depths_of(points).cast("array<string>"), ",").alias("depths"))
