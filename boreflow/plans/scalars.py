"""Queries of scalar functions, validation and text sources."""

from pyspark.sql import functions as F

from boreflow.functions import columns as c
from boreflow.plans.bindings import MSG, PROGRAM, TRACE, messages, program, table, trace
from boreflow.plans.paths import scratch_path
from boreflow.queries import query
from boreflow.sources import logs


M, T, P = f"WITH {MSG} ", f"WITH {TRACE} ", f"WITH {PROGRAM} "


def _logs(spark, d):
    path = scratch_path(spark, "logs")
    logs.write_logs(trace(spark, d), path)
    return logs.log_lines(spark, path)


@query(T + "SELECT hole_id, idx, round(pos_mm, 6) AS pos_mm, torque_a, thrust_a, torque_empty_a, thrust_empty_a, step::DOUBLE AS step FROM trace")
def s01_log_samples(spark, d):
    """Logs written from the trace view, read back: decimal commas, header found by name."""
    x = logs.samples(_logs(spark, d))
    return x.select(logs.hole_of("file").alias("hole_id"), "idx", F.round("pos_mm", 6).alias("pos_mm"), *list(logs.SAMPLE_COLUMNS.values())[1:])


@query(T + """, h AS (SELECT DISTINCT hole_id FROM trace) SELECT hole_id, 'Head Name' AS name, 'H' || hole_id AS value FROM h
UNION ALL SELECT hole_id, 'Head Global Counter', (hole_id * 7)::VARCHAR FROM h UNION ALL SELECT hole_id, 'Head Local Counter 1', (hole_id % 10)::VARCHAR FROM h""")
def s02_log_sections(spark, d):
    cells = logs.sections(_logs(spark, d)).where("section = 'Head Datas'")
    return cells.select(logs.hole_of("file").alias("hole_id"), "name", "value")


@query(T + "SELECT DISTINCT hole_id, (hole_id * 7)::VARCHAR AS global_count FROM trace")
def s04_field_lookup(spark, d):
    x = logs.first_values(_logs(spark, d), "Head Global Counter")
    return x.select(logs.hole_of("file").alias("hole_id"), F.col("Head Global Counter").alias("global_count"))


@query(T + "SELECT hole_id, 'H' || hole_id AS head, count(*) AS n, round(max(torque_a), 4) AS high FROM trace GROUP BY 1")
def s06_ingest(spark, d):
    """Samples of a directory of logs joined to their metadata."""
    lines = _logs(spark, d)
    meta = logs.first_values(lines, "Head Name").withColumnRenamed("Head Name", "head")
    x = logs.samples(lines).groupBy("file").agg(F.count("*").alias("n"), F.round(F.max("torque_a"), 4).alias("high")).join(meta, "file")
    return x.select(logs.hole_of("file").alias("hole_id"), "head", "n", "high")


@query(T + "SELECT hole_id, count(*) AS n, round(sum(torque_a), 4) AS total, round(arg_min(torque_a, idx), 4) AS first FROM trace GROUP BY 1")
def s07_row_per_file(spark, d):
    """Columns as arrays in sample order."""
    x = trace(spark, d).groupBy("hole_id").agg(F.sort_array(F.collect_list(F.struct("idx", "torque_a"))).alias("x"))
    x = x.select("hole_id", F.transform("x", lambda s: s["torque_a"]).alias("torque"))
    total = F.aggregate("torque", F.lit(0.0), lambda s, v: s + v)
    return x.select("hole_id", F.size("torque").cast("bigint").alias("n"), F.round(total, 4).alias("total"), F.round(F.col("torque")[0], 4).alias("first"))


@query(T + "SELECT hole_id, idx, torque_a, thrust_a FROM trace")
def s08_explode_files(spark, d):
    s = F.sort_array(F.collect_list(F.struct("idx", "torque_a", "thrust_a")))
    x = trace(spark, d).groupBy("hole_id").agg(s.alias("x"))
    return x.select("hole_id", F.posexplode("x").alias("idx", "s")).select("hole_id", F.col("idx").cast("bigint").alias("idx"), "s.torque_a", "s.thrust_a")


@query(P + "SELECT program_id::VARCHAR AS hole, step, feed, rpm FROM program")
def s09_nested_json(spark, d):
    """Programs written as JSON inside JSON, a line for each, read back in step order."""
    p = program(spark, d).groupBy("program_id").agg(F.collect_list(F.struct("step", "feed", "rpm")).alias("x"))
    path = scratch_path(spark, "programs")
    p.select(F.to_json(F.struct(F.col("program_id").cast("string").alias("hole"), F.to_json("x").alias("program"))).alias("value")).write.text(path)
    return logs.nested_program(spark, path, multi_line=False)


@query(T + "SELECT 'torque' || hole_id AS name, idx::INTEGER AS idx, torque_a AS value FROM trace")
def s10_force_plate(spark, d):
    t = trace(spark, d).groupBy("hole_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("torque_a").cast("string").alias("v")))).alias("x"))
    path = scratch_path(spark, "plate")
    t.select(F.concat(F.lit("torque"), F.col("hole_id"), F.lit("\t100\t"), F.array_join(F.transform("x", lambda x: x["v"]), "\t"))).write.text(path)
    return logs.variables(logs.log_lines(spark, path)).select("name", "idx", "value")


@query(M + """SELECT tool, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY tool)) / 1e6, 6) AS offset_s, value AS current FROM msg""")
def s11_power_csv(spark, d):
    m = messages(spark, d).groupBy("tool").agg(
        F.sort_array(F.collect_list(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(";"), F.regexp_replace(F.col("value").cast("string"), r"\.", ",")))).alias("x")
    )
    path = scratch_path(spark, "power")
    text = F.concat(F.lit("x\n" * 13), F.array_join("x", "\n"))
    m.select("tool", text.alias("value")).write.partitionBy("tool").text(path)
    p = logs.power_csv(spark, path)
    return p.select(F.regexp_extract("file", r"tool=(\d+)", 1).cast("bigint").alias("tool"), F.round("offset_s", 6).alias("offset_s"), "current")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, 'HOLE' AS hole_id, 1 AS predrilled FROM supplier")
def s14_cycle_csv(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("header", True).option("sep", ";").csv(path)
    return logs.cycle_csv(spark, path, hole_id="HOLE", predrilled=1)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def s19_parquet_repack(spark, d):
    path = scratch_path(spark, "repack")
    table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey").write.partitionBy("s_nationkey").parquet(path)
    return spark.read.parquet(path).select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def s20_csv_dump(spark, d):
    path = scratch_path(spark, "dump")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(path)
    return spark.read.option("header", True).csv(path)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'no section' ELSE 'no sample header' END AS error FROM supplier WHERE s_suppkey % 3 < 2")
def s21_bad_files(spark, d):
    path = scratch_path(spark, "bad")
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, "junk").when(k == 1, "*** A ***\nB\n1").otherwise("*** A ***\nPosition (mm)\n1")
    logs.write_texts(table(spark, d, "supplier").select(F.col("s_suppkey").alias("hole"), text.alias("value")), path, "hole")
    return logs.bad_files(logs.log_lines(spark, path)).select(logs.hole_of("file").alias("id"), "error")


# projections and validation


@query("SELECT s_suppkey AS Step_nb, s_acctbal AS Position_mm FROM supplier")
def p01_clean_names(spark, d):
    return logs.clean_names(table(spark, d, "supplier").select(F.col("s_suppkey").alias("Step (nb)"), F.col("s_acctbal").alias("Position (mm)"))).toDF("Step_nb", "Position_mm")


@query("SELECT p_partkey::INTEGER AS p_partkey, p_size::DOUBLE AS p_size, p_name FROM part")
def p02_cast_by_schema(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    return logs.cast_by_schema(p, {"p_missing": "int"}, {"p_partkey": "int", "p_size": "double"})


@query(T + """SELECT hole_id, idx, round(CASE WHEN sum(CASE WHEN idx < 200 THEN pos_mm ELSE 0 END) OVER (PARTITION BY hole_id) < 0 THEN -pos_mm ELSE pos_mm END, 4) AS pos,
    round(torque_a + torque_empty_a, 4) AS torque, round(thrust_a + thrust_empty_a, 4) AS thrust FROM trace""")
def p03_normal_signals(spark, d):
    """Positions flipped where the first 200 samples are negative, and total signals (P04)."""
    from pyspark.sql import Window

    low = F.sum(F.when(F.col("idx") < 200, F.col("pos_mm")).otherwise(0.0)).over(Window.partitionBy("hole_id")) < 0
    return trace(spark, d).select(
        "hole_id", "idx", F.round(F.when(low, -F.col("pos_mm")).otherwise(F.col("pos_mm")), 4).alias("pos"),
        F.round(F.col("torque_a") + F.col("torque_empty_a"), 4).alias("torque"), F.round(F.col("thrust_a") + F.col("thrust_empty_a"), 4).alias("thrust"),
    )


@query(M + """SELECT event_id, kind, 'box' || tool % 3 || '/tool' || tool AS tool_key, kind = 'trace' AS exact_trace, kind = 'result' AS exact_result FROM msg""")
def p06_topics(spark, d):
    """Kind by containment, exact suffixes (P07) and the tool key (P08)."""
    t = F.col("topic")
    return messages(spark, d).select(
        "event_id", c.topic_kind(t).alias("kind"), c.tool_key(t).alias("tool_key"),
        c.is_exact_topic(t, "ResultManagement/Trace").alias("exact_trace"), c.is_exact_topic(t, "ResultManagement").alias("exact_result"),
    )


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS valid FROM supplier")
def p09_valid_tool_ids(spark, d):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, "").when(k == 1, F.col("s_name").substr(1, 8)).when(k == 2, "a/b")
    return table(spark, d, "supplier").select("s_suppkey", c.valid_tool_id(name).alias("valid"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid json' WHEN 2 THEN 'invalid structure' END AS error,
    CASE event_id % 4 WHEN 0 THEN 'missing_message' WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_structure' ELSE 'unknown' END AS category FROM events""")
def p10_message_validation(spark, d):
    """First error of each message and its category (P14)."""
    k = F.col("event_id") % 4
    raw = F.when(k == 1, "{ not json").when(k == 2, F.col("props")).when(k == 3, F.concat(F.lit('{"Messages":{"Payload":{"a":{"Value":"'), k, F.lit('"}}}}')))
    ev = table(spark, d, "events").select("event_id", raw.alias("raw"))
    error = (
        F.when(F.col("raw").isNull(), "missing")
        .when(F.expr("try_parse_json(raw)").isNull(), "invalid json")
        .when(F.get_json_object("raw", "$.Messages.Payload").isNull(), "invalid structure")
    )
    return ev.select("event_id", error.alias("error")).withColumn("category", F.coalesce(c.failure_category(F.col("error")), F.lit("unknown")))


@query(T + """SELECT hole_id, count(*) > 0 AND min(idx) = 0 AND count(DISTINCT step) > 3 AS valid, count(*) FILTER (thrust_a > 0) AS n_thrust, abs(count(*) - count(*) FILTER (thrust_a > 0)) > 60 AS warn
FROM trace GROUP BY 1""")
def p11_frame_validation(spark, d):
    """Frame flags, and lengths of the signals against each other (P12)."""
    full, part = F.count("torque_a"), F.count_if(F.col("thrust_a") > 0)
    valid = (F.min("idx") == 0) & (F.count_distinct("step") > 3)
    return trace(spark, d).groupBy("hole_id").agg(valid.alias("valid"), part.alias("n_thrust"), (F.abs(full - part) > 60).alias("warn"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN NULL ELSE s_name END AS head_id FROM supplier")
def p13_head_ids(spark, d):
    k = F.col("s_suppkey") % 3
    ids = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("  "))).otherwise(F.array(F.concat(F.lit(" "), "s_name"), F.lit("x")))
    return table(spark, d, "supplier").select("s_suppkey", c.normal_head_id(ids).alias("head_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 5 = 1 THEN 'insufficient' WHEN o_orderkey % 5 = 2 AND o_totalprice > 1 THEN 'suppressed'
    ELSE 'success' END AS route FROM orders""")
def p15_result_routing(spark, d):
    k = F.col("o_orderkey") % 5
    points = F.when(k != 1, F.array(F.lit(0.0), F.when(k == 2, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))))
    route = c.route(k != 0, F.lit(None).cast("string"), points, c.depths_of(points))
    return table(spark, d, "orders").select("o_orderkey", route.alias("route"))


@query(P + 'SELECT program_id, step, stroke FROM program WHERE "on"')
def p16_active_steps(spark, d):
    return program(spark, d).where("on").select("program_id", "step", "stroke")


@query(P + """SELECT program_id, step, string_agg(trigger || '=' || floor(value)::INTEGER, ',' ORDER BY trigger) AS triggers FROM
    (SELECT program_id, step, unnest(['delay', 'rpm', 'stroke']) AS trigger, unnest([delay, rpm, stroke]) AS value FROM program) WHERE value > 10 GROUP BY 1, 2""")
def p18_program_triggers(spark, d):
    x = program(spark, d).unpivot(["program_id", "step"], ["delay", "rpm", "stroke"], "trigger", "value").where("value > 10")
    text = F.concat(F.col("trigger"), F.lit("="), F.col("value").cast("int"))
    return x.groupBy("program_id", "step").agg(F.array_join(F.sort_array(F.collect_list(text)), ",").alias("triggers"))


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND p_name LIKE '%ring%'")
def p19_condition_filters(spark, d):
    return table(spark, d, "part").where((F.col("p_type") == "ECONOMY") & F.contains("p_name", F.lit("ring"))).select("p_partkey", "p_name")


FILE = "'H' || s_suppkey || '_Box_ST_' || s_suppkey * 7 || '_' || s_suppkey % 10 || '.xls'"


def _names(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("H"), "s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "_12_").otherwise("_ST_"), F.col("s_suppkey") * 7, F.lit("_"), F.col("s_suppkey") % 10, F.lit(".xls"))
    return s.select("s_suppkey", name.alias("name"))


@query("""SELECT s_suppkey, s_suppkey % 4 = 0 AS air, (s_suppkey * 7)::INTEGER AS global_count, (s_suppkey % 10)::INTEGER AS local_count FROM supplier""")
def p20_air_runs(spark, d):
    """Air runs by file name, and the counters in the name (F02)."""
    parts = c.filename_parts(F.col("name"))
    return _names(spark, d).select("s_suppkey", c.is_air_run(F.col("name")).alias("air"), parts["global_count"].alias("global_count"), parts["local_count"].alias("local_count"))


@query(T + """, f AS (SELECT hole_id, min(idx) AS cut FROM trace WHERE torque_a >= 4.9 GROUP BY 1)
SELECT t.hole_id, count(*) AS n FROM trace t LEFT JOIN f USING (hole_id) WHERE cut IS NULL OR idx < cut GROUP BY 1""")
def p21_sheet_tail(spark, d):
    """Rows before the first one that ends the sheet."""
    from pyspark.sql import Window

    cut = F.min(F.when(F.col("torque_a") >= 4.9, F.col("idx"))).over(Window.partitionBy("hole_id"))
    t = trace(spark, d).withColumn("cut", cut).where("cut is null or idx < cut")
    return t.groupBy("hole_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size / 25 < 1.4 THEN 2 WHEN p_size / 25 < 1.75 THEN 1 ELSE 0 END AS rag FROM part WHERE p_size / 25 < 1.75")
def p22_without_red(spark, d):
    """Quality colour (F20); red ones go."""
    p = table(spark, d, "part").select("p_partkey", c.rag(F.col("p_size") / 25).alias("rag"))
    return p.where("rag <> 0")


# scalar functions


@query("SELECT p_partkey, p_retailprice AS number, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 1234.5::DOUBLE END AS other FROM part")
def f01_decimal_comma(spark, d):
    text = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    return table(spark, d, "part").select("p_partkey", c.decimal_comma(text).alias("number"), c.decimal_comma(F.when(F.col("p_partkey") % 2 == 0, "x,y").otherwise("1,234,5")).alias("other"))


@query("SELECT s_suppkey, 'V 3.2.' || (s_suppkey % 9 + 1) AS firmware FROM supplier")
def f03_firmware(spark, d):
    line = F.concat(F.lit("release V 3.2."), F.col("s_suppkey") % 9 + 1, F.lit(" of box"))
    return table(spark, d, "supplier").select("s_suppkey", c.firmware(line).alias("firmware"))


@query(M + "SELECT event_id, (epoch_us(ts) // 1000000)::DOUBLE AS epoch, strftime(to_timestamp(epoch_us(ts) // 1000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS iso FROM msg")
def f04_timestamps(spark, d):
    m = messages(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"))
    m = m.withColumn("epoch", c.iso_to_epoch(F.col("text")))
    return m.select("event_id", "epoch", c.epoch_to_iso(F.col("epoch")).alias("iso"))


@query(M + "SELECT event_id, tool::VARCHAR AS machine, coalesce(k::VARCHAR, '') AS count, coalesce(k::VARCHAR, '') AS by_path FROM msg")
def f05_payload_lookup(spark, d):
    """By a part of the key (F05), and by a dotted path (F07) on a nested copy."""
    m = messages(spark, d).withColumn("m", c.payload_map(F.col("payload")))
    nested = F.concat(F.lit('{"A":{"B":[{"C":"'), c.lookup_containing(F.col("m"), "Count"), F.lit('"}]}}'))
    return m.select("event_id", c.lookup_containing(F.col("m"), "Machine").alias("machine"), c.lookup_containing(F.col("m"), "Count").alias("count"), c.json_path(nested, "A.B.0.C").alias("by_path"))


@query(M + """SELECT event_id, 3 + (k IS NOT NULL)::INTEGER AS n, '[1,2]|' || tool || '|' || coalesce(k || '|', '') || 'x, "y" z' AS found FROM msg""")
def f06_find_key(spark, d):
    """All values of a key: a list at the top, a number below it, and others inside a list, with quotes and commas."""
    item = lambda value, no=None: F.struct(value.cast("string").alias("Value"), F.lit(no).cast("string").alias("no"))
    deep = F.array(item(F.col("k")), item(F.lit('x, "y" z')), item(F.lit(None), "Value"))
    doc = F.to_json(F.struct(F.struct(deep.alias("L"), F.col("tool").alias("Value")).alias("A"), F.array(F.lit(1), F.lit(2)).alias("Value")))
    found = c.find_values(doc, "Value")
    return messages(spark, d).select("event_id", F.size(found).alias("n"), F.array_join(found, "|").alias("found"))


@query(M + "SELECT event_id, 'id' AS name, tool::VARCHAR AS value FROM msg UNION ALL SELECT event_id, 'count', coalesce(k::VARCHAR, '') FROM msg")
def f08_flatten_payload(spark, d):
    """Each key of a payload under its cleaned name (F09)."""
    x = messages(spark, d).select("event_id", F.explode(c.payload_map(F.col("payload"))).alias("key", "value"))
    return x.select("event_id", c.clean_key(F.col("key")).alias("name"), "value")


@query(T + "SELECT hole_id, idx::INTEGER AS idx, round(-pos_mm, 4) AS position, torque_a AS torque, step, 1 AS predrilled FROM trace")
def f11_flatten_trace(spark, d):
    """Arrays of trace messages, 64 samples each, back to samples, positions negated."""
    part = F.floor(F.col("idx") / 64).alias("part")
    t = trace(spark, d).groupBy("hole_id", part).agg(F.sort_array(F.collect_list(F.struct("idx", "pos_mm", "torque_a", "step"))).alias("x"))
    arrays = [F.col(f"x.{n}").alias(n) for n in ("pos_mm", "torque_a", "step")]
    m = t.select("hole_id", "part", *arrays)
    x = m.select("hole_id", "part", F.posexplode(F.arrays_zip("pos_mm", "torque_a", "step")).alias("pos", "s"))
    idx = (F.col("part") * 64 + F.col("pos")).cast("int").alias("idx")
    return x.select("hole_id", idx, F.round(-F.col("s.pos_mm"), 4).alias("position"), F.col("s.torque_a").alias("torque"), "s.step", F.lit(1).alias("predrilled"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_retailprice = b.p_retailprice AND a.p_partkey < b.p_partkey")
def f14_deep_equality(spark, d):
    """Pairs of parts whose numbers agree within the rounding."""
    h = c.canonical_numbers(F.array(F.col("p_size").cast("double"), "p_retailprice"))
    p = table(spark, d, "part").select("p_partkey", h.alias("h"))
    return p.toDF("a", "h").join(p.toDF("b", "h"), "h").where("a < b").select("a", "b")


@query("SELECT p_partkey, unnest(list_filter([1, 2, 4, 8, 16, 32], lambda x: p_size & x <> 0)) AS flag FROM part")
def f15_code_flags(spark, d):
    flags = F.filter(F.array(*(F.lit(1 << i) for i in range(6))), lambda x: F.col("p_size").bitwiseAND(x) != 0)
    return table(spark, d, "part").select("p_partkey", F.explode(flags).alias("flag"))


@query("""SELECT p_partkey, floor(x / 1.5875)::BIGINT AS quotient, floor(x / 1.5875)::BIGINT + 1 AS d1, floor(x / 1.5875)::BIGINT + (r > 1.42875)::INTEGER AS d2,
    floor(x / 1.5875)::BIGINT + CASE WHEN r < 0.396875 THEN 0 WHEN r > 1.42875 THEN 2 ELSE 1 END AS d3 FROM (SELECT p_partkey, p_size / 1.1 AS x, fmod(p_size / 1.1, 1.5875) AS r FROM part)""")
def f16_grip_lengths(spark, d):
    g = c.grip_lengths(F.col("p_size") / 1.1)
    return table(spark, d, "part").select("p_partkey", *(g[n].cast("bigint").alias(n) for n in ("quotient", "d1", "d2", "d3")))


@query(T + "SELECT hole_id, idx, round(torque_a * 48 * 0.75 / (6000 * 2 * pi() / 60), 6) AS nm, round(2.0 / (0.4 * 3000 / 60 / 100)) AS samples FROM trace")
def f17_torque_nm(spark, d):
    n = c.mm_to_samples(F.lit(2.0), F.lit(0.4), F.lit(3000.0))
    return trace(spark, d).select("hole_id", "idx", F.round(c.torque_nm(F.col("torque_a")), 6).alias("nm"), n.alias("samples"))


@query(P + """SELECT program_id, step, round(sum(stroke) OVER o, 4) AS position, round(sum(stroke / feed) OVER o, 4) AS time FROM program WINDOW o AS (PARTITION BY program_id ORDER BY step)""")
def f19_ideal_breakpoints(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("program_id").orderBy("step")
    return program(spark, d).select("program_id", "step", F.round(F.sum("stroke").over(o), 4).alias("position"), F.round(F.sum(F.col("stroke") / F.col("feed")).over(o), 4).alias("time"))


@query("SELECT p_partkey, 1::BIGINT << (dense_rank() OVER (ORDER BY p_type) - 1) AS code FROM part")
def f21_category_bits(spark, d):
    """One bit for each category; the categories are few and numbered by themselves."""
    from pyspark.sql import Window

    p = table(spark, d, "part")
    kinds = p.select("p_type").distinct().withColumn("r", F.dense_rank().over(Window.orderBy("p_type")))
    return p.join(kinds, "p_type").select("p_partkey", F.expr("shiftleft(1L, r - 1)").alias("code"))


@query("SELECT p_partkey, round(p_partkey * 0.034::DOUBLE - 1.7, 4) AS local, CASE p_size % 2 WHEN 0 THEN -1.45::DOUBLE ELSE 0.69::DOUBLE END AS predrilled, least(p_size, 60 - p_size, p_size * 2, 120 - p_size * 2) AS edge FROM part")
def f22_affine_maps(spark, d):
    """Affine feature maps, and the distance to a plate's edge (F23)."""
    p, s = table(spark, d, "part"), F.col("p_size")
    pre = F.when(s % 2 == 0, -1.45).otherwise(0.69)
    return p.select("p_partkey", F.round(F.col("p_partkey") * 0.034 - 1.7, 4).alias("local"), pre.alias("predrilled"), c.edge_distance(s, s * 2, F.lit(60), F.lit(120)).alias("edge"))
