"""Scalar functions on columns: numbers, file names, topics, payloads, grip lengths, codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a grip unit (mm) and the two thresholds of a remainder (fixed values).
GRIP_UNIT, GRIP_LOW, GRIP_HIGH = 1.5875, 0.396875, 1.42875


def decimal_comma(c: Column, dots: str = "") -> Column:
    """The last comma is the decimal mark; earlier ones go, or become ``dots``. Null where it is no number."""
    tail = F.substring_index(c, ",", -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail) - 1)
    joined = F.concat(F.replace(head, F.lit(","), F.lit(dots)), F.lit("."), tail)
    return F.when(F.contains(c, F.lit(",")), joined).otherwise(c).try_cast("double")


def filename_parts(name: Column) -> dict[str, Column]:
    """coupon, head, global and local counters of ``<serial>_<head>_ST_<global>_<local>.xls``."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[^.]*$", ""), "_")
    return {
        "head": F.try_element_at(parts, F.lit(2)),
        "global_count": F.try_element_at(parts, F.lit(-2)).try_cast("int"),
        "local_count": F.try_element_at(parts, F.lit(-1)).try_cast("int"),
    }


def is_air_run(name: Column) -> Column:
    """The last three parts of the file name are all numbers."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 2), 3)
    return (F.size(parts) >= 3) & F.forall(last, lambda x: x.rlike("^[0-9]+$"))


def firmware(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"V\s[1-9]\.[0-9.]*[0-9]", 0), F.lit(""))


def iso_to_epoch(c: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).cast("double")


def epoch_to_iso(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payload_map(payload: Column) -> Column:
    """Dotted keys to their Value as text, from a message payload."""
    parsed = F.from_json(payload, "struct<Messages:struct<Payload:map<string,struct<Value:string,SourceTimestamp:string>>>>")
    return F.transform_values(parsed["Messages"]["Payload"], lambda k, v: v["Value"])


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def parsed(fields: dict[str, Column]) -> Column:
    """Fields of a message as one struct ``f``: selected before its rows are exploded, they are not found anew for each row."""
    return F.struct(*(v.alias(k) for k, v in fields.items())).alias("f")


def lookup_containing(m: Column, key: str) -> Column:
    """Value of the first entry whose key contains ``key``."""
    return F.get(F.map_values(F.map_filter(m, lambda k, v: F.contains(k, F.lit(key)))), F.lit(0))


def json_path(c: Column, dotted: str) -> Column:
    """Value at a dotted path with array indices, as text."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))
    return F.get_json_object(c, "$" + steps)


def nesting(json: Column) -> Column:
    """A bound of how deep a JSON text is nested: its opening brackets, and the top."""
    return F.char_length(json) - F.char_length(F.translate(json, "{[", "")) + 1


def find_values(json: Column, key: str) -> Column:
    """All values under a key at any depth of a JSON text, as text; what is no JSON has none.

    Objects and arrays are walked level by level on the parsed value, as many levels as the text has opening brackets; in a level
    the keys of an object are taken in their order by name. A list or object that is found comes as JSON.
    """
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    none = F.array().cast("array<variant>")
    below = lambda v: F.coalesce(F.map_values(as_map(v)), as_list(v), none)
    hit = lambda v: F.coalesce(F.map_values(F.map_filter(as_map(v), lambda k, x: k == key)), none)
    start = F.coalesce(F.array(F.try_parse_json(json)), none)
    step = lambda s, i: F.struct(
        F.flatten(F.transform(s["at"], below)).alias("at"), F.concat(s["found"], F.flatten(F.transform(s["at"], hit))).alias("found")
    )
    walked = F.aggregate(F.sequence(F.lit(1), F.coalesce(nesting(json), F.lit(1))), F.struct(start.alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.transform(walked, lambda v: F.try_variant_get(v, "$", "string"))


def clean_key(key: Column) -> Column:
    """Last dotted part in lower case, ``field_`` before a digit."""
    last = F.element_at(F.split(key, r"\."), -1)
    plain = F.lower(F.regexp_replace(F.regexp_replace(last, r"[ \-/]", "_"), r"[^A-Za-z0-9_]", ""))
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("field_"), plain)).otherwise(plain)


def canonical_numbers(values: Column, digits: int = 10) -> Column:
    """A hash that is the same for number lists equal within the rounding."""
    return F.xxhash64(F.array_join(F.transform(values, lambda x: F.round(x, digits).cast("string")), ","))


def grip_lengths(depth: Column, unit: float = GRIP_UNIT, low: float = GRIP_LOW, high: float = GRIP_HIGH) -> dict[str, Column]:
    """Three candidate grip lengths of a depth."""
    q, r = F.floor(depth / unit), F.pmod(depth, F.lit(unit))
    third = F.when(r < low, 0).when(r > high, 2).otherwise(1)
    return {"quotient": q, "remainder": r, "d1": q + 1, "d2": q + (r > high).cast("int"), "d3": q + third}


def torque_nm(current: Column, volts: float = 48.0, efficiency: float = 0.75, rpm: float = 6000.0) -> Column:
    return current * volts * efficiency / (rpm * 2 * F.pi() / 60)


def mm_to_samples(mm: Column, feed: Column, rpm: Column, rate: float = 100.0) -> Column:
    return F.round(mm / (feed * rpm / 60 / rate))


def rag(value: Column, green: float = 1.4, amber: float = 1.75) -> Column:
    """2 green, 1 amber, 0 red."""
    return F.when(value < green, 2).when(value < amber, 1).otherwise(0)


def edge_distance(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.least(x, width - x, y, height - y)


def result_topic(root: Column, toolbox: Column, tool: Column, endpoint: Column) -> Column:
    return F.concat_ws("/", root, toolbox, tool, endpoint)


def topic_kind(topic: Column) -> Column:
    """Trace is tested before result, whose suffix it contains."""
    return (
        F.when(F.contains(topic, F.lit("ResultManagement/Trace")), "trace")
        .when(F.contains(topic, F.lit("ResultManagement")), "result")
        .when(F.contains(topic, F.lit("AssetManagement/Head")), "heads")
    )


def is_exact_topic(topic: Column, suffix: str) -> Column:
    """Four parts or more, of which those from the fourth on are the suffix."""
    parts = F.split(topic, "/")
    return (F.size(parts) >= 4) & (F.array_join(F.slice(parts, F.lit(4), F.size(parts)), "/") == suffix)


def tool_key(topic: Column) -> Column:
    parts = F.split(topic, "/")
    return F.when(F.size(parts) >= 3, F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))


def valid_tool_id(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & ~c.rlike("[+#/\\x00]"), F.lit(False))


def normal_head_id(ids: Column) -> Column:
    return F.nullif(F.trim(F.get(ids, F.lit(0))), F.lit(""))


def failure_category(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(F.contains(t, F.lit("missing")), "missing_message")
        .when(F.contains(t, F.lit("empty")), "empty_data")
        .when(F.contains(t, F.lit("json")), "invalid_json")
        .when(F.contains(t, F.lit("structure")) | F.contains(t, F.lit("payload")), "invalid_structure")
        .otherwise("unknown")
    )


def route(success: Column, error: Column, keypoints: Column, depths: Column) -> Column:
    """Where a result goes: error, insufficient, suppressed (a negative depth) or success."""
    return (
        F.when(~success | error.isNotNull(), "error")
        .when(keypoints.isNull() | depths.isNull(), "insufficient")
        .when(F.exists(depths, lambda d: d < 0), "suppressed")
        .otherwise("success")
    )


def depths_of(keypoints: Column) -> Column:
    """Successive differences."""
    n = F.size(keypoints)
    return F.zip_with(
        F.slice(keypoints, 2, F.greatest(n - 1, F.lit(0))), F.slice(keypoints, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a
    )


def flatten_result(payload: Column, keys: dict[str, str]) -> dict[str, Column]:
    """Columns of a result message: arrays of step and empty signals as ``rows``, and the ids.

    ``keys`` gives a part of the dotted key for step, torque_empty, thrust_empty, machine_id and result_id. A step that is no
    list counts as a list of one.
    """
    found = once(payload_map(payload), lambda m: F.struct(*(lookup_containing(m, part).alias(k) for k, part in keys.items())))
    numbers = lambda k: F.from_json(found[k], "array<double>")
    step = found["step"]
    steps = F.coalesce(F.when(F.startswith(step, F.lit("[")), F.from_json(step, "array<int>")), F.array(step.try_cast("int")))
    rows = F.arrays_zip(steps.alias("step"), numbers("torque_empty").alias("torque_empty"), numbers("thrust_empty").alias("thrust_empty"))
    return {
        "rows": rows, "hole_id": found["machine_id"], "local": found["result_id"].try_cast("int"), "predrilled": F.lit(1),
    }


def flatten_raw(payload: Column, keys: dict[str, str]) -> dict[str, Column]:
    """Columns of a raw message by exact keys: samples as ``rows``, positions negated, and ids with their defaults.

    Missing: hole 'UNKNOWN', local 0, predrilled 1, an array without values. A message that is no JSON is one without keys.
    """
    known = F.coalesce(payload_map(payload), F.create_map().cast("map<string,string>"))
    found = once(known, lambda m: F.struct(*(F.try_element_at(m, F.lit(key)).alias(k) for k, key in keys.items())))
    text = lambda k: found[k]
    numbers = lambda k: F.coalesce(F.from_json(text(k), "array<double>"), F.array().cast("array<double>"))
    names = ("position", "torque", "torque_empty", "step")
    arrays = {k: numbers(k) for k in names}
    arrays["position"] = F.transform(arrays["position"], lambda x: -x)
    return {
        "rows": F.arrays_zip(*(arrays[k].alias(k) for k in names)), "hole_id": F.coalesce(text("hole_id"), F.lit("UNKNOWN")),
        "local": F.coalesce(text("local").try_cast("int"), F.lit(0)), "predrilled": F.coalesce(text("predrilled").try_cast("int"), F.lit(1)),
    }


def heads_field(value: Column, n: Column) -> Column:
    """A heads field for a frame of n rows: its items if it is an array as long as the frame, else its text."""
    items = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>"))
    return once(items, lambda x: F.struct(F.when(F.size(x) == n, x).alias("items"), F.when(F.coalesce(F.size(x) != n, F.lit(True)), value).alias("text")))


def heads_value(field: Column, idx: Column) -> Column:
    """Value of a heads field for one row: an array as long as the frame gives its element, all else is repeated as text."""
    return F.when(field["items"].isNotNull(), F.get(field["items"], idx.cast("int"))).otherwise(field["text"])


def message_error(payload: Column, name: str) -> Column:
    """First error of one message: no content, no JSON, no object, no ``Messages.Payload``; null if it is valid."""
    inside = lambda v: F.try_variant_get(F.try_variant_get(v, "$.Messages", "variant"), "$.Payload", "variant")
    wrong = lambda v: (
        F.when(v.isNull(), f"Invalid JSON in {name.lower()} message")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), f"{name} message data is not a valid dictionary")
        .when(inside(v).isNull(), f"{name} message missing required Messages.Payload structure")
    )
    return F.when(F.trim(payload) == "", f"{name} message has no data content").otherwise(once(F.try_parse_json(payload), wrong))


def pair_error(result: Column, trace: Column) -> Column:
    """First error of a pair: what is missing or empty on either side, then the result's structure, then the trace's."""
    empty = lambda c, n: F.when(F.trim(c) == "", f"{n} message has no data content")
    return F.coalesce(
        F.when(result.isNull(), "Missing required result message"), F.when(trace.isNull(), "Missing required trace message"),
        empty(result, "Result"), empty(trace, "Trace"), message_error(result, "Result"), message_error(trace, "Trace"),
    )


def apart(a: Column, b: Column, seconds: float = 30.0) -> Column:
    """Whether two messages lie further apart than that; a warning, no error."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) > int(seconds * 1e6)


LEAF = "array<struct<path:string,v:variant>>"


def leaves(json: Column) -> Column:
    """Scalars of a JSON text with their paths, ordered by path: structs (path, text, number); empty objects and lists count too.

    ``text`` is the value as text, or what kind of empty value it is; ``number`` is set for numbers only.
    """
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    none = F.array().cast(LEAF)

    def below(x: Column) -> Column:
        named = F.transform(F.map_entries(as_map(x["v"])), lambda e: F.struct(F.concat(x["path"], F.lit("."), F.to_json(F.array(e["key"]))).alias("path"), e["value"].alias("v")))
        listed = F.transform(as_list(x["v"]), lambda v, i: F.struct(F.concat(x["path"], F.lit("#"), i.cast("string")).alias("path"), v.alias("v")))
        return F.coalesce(named, listed, none)

    ends = lambda at: F.filter(at, lambda x: F.size(below(x)) == 0)
    step = lambda s, i: F.struct(F.flatten(F.transform(s["at"], below)).alias("at"), F.concat(s["found"], ends(s["at"])).alias("found"))
    start = F.coalesce(F.transform(F.array(F.try_parse_json(json)), lambda v: F.struct(F.lit("$").alias("path"), v.alias("v"))), none)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.coalesce(nesting(json), F.lit(1))), F.struct(start.alias("at"), none.alias("found")), step, lambda s: s["found"]
    )
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    kind = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.schema_of_variant(v))
    return F.array_sort(F.transform(walked, lambda x: F.struct(x["path"].alias("path"), kind(x["v"]).alias("text"), number(x["v"]).alias("number"))))


def deep_equal(a: Column, b: Column, tolerance: float = 1e-10) -> Column:
    """Whether two lists of :func:`leaves` have the same paths, numbers closer than the tolerance, and otherwise equal texts.

    A number equals no text that reads like it.
    """
    same = lambda x, y: (x["path"] == y["path"]) & F.when(
        x["number"].isNotNull() & y["number"].isNotNull(), F.abs(x["number"] - y["number"]) < tolerance
    ).otherwise(x["number"].isNull() & y["number"].isNull() & (x["text"] == y["text"]))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, same), lambda ok: F.coalesce(ok, F.lit(False)))


def processed(topic: Column, payload: Column, prefix: str, kind: str = "type", key: str = "id") -> dict[str, Column]:
    """(type, key, data) of a message: the topic without its prefix and the payload's fields; what is no JSON object comes as raw text.

    Type and key are ``unknown`` where the payload has none. ``data`` is JSON with the shortened topic as ``_topic``.
    """
    short = F.when(F.startswith(topic, F.lit(prefix)), F.substring(topic, F.lit(len(prefix) + 1), F.length(topic))).otherwise(topic)
    fields = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    text = lambda name: F.coalesce(F.try_variant_get(F.try_element_at(fields, F.lit(name)), "$", "string"), F.lit("unknown"))
    own = F.transform_values(F.coalesce(fields, F.create_map().cast("map<string,variant>")), lambda k, v: F.to_json(v))
    body = F.array_join(F.transform(F.map_entries(own), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    about = F.concat(F.lit('"_topic":'), F.regexp_extract(F.to_json(F.array(short)), r"(?s)^\[(.*)\]$", 1))
    raw = F.concat(F.lit('"raw":'), F.regexp_extract(F.to_json(F.array(payload)), r"(?s)^\[(.*)\]$", 1))
    data = F.when(fields.isNull(), F.concat(F.lit("{"), raw, F.lit(","), about, F.lit("}")))
    data = data.otherwise(F.concat(F.lit("{"), body, F.when(body == "", "").otherwise(","), about, F.lit("}")))
    return {"type": text(kind), "key": text(key), "data": data}


def exact_code(code: Column, names: dict[int, str]) -> Column:
    """Name of the code that a value is exactly; null for any other, combinations of flags included."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code.cast("int"))
