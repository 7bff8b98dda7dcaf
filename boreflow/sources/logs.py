"""Text sources and sinks of drilling data: cycle logs in sections, force-plate text, power and cycle CSV, messages."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boreflow.functions.columns import decimal_comma, find_values
from boreflow.operators.places import places, spread

#: Column names of the sample block and their short names (fixed values of the file format).
SAMPLE_COLUMNS = {
    "Position (mm)": "pos_mm", "I Torque (A)": "torque_a", "I Thrust (A)": "thrust_a", "I Torque Empty (A)": "torque_empty_a",
    "I Thrust Empty (A)": "thrust_empty_a", "Step (nb)": "step",
}
#: Columns of blocks without a header (fixed values of the file format): what all have, and what follows by number of columns.
_FIRST = ["Position (mm)", "I Torque (A)", "I Thrust (A)", "I Torque Empty (A)"]
_MEMORY = ["Step (nb)", "Stop code", "Mem Torque min (A)", "Mem Thrust min (A)"]
HEADERLESS = {
    "8": _FIRST + _MEMORY,
    "11 with a step": [*_FIRST, *_MEMORY, "Rotation Speed (rpm)", "Feed Speed (mm/s)", "Drive Temperature (deg C)"],
    "11": [*_FIRST, "I Thrust Empty (A)", *_MEMORY, "Torque Power (W)", "Gap Length (mm)"],
    "6": list(SAMPLE_COLUMNS),
}

#: Files that a task writes, or a group of folders holds, at most, in the mean.
FILES = 1000
#: Groups of folders at least: Spark lists more than 32 paths by a task for each. Groups that are listed at a time at most.
GROUPS, LISTED = 64, 100


def write_texts(df: DataFrame, path: str, *by: str) -> None:
    """A folder for each value of some columns with the text in ``value``; many tasks write, and each puts its own files in place.

    Rows that are few bytes may be many files, so the files and not the bytes decide how many tasks there are.
    """
    dealt = spread(df, *by, least=-(-df.count() // FILES))
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*by).text(path)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as ``open`` knows it where the path is in the local file system (which executors share by a mount), else nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_messages(df: DataFrame, path: str) -> list[str]:
    """The message files of many folders, from rows (folder, kind, value), a line for each row; gives the groups of folders.

    Spark's writer starts several processes for each file and folder of a local file system, which cost far more than the few
    bytes that are written; there, tasks open ``group=<n>/folder=<folder>/<kind>.json`` themselves. Any other store is written by
    Spark, with a folder for each kind. A group is listed by one task, where each folder would be one.
    """
    spark, count = df.sparkSession, df.count()
    group = F.pmod(F.xxhash64("folder"), F.lit(max(GROUPS, -(-count // FILES)))).alias("group")
    rows, local = df.select(group, "folder", "kind", "value"), local_folder(spark, path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (n, folder, kind), values in groupby(lines, key=lambda r: r[:3]):
            folder, name = f"folder={folder or '__HIVE_DEFAULT_PARTITION__'}", f"{kind}.json"  # as Spark names them
            if "/" in folder + name:
                raise ValueError(f"no names of files: {folder}, {name}")
            at = f"{local}/group={n}/{folder}"
            os.makedirs(at, exist_ok=True)
            mine = f"{at}/.{name}-{TaskContext.get().taskAttemptId()}"  # not listed; what is listed is whole
            with open(mine, "wb") as f:
                f.writelines(f"{r[3] or ''}\n".encode() for r in values)
            os.replace(mine, f"{at}/{name}")
        return iter(())

    if local is None:
        write_texts(rows, path, "group", "folder", "kind")
    else:
        os.makedirs(local, exist_ok=True)
        dealt = spread(rows, "folder", least=-(-count // FILES)).sortWithinPartitions("folder", "kind")
        dealt.mapInArrow(put, "n bigint").write.format("noop").mode("overwrite").save()
    return [f"{path}/group={r.group}" for r in rows.select("group").distinct().sort("group").collect()] or [path]


def log_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Rows (file, line, text) of all logs under a path; lines count from 0, empty ones are left out.

    A file is read in pieces like any text source, so a long one is not one row. Where a line stands follows from its piece's
    offset and its order there; the windows over the file's lines that follow share this shuffle. It has more tasks for more pieces,
    so that a task holds no more of a larger folder.
    """
    at = "_metadata.file_block_start", F.monotonically_increasing_id()
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col(at[0]).alias("_piece"), at[1].alias("_at"), F.col("value").cast("binary").alias("_raw"))
    raw = spread(raw, "file", least=raw.rdd.getNumPartitions() // 4)
    line = (F.row_number().over(Window.partitionBy("file").orderBy("_piece", "_at")) - 1).cast("int")
    lines = raw.select("file", line.alias("line"), F.decode("_raw", encoding).alias("text"))
    return lines.where(F.length("text") > 0)


def sections(lines: DataFrame, separator: str = r"[\t;]") -> DataFrame:
    """Long table (file, section, row, col, name, value): a ``***`` line opens a section, the next line is its header."""
    w = Window.partitionBy("file").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.startswith("text", F.lit("***")), F.trim(F.regexp_replace("text", r"\*", "")))
    x = lines.withColumn("_open", opens).withColumn("section", F.last("_open", True).over(upto))
    x = x.withColumn("_at", F.last(F.when(F.col("_open").isNotNull(), F.col("line")), True).over(upto))
    x = x.where(F.col("_open").isNull() & F.col("section").isNotNull()).withColumn("cells", F.split("text", separator))
    head = Window.partitionBy("file", "_at").orderBy("line")
    x = x.withColumns({"row": F.row_number().over(head) - 1, "names": F.first("cells").over(head)}).where("row > 0")
    cells = x.select("file", "section", "row", F.posexplode(F.arrays_zip("names", "cells")).alias("col", "c"))
    return cells.select("file", "section", "row", "col", F.trim("c.names").alias("name"), F.trim("c.cells").alias("value"))


def lookup(cells: DataFrame, name: str) -> DataFrame:
    """First value under an exactly named column of each file."""
    return cells.where((F.col("name") == name) & (F.col("row") == 1)).select("file", F.col("value").alias(name))


def first_values(lines: DataFrame, name: str, separator: str = r"[\t;]") -> DataFrame:
    """The rows of ``lookup`` in the ``sections`` of the lines, cut out of the two lines that follow a section's opening only."""
    w = Window.partitionBy("file").orderBy("line")
    x = lines.withColumns({"_open": F.lag("text", 2).over(w), "_head": F.lag("text", 1).over(w)})
    opens = lambda c: F.startswith(c, F.lit("***"))
    x = x.where(opens("_open") & ~opens("_head") & ~opens("text"))
    x = x.select("file", F.explode(F.arrays_zip(F.split("_head", separator).alias("names"), F.split("text", separator).alias("cells"))).alias("c"))
    return x.where(F.trim("c.names") == name).select("file", F.trim("c.cells").alias(name))


def headerless_names(cells: Column, fifth_is_whole: Column) -> Column:
    """Column names by the number of cells; of eleven, the fifth is the step where it is a whole number throughout."""
    kind = F.when((F.size(cells) == 11) & fifth_is_whole, "11 with a step").otherwise(F.size(cells).cast("string"))
    names = F.lit(None).cast("array<string>")
    for k, n in HEADERLESS.items():
        names = F.when(kind == k, F.array(*map(F.lit, n))).otherwise(names)
    more = F.array_repeat(F.lit("Unknown"), F.greatest(F.size(cells) - len(_FIRST), F.lit(0)))
    return F.coalesce(names, F.slice(F.concat(F.array(*map(F.lit, _FIRST)), more), F.lit(1), F.size(cells)))


def samples(lines: DataFrame, columns: dict[str, str] = SAMPLE_COLUMNS, separator: str = r"[\t;]") -> DataFrame:
    """The sample block of each log as numbers: (file, idx, ...). Without a header line the column count decides.

    Header, column kinds and sample numbers come from windows over the file's lines, which share one shuffle. Where a column
    stands is found once in the header line, so that lines carry a few numbers and not the header.
    """
    whole, order = Window.partitionBy("file"), Window.partitionBy("file").orderBy("line")
    places_in = lambda names: F.array(*(F.array_position(names, n) for n in columns))
    head = F.when(F.startswith("text", F.lit("Position (mm)")), F.struct("line", places_in(F.split("text", separator)).alias("at")))
    x = lines.withColumn("h", F.min(head).over(whole))
    x = x.where(F.col("h").isNull() | (F.col("line") > F.col("h.line"))).where(~F.startswith("text", F.lit("***")))
    x = x.withColumn("cells", F.split("text", separator))
    fifth = decimal_comma(F.get("cells", F.lit(4)))
    x = x.withColumn("w", F.min(F.coalesce(fifth == F.floor(fifth), F.lit(False))).over(whole))
    at = F.coalesce(F.col("h.at"), places_in(headerless_names(F.col("cells"), F.col("w"))))
    x = x.select("file", "cells", at.alias("at"), (F.row_number().over(order) - 1).cast("bigint").alias("idx"))
    value = lambda i: decimal_comma(F.get("cells", (F.col("at")[i] - 1).cast("int")))
    return x.select("file", "idx", *(value(i).alias(s) for i, s in enumerate(columns.values())))


def combine(lines: DataFrame, path: str) -> DataFrame:
    """Samples of many files with ``hole_num`` over all files and ``dir_num`` inside the folder above, in path order from 0.

    ``path`` is a new scratch folder.
    """
    files = places(lines.select("file").distinct(), ["file"], path, "hole_num")
    folder = F.regexp_extract("file", r"^(.*)/[^/]+$", 1)
    files = files.withColumn("dir_num", F.row_number().over(Window.partitionBy(folder).orderBy("file")) - 1)
    return samples(lines).join(files.withColumn("hole_num", F.col("hole_num") - 1), "file")


#: Forms of the date in the head of a log: what may be one, and how it reads; whether it is a date the parser decides.
WRITE_DATES = (
    (r"\d+-\d+-\d+:\d+:\d+:\d+", "yyyy-M-d:H:m:s"),
    (r"\d+/\d+/\d+\s*:\s*\d+:\d+\s*\w+", "dd/MM/yy : hh:mm a"),
)


def write_dates(lines: DataFrame) -> DataFrame:
    """Rows (file, written): the first date in each file, of either form; files without one are left out."""
    found = F.lit(None).cast("timestamp")
    for pattern, form in reversed(WRITE_DATES):
        text = F.regexp_replace(F.regexp_extract("text", pattern, 0), r"\s+", " ")
        found = F.coalesce(F.try_to_timestamp(text, F.lit(form)), found)
    x = lines.withColumn("written", found).where("written is not null")
    return x.groupBy("file").agg(F.min_by("written", "line").alias("written"))


def fastener_curves(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated curves behind four lines and a header: (file, idx, label, ...); rows may lack the label."""
    x = lines.withColumn("cells", F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), "\t"))
    x = x.withColumn("names", F.min(F.when(F.col("line") == 4, F.col("cells"))).over(Window.partitionBy("file"))).where("line > 4")
    labelled = F.size("cells") > F.size("names")
    x = x.withColumns({"label": F.when(labelled, F.col("cells")[0]), "shift": labelled.cast("int")})
    idx = (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).cast("bigint")
    value = lambda n: F.get("cells", (F.array_position("names", n) - 1 + F.col("shift")).cast("int")).try_cast("double")
    return x.select("file", idx.alias("idx"), "label", *(value(n).alias(n) for n in columns))


def fastener_facts(lines: DataFrame) -> DataFrame:
    """Rows (file, created, ok, trigger_nm) from the first four lines of fastener curves."""
    at = lambda n, c: F.max(F.when(F.col("line") == n, c))
    text = F.trim("text")
    created = F.try_to_timestamp(F.regexp_extract(text, r"(\S+ \S+)$", 1), F.lit("dd/MM/yy HH:mm:ss"))
    trigger = F.regexp_extract(text, r"Trigger torque: ([^\t]*?)(?: Nm.*)?(?:\t.*)?$", 1).try_cast("double")
    ok = F.element_at(F.split(text, " "), -1) == "OK"
    return lines.where("line < 4").groupBy("file").agg(at(0, created).alias("created"), at(2, ok).alias("ok"), at(3, trigger).alias("trigger_nm"))


def program_values(cells: DataFrame, key: str | None = None, switch: str = "Step On/Off") -> DataFrame:
    """Cells of ``sections`` whose column name contains the key (case does not matter; none takes all), of steps in use."""
    rows = cells.where((F.col("name") == switch) & (F.col("value").try_cast("double") != 0)).select("file", "section", "row")
    found = cells if key is None else cells.where(F.contains(F.lower("name"), F.lit(key.lower())))
    return found.join(rows, ["file", "section", "row"], "left_semi")


def message_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows (folder, result, trace, heads, ts, error): the three message files of each folder and the time they share.

    An error says which message is missing, or has source times that are not all the same.
    """
    name = r"/([^/]+)/(?:kind=)?(ResultManagement|Trace|Heads)(?:\.json|/[^/]*)$"
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    raw = raw.select(F.regexp_extract("file", name, 1).alias("folder"), F.regexp_extract("file", name, 2).alias("kind"), "value")
    raw = raw.where("kind <> ''").withColumn("times", F.array_distinct(find_values(F.col("value"), "SourceTimestamp")))
    kinds = {"result": "ResultManagement", "trace": "Trace", "heads": "Heads"}
    of = lambda c: [F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{n}") for n, k in kinds.items()]
    x = raw.groupBy("folder").agg(*of("value"), *of("times"))
    error = F.lit(None).cast("string")
    for n in reversed(kinds):
        bad = F.size(f"times_{n}") != 1
        error = F.when(F.col(f"value_{n}").isNull(), f"no {n} message").when(bad, f"{n} times differ").otherwise(error)
    ts = F.when(error.isNull(), F.col("times_result")[0])
    return x.select("folder", *(F.col(f"value_{n}").alias(n) for n in kinds), ts.alias("ts"), error.alias("error"))


def grouped_triples(spark: SparkSession, groups: list[str], path: str, *columns: str) -> DataFrame:
    """Columns of the ``message_triples`` of many groups of folders; a folder is in one group.

    Spark's driver holds the list of all files that a table is read from, so no more than ``LISTED`` groups are read at a time and
    their rows written to ``path``, a new scratch folder.
    """
    if len(groups) <= LISTED:
        return message_triples(spark, groups).select(*columns)
    for i in range(0, len(groups), LISTED):
        found = message_triples(spark, groups[i : i + LISTED]).select(*columns)
        found.write.mode("append").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


#: Columns that hold torque and position, by maker of the file (fixed values of the file formats).
SIGNAL_COLUMNS = (("I Torque (A)", "Position (mm)"), ("unfiltered", "distance"), ("filtered", "distance"))


def torque_and_position(df: DataFrame, filtered: bool = False) -> tuple[str, str]:
    """Names of the torque and position columns, whichever maker's they are."""
    fit = [p for p in SIGNAL_COLUMNS if set(p) <= set(df.columns)]
    fit = [p for p in fit if p[0] not in ("filtered", "unfiltered") or p[0] == ("filtered" if filtered else "unfiltered")]
    if not fit:
        raise ValueError(f"no torque and position among {df.columns}")
    return fit[0]


def required_columns(df: DataFrame, names: dict[str, str], required: list[str]) -> DataFrame:
    """The required columns under their short names; those that are missing are named in the error."""
    short = df.withColumnsRenamed(names)
    if missing := [c for c in required if c not in short.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return short.select(*required)


def write_logs(trace: DataFrame, path: str) -> None:
    """One sectioned log for each hole: counters, then samples with decimal commas."""
    number = lambda c: F.translate(F.col(c).cast("string"), ".", ",")
    line = F.concat_ws("\t", *(number(s) for s in SAMPLE_COLUMNS.values()))
    body = trace.groupBy("hole_id").agg(F.sort_array(F.collect_list(F.struct("idx", line.alias("t")))).alias("x"))
    head = F.concat(
        F.lit("*** Head Datas ***\nHead Name\tHead Global Counter\tHead Local Counter 1\nH"), F.col("hole_id"),
        F.lit("\t"), (F.col("hole_id") * 7).cast("string"), F.lit("\t"), (F.col("hole_id") % 10).cast("string"),
        F.lit("\n\n*** Datas ***\n" + "\t".join(SAMPLE_COLUMNS) + "\n"),
    )
    text = F.concat(head, F.array_join(F.transform("x", lambda x: x["t"]), "\n"))
    write_texts(body.select(F.col("hole_id").alias("hole"), text.alias("value")), path, "hole")


def hole_of(file: Column) -> Column:
    return F.regexp_extract(file, r"hole=(\d+)", 1).cast("bigint")


def bad_files(lines: DataFrame) -> DataFrame:
    """Files without a sample header or without any section, with the reason."""
    g = lines.groupBy("file").agg(
        F.max(F.startswith("text", F.lit("Position (mm)"))).alias("data"), F.max(F.startswith("text", F.lit("***"))).alias("sections")
    )
    error = F.when(~F.col("sections"), "no section").when(~F.col("data"), "no sample header")
    return g.select("file", error.alias("error")).where("error is not null")


def variables(lines: DataFrame) -> DataFrame:
    """Force-plate text: a line for each variable with its name, rate and values; rows (file, idx, name, value)."""
    parts = lines.select("file", F.split("text", "\t").alias("p"))
    values = F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))
    x = parts.select("file", F.col("p")[0].alias("name"), F.posexplode(values).alias("idx", "v"))
    return x.select("file", "idx", "name", decimal_comma(F.col("v")).alias("value"))


def power_csv(spark: SparkSession, path: str, skip: int = 13) -> DataFrame:
    """Semicolon CSV behind so many lines: (file, offset_s, current)."""
    x = log_lines(spark, path).where(F.col("line") >= skip).select("file", F.split("text", ";").alias("p"))
    x = x.select("file", F.try_to_timestamp(F.col("p")[0]).alias("ts"), decimal_comma(F.col("p")[1]).alias("current"))
    first = F.min("ts").over(Window.partitionBy("file"))
    return x.select("file", ((F.unix_micros("ts") - F.unix_micros(first)) / 1e6).alias("offset_s"), "current")


def cycle_csv(spark: SparkSession, path: str, **constants) -> DataFrame:
    """Semicolon CSV of a cycle with constant columns added."""
    df = spark.read.option("header", True).option("sep", ";").option("inferSchema", False).csv(path)
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def nested_program(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON cycle files whose ``program`` is JSON text inside JSON: a row for each step, in step order."""
    raw = spark.read.schema("hole string, program string").option("multiLine", multi_line).json(path)
    steps = F.from_json("program", "array<struct<step:int,feed:double,rpm:double>>")
    return raw.select("hole", F.explode(F.sort_array(steps)).alias("s")).select("hole", "s.*")


def clean_names(df: DataFrame) -> DataFrame:
    """Spaces and slashes to underscores, no brackets."""
    return df.toDF(*(c.replace(" ", "_").replace("(", "").replace(")", "").replace("/", "_") for c in df.columns))


def cast_by_schema(df: DataFrame, *schemas: dict[str, str]) -> DataFrame:
    """Casts by the first schema whose columns are all there."""
    fit = next((s for s in schemas if set(s) <= set(df.columns)), None)
    if fit is None:
        raise ValueError(f"no schema fits {df.columns}")
    return df.select(*(F.col(c).try_cast(fit[c]).alias(c) if c in fit else F.col(c) for c in df.columns))


def result_records(results: DataFrame, root: str = "plant") -> DataFrame:
    """Two records (topic, value) of each successful result: key points and depths, as JSON."""
    base = F.concat_ws("/", F.lit(root), F.col("toolbox"), F.col("tool"), F.lit("Estimation"))
    meta = [F.col("machine_id").alias("MachineId"), F.col("result_id").alias("ResultId"), F.col("ts").alias("SourceTimestamp")]
    one = lambda name, c: F.struct(
        F.concat_ws("/", base, F.lit(name)).alias("topic"), F.to_json(F.struct(F.col(c).alias("Value"), *meta)).alias("value")
    )
    return results.select(F.explode(F.array(one("Keypoints", "keypoints"), one("DepthEstimation", "depths"))).alias("r")).select("r.*")
