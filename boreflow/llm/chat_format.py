r"""Conversations as training windows of bounded length, with a loss mask.

A turn is written ``### role: text</turn>`` and a line end.  Inside texts and roles a backslash, ``###`` and ``</turn>`` are written
``\\``, ``\h`` and ``\t`` (a colon in a role ``\c``), so marks stand only between turns and reading gives back every text.

Prefix sums of the tokens of turns choose the windows: turns that start in the same stretch of half a window's room stand in
one window, a turn longer than that stands alone.  So every window holds whole turns, and fits ``budget`` unless a turn or the
system turn alone is too long.  The system turn opens every window; turns before the window's own are repeated while they fit
``history`` tokens.  The mask covers the texts of assistant turns where they stand for the first time; repeated ones are masked.

The sums run over ranges of rows, so a conversation may be longer than a task; only single windows are gathered.  Turns are in
order of turn, nulls first, ties by role, then text; a null role or text counts as empty; rows without conv_id are one
conversation. Repeated rows are turns of their own.  A system turn that is not the first is a turn like others.  Texts of any
length stay whole. Further columns are ignored, whatever their names. Empty tables give no windows.  Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boreflow.llm.shared import Scratch

#: Tokens of a window, of repeated history in it, and of the room for new turns at least.
BUDGET, HISTORY, ROOM = 1024, 256, 256
#: Tokens: runs of letters and digits, and other visible characters; what the marks of a turn count.
TOKEN, MARKS = r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]", 4
OPEN, CLOSE = "### ", "</turn>\n"
_CODES = [("###", "\\h"), ("</turn>", "\\t")]


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    c = _replace(c, "\\", "\\\\")
    for plain, code in _CODES + [(":", "\\c")] * role:
        c = _replace(c, plain, code)
    return c


def unescape(c: Column, role: bool = False) -> Column:
    """Codes are read between doubled backslashes, which a scan from the left finds as they were written."""

    def part(x: Column) -> Column:
        for plain, code in _CODES + [(":", "\\c")] * role:
            x = _replace(x, code, plain)
        return x

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def turns_of(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns with their place in the conversation (from 1), tokens, and ``before``: the tokens of earlier turns but the system's."""
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + MARKS).cast("bigint")).withColumn("row", F.monotonically_increasing_id())
    order = ["turn", "role", "text", "row"]
    ranged = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged, "ranged")
    # sums inside a part, then over the parts of a conversation, of which there are few
    inside = Window.partitionBy("conv_id", "part").orderBy(*order)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select(
        "*", F.row_number().over(inside).alias("i"), F.coalesce(F.sum("tokens").over(prior), F.lit(0)).alias("s"),
    )
    first = F.min_by(F.struct("role", "tokens"), F.struct(*order))
    parts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), first.alias("first"))
    over = Window.partitionBy("conv_id").orderBy("part")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.first("first").over(over.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select(
        F.col("conv_id").alias("conv"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"),
        F.when(opening["role"] == "system", opening["tokens"]).otherwise(0).alias("system_tokens"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("part") == F.col("at"))
    turns = placed.join(parts, same).withColumn("place", F.col("n0") + F.col("i"))
    system = (F.col("place") == 1) & (F.col("role") == "system")
    before = F.when(system, 0).otherwise(F.col("t0") + F.col("s") - F.col("system_tokens"))
    return turns.select("conv_id", "place", "role", "text", "tokens", "system_tokens", system.alias("system"), before.alias("before"))


def windows_of(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Rows (conv_id, window, kind, place, role, text, own): the turns of each window, kind 0 system, 1 repeated, 2 new."""
    half = F.floor(F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(ROOM)) / 2)
    window = 2 * F.floor(F.col("before") / half) + (F.col("tokens") > half).cast("bigint")
    cols = ["conv_id", "window", "kind", "place", "role", "text", "own"]
    new = turns.where("not system").withColumns({"window": window, "kind": F.lit(2), "own": F.lit(True)})
    starts = new.groupBy("conv_id", "window").agg(F.min("before").alias("start"))
    # earlier turns meet the starts of windows in cells of tokens
    end = F.col("before") + F.col("tokens")
    fits = new.where(F.col("tokens") <= history).select("conv_id", "place", "role", "text", "before", end.alias("end"))
    cells = F.sequence(F.floor(F.col("end") / history), F.floor((F.col("before") + history) / history))
    fits = fits.withColumn("cell", F.explode(cells))
    starting = starts.select(
        F.col("conv_id").alias("conv"), "window", "start", F.floor(F.col("start") / history).alias("start_cell")
    )
    meets = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("cell") == F.col("start_cell"))
    meets = meets & (F.col("end") <= F.col("start")) & (F.col("start") - F.col("before") <= history)
    again = fits.join(starting, meets).withColumns({"kind": F.lit(1), "own": F.lit(False)})
    system = turns.where("system").select(F.col("conv_id").alias("conv"), "place", "role", "text")
    firsts = starts.withColumn("first", F.col("start") == 0)
    opened = firsts.join(system, F.col("conv_id").eqNullSafe(F.col("conv"))).withColumns({"kind": F.lit(0), "own": F.col("first")})
    alone = turns.where("system").join(starts.select(F.col("conv_id").alias("conv")).distinct(), F.col("conv_id").eqNullSafe(F.col("conv")), "left_anti")
    alone = alone.withColumns({"window": F.lit(0).cast("bigint"), "kind": F.lit(0), "own": F.lit(True)})
    return new.select(cols).unionByName(again.select(cols)).unionByName(opened.select(cols)).unionByName(alone.select(cols))


def format_windows(conversations: DataFrame, scratch: Scratch, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per window: conv_id, window, text, n_repeated (turns at its start that another window owns), and ``loss``.

    ``loss`` holds the code points [lo, hi) of text that are trained on.
    """
    turns = scratch.save(turns_of(conversations, scratch), "turns")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(": "))
    body = escape(F.col("text"))
    parts = windows_of(turns, budget, history).select(
        "conv_id", "window", "kind", "place", "own", head.alias("head"), body.alias("body"), ((F.col("role") == "assistant") & F.col("own")).alias("target")
    )
    sizes = (F.char_length("head").alias("skip"), F.char_length("body").alias("size"))
    part = F.struct("kind", "place", "own", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), *sizes, "target")
    whole = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + x["skip"] + x["size"] + len(CLOSE)).alias("at"),
            F.when(
                x["target"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["skip"]).alias("lo"), (s["at"] + x["skip"] + x["size"]).alias("hi"))))
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("parts", lambda x: x["piece"]), "")
    repeated = F.size(F.filter("parts", lambda x: ~x["own"]))
    return whole.select("conv_id", "window", text.alias("text"), repeated.alias("n_repeated"), spans.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Per window, read from its text: ``turns`` (role, text) that it owns, and ``targets``, the texts under its mask."""
    pieces = F.split("text", CLOSE)
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    whole = rf"(?s)^{OPEN}([^:]*): (.*)\z"
    turns = F.transform(
        own,
        lambda x: F.struct(
            unescape(F.regexp_extract(x, whole, 1), role=True).alias("role"), unescape(F.regexp_extract(x, whole, 2)).alias("text")
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["lo"] + 1, s["hi"] - s["lo"])))
    return windows.select("conv_id", "window", F.char_length("text").cast("bigint").alias("n_chars"), turns.alias("turns"), targets.alias("targets"))


def summaries(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows: turns and trained texts as digests.  A digest needs its conversation in one row."""
    per_turn = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = read_windows(windows).select(
        "conv_id", "n_chars", F.struct("window", F.size("turns").alias("n"), per_turn.alias("turns"), F.array_join("targets", "").alias("loss")).alias("w")
    )
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.sum("n_chars").alias("formatted_chars"), F.sum("w.n").alias("n_turns"))
    turns, loss = F.array_join(F.col("ws.turns"), ""), F.array_join(F.col("ws.loss"), "")
    out = whole.select("conv_id", "n_turns", "formatted_chars", turns.alias("turns"), loss.alias("loss"))
    return out.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
