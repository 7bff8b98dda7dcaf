"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put in another order between marks.

A unit is a run of A-Z and a-z, or any other code point.  ``regexp_count`` gives the n units of a text; two numbers from the
sha256 of ``epoch:doc_id`` give the cuts a <= b; one match of a pattern made for the row, whose possessive groups take exactly
``a`` and ``b - a`` units, captures the three parts, and its replacement sets them in order.  Possessive counts never step back,
so a match is one walk over the text without recursion, whatever its length.

A row is plain (its text unchanged) if its text is null (which counts as empty), empty or holds a mark, and in the share of
rows that stays plain.  A null doc_id counts as the empty string.  Repeated rows are cut alike.  Further columns stay, unless
they have a name of the output, which takes their place; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut, and percent of those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20


def draws(doc_id: Column, epoch: int, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def pattern(a: Column, b: Column) -> Column:
    """Captures the first a units, the next b - a, and the rest."""
    counted = [F.concat(F.lit(f"((?:{UNIT}){{"), k.cast("string"), F.lit("}+)")) for k in (a, b - a)]
    return F.concat(F.lit("(?s)^"), *counted, F.lit(r"(.*)\z"))


def transform(docs: DataFrame, epoch: int = 1, doc_id: str = "doc_id", text: str = "text", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Adds n (units), form (plain, psm, spm), output, and the code points of prefix and middle (null if plain)."""
    new = ("n", "form", "output", "prefix_chars", "middle_chars")
    own = [F.col(f"row.{c}") for c in docs.columns if c.lower() not in new]
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select("row", whole.alias("whole"))
    h1, h2, h3, h4 = draws(F.col(f"row.{doc_id}"), epoch)
    units = F.regexp_count("whole", F.lit(UNIT)).cast("bigint")
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("whole", F.lit(m))
    plain = (F.col("whole") == "") | marked | (h3 % 100 >= cut)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("row", "whole", units.alias("n"), form.alias("form"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    parts = pattern(F.least(a, b), F.greatest(a, b))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("whole")).otherwise(F.regexp_replace("whole", parts, order))
    rows = rows.select("row", "n", "form", output.alias("output"))
    prefix, middle, _ = _parts(F.col("output"), F.col("form"))
    lengths = (F.when(F.col("form") != "plain", F.char_length(c).cast("bigint")) for c in (prefix, middle))
    return rows.select(*own, "n", "form", "output", *(c.alias(x) for c, x in zip(lengths, new[3:], strict=True)))


def _between(output: Column, left: str, right: str | None) -> Column:
    """What stands between two marks; no text holds one, so each is found at its only place."""
    start = F.instr(output, left) + len(left)
    end = F.instr(output, right) if right else F.char_length(output) + 1
    return F.substring(output, start, end - start)


def _parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output that is not plain."""
    spm = form == "spm"
    prefix = F.when(spm, _between(output, PREFIX, MIDDLE)).otherwise(_between(output, PREFIX, SUFFIX))
    suffix = F.when(spm, _between(output, SUFFIX, PREFIX)).otherwise(_between(output, SUFFIX, MIDDLE))
    return prefix, _between(output, MIDDLE, None), suffix


def restore(output: Column, form: Column) -> Column:
    """The text, from an output and its form alone."""
    return F.when(form == "plain", output).otherwise(F.concat(*_parts(output, form)))
