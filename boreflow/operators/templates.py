"""Templates against signals: cutting them, matching all of them at once, quality of the matches, and what lies at them.

A template table has rows (name, target_idx, segment array<double>) of any number and length.  It is sent to the tasks in blocks of
at most ``BLOCK_VALUES`` values; every signal meets every template there, in Arrow batches, and only the matches come out.  A
signal is one array, as long as a drilling cycle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.operators.windows import HOLE, IDX

#: Values of all templates that are sent at once.
BLOCK_VALUES = 1_000_000
#: Values that one numpy step holds.
STEP_VALUES = 1 << 20
DIGITS = 6


def ranges_of(df: DataFrame, ranges: DataFrame, shift: Column | None = None) -> DataFrame:
    """Adds ``at`` to each named range (name, start, width, target, and the hole if it has one) for every index inside."""
    begin = F.col("start") + (F.lit(0) if shift is None else shift)
    return ranges.withColumn("begin", begin).withColumn("at", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("width") - 1)))


def cut_templates(df: DataFrame, c: str, ranges: DataFrame) -> DataFrame:
    """Templates from rows (hole_id, name, start, width, target): the samples of the range, and the target's place in it."""
    want = ranges_of(df, ranges).select(HOLE, "name", F.col("at").cast("bigint").alias(IDX), (F.col("target") - F.col("start")).alias("target_idx"))
    g = want.join(df.select(HOLE, IDX, c), [HOLE, IDX]).groupBy(HOLE, "name", "target_idx")
    cut = g.agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(c).alias("y")))).alias("s"))
    return cut.select("name", F.col("target_idx").cast("int").alias("target_idx"), F.transform("s", lambda s: s["y"].cast("double")).alias("segment"))


def signals(df: DataFrame, c: str) -> DataFrame:
    """One row a hole: its samples in order."""
    g = df.groupBy(HOLE).agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(c).cast("double").alias("y")))).alias("s"))
    return g.select(HOLE, F.transform("s", lambda s: s["y"]).alias("signal"))


def profile(signal: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """z-normalised Euclidean distance of the segment to the signal from each place on; flat samples correlate with nothing."""
    m, sd = len(segment), segment.std()
    z = (segment - segment.mean()) / sd if sd > 1e-9 else np.zeros(m)
    out = np.empty(max(0, len(signal) - m + 1))
    step = max(1, STEP_VALUES // m)
    for at in range(0, len(out), step):
        w = np.lib.stride_tricks.sliding_window_view(signal[at : at + step + m - 1], m)
        s = w.std(axis=1)
        corr = np.divide(w @ z, m * s, out=np.zeros(len(w)), where=s > 1e-9)
        out[at : at + len(w)] = np.sqrt(np.maximum(0, 2 * m * (1 - corr)))
    return np.round(out, DIGITS)


def lowest_valleys(d: np.ndarray, n: int) -> np.ndarray:
    """Values of the n lowest local minima (a plateau is one) that are at most half of the largest distance."""
    if len(d) < 3:
        return np.empty(0)
    runs = d[np.concatenate([[True], d[1:] != d[:-1]])]
    low = (runs[1:-1] < runs[:-2]) & (runs[1:-1] < runs[2:]) & (runs[1:-1] <= 0.5 * d.max())
    return np.sort(runs[1:-1][low])[:n]


def score(d: np.ndarray, valleys: int) -> tuple[float | None, float | None]:
    """z of the lowest valley against the next ones, and the composite distance / z; null without two unlike others."""
    low = lowest_valleys(d, valleys)
    spread = low[1:].std() if len(low) > 1 else 0.0
    if spread <= 1e-12:
        return None, None
    z = abs(low[0] - low[1:].mean()) / spread
    return float(z), float(d.min() / z) if z > 0 else None


MATCH = "hole_id bigint, name string, start bigint, target bigint, distance double, z double, composite double"
_SCHEMA = pa.schema(
    [("hole_id", pa.int64()), ("name", pa.string()), ("start", pa.int64()), ("target", pa.int64())] + [(x, pa.float64()) for x in ("distance", "z", "composite")]
)


def match(df: DataFrame, c: str, templates: DataFrame, valleys: int = 3) -> DataFrame:
    """Per hole and template: where it fits best (the first of equals), its target there, distance and quality.

    Signals shorter than a template have no row for it.
    """
    total = templates.agg(F.sum(F.size("segment"))).first()[0] or 0
    blocks, found = max(1, -(-total // BLOCK_VALUES)), None
    rows = signals(df, c)
    for k in range(blocks):
        known = templates.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k).select("name", "target_idx", "segment").collect()
        sent = df.sparkSession.sparkContext.broadcast([(t.name, t.target_idx, np.array(t.segment, float)) for t in known])

        def matched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for hole, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    y = values.values.to_numpy(zero_copy_only=False)
                    for name, target, segment in sent.value:
                        d = profile(y, segment)
                        if len(d):
                            at = int(d.argmin())
                            out.append((hole, name, at, at + target, float(d[at]), *score(d, valleys)))
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in out], _SCHEMA)

        part = rows.mapInArrow(matched, MATCH)
        found = part if found is None else found.union(part)
    return found


def composite_rag(composite: Column, green: float = 1.4, amber: float = 1.75) -> Column:
    """2 green, 1 amber, 0 red; red without a composite."""
    return F.when(composite < green, 2).when(composite < amber, 1).otherwise(0)


def target_positions(df: DataFrame, matches: DataFrame, pos: str = "pos_mm") -> DataFrame:
    """Matches with the position of their target; a target beyond the signal has none."""
    at = df.select(HOLE, F.col(IDX).alias("target"), F.abs(F.col(pos)).alias("position"))
    return matches.join(at, [HOLE, "target"], "left")


def stack_depths(positions: DataFrame, order: list[str]) -> DataFrame:
    """Depths between the templates of ``order``, and in all: (hole, layer, depth, quality, rag).

    Layer 0 is the whole stack.  The quality of a depth is the worse composite of its two ends, its colour the worse colour.
    """
    at = lambda n, col: F.max(F.when(F.col("name") == n, F.col(col)))
    g = positions.groupBy(HOLE).agg(
        *(at(n, "position").alias(f"p{i}") for i, n in enumerate(order)), *(at(n, "composite").alias(f"q{i}") for i, n in enumerate(order))
    )

    def layer(k: int, a: int, b: int) -> Column:
        quality = F.when(F.col(f"q{a}").isNotNull() & F.col(f"q{b}").isNotNull(), F.greatest(f"q{a}", f"q{b}"))
        colour = F.least(composite_rag(F.col(f"q{a}")), composite_rag(F.col(f"q{b}")))
        return F.struct(F.lit(k).alias("layer"), (F.col(f"p{b}") - F.col(f"p{a}")).alias("depth"), quality.alias("quality"), colour.alias("rag"))

    last = len(order) - 1
    return g.select(HOLE, F.explode(F.array(layer(0, 0, last), *(layer(k + 1, k, k + 1) for k in range(last)))).alias("l")).select(HOLE, "l.*")


def estimated_segments(df: DataFrame, c: str, ranges: DataFrame, matches: DataFrame) -> DataFrame:
    """The named ranges of a template, shifted to where it was found in each hole, and cut there: (hole, name, begin, segment).

    ``ranges`` has rows (name, start, width, target); a range moves by the estimated less the template's target. What lies
    beyond the signal is left out.
    """
    moved = matches.select(HOLE, "name", "target").join(ranges.select("name", "start", "width", F.col("target").alias("was")), "name")
    want = ranges_of(df, moved, F.col("target") - F.col("was")).select(HOLE, "name", "begin", F.col("at").cast("bigint").alias(IDX))
    g = want.join(df.select(HOLE, IDX, c), [HOLE, IDX]).groupBy(HOLE, "name", "begin")
    cut = g.agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(c).alias("y")))).alias("s"))
    return cut.select(HOLE, "name", "begin", F.transform("s", lambda s: s["y"]).alias("segment"))
