"""Windows for a model: fixed matrices of lagged torques, scored by any function, and the heat maps read back.

The frame of a hole has a row for three samples of a step: ``COLUMNS`` torques (three phases with lags 0 to 4), the local counter
and whether it was pre-drilled.  It is padded at both ends, and 40 windows of 512 rows about its highest ``torque8`` go to the
model as one array (windows, rows, columns); a model gives an array of that shape.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boreflow.operators.windows import HOLE, by_hole, lagged_features

COLUMNS, ROWS, PAD, FILL = 15, 512, 400, -1.0
#: First window's begin before the peak, and the steps from there.
BEFORE, STEPS = 330, range(0, 200, 5)


def model_frame(df: DataFrame, c: str, pos: str, local: str, predrilled: str, step: int = 2) -> DataFrame:
    """Rows (hole_id, row, torque1 to torque15, local, predrilled, xpos): xpos is the middle phase's position two rows before."""
    torques = lagged_features(df, c, step)
    inside = df.where(F.col("step") == step).withColumn("_r", F.row_number().over(by_hole()) - 1)
    middle = inside.where(F.col("_r") % 3 == 1).withColumn("row", F.floor(F.col("_r") / 3))
    back = F.lag(pos, 2).over(Window.partitionBy(HOLE).orderBy("row"))
    middle = middle.select(HOLE, "row", F.col(local).cast("double").alias("local"), F.col(predrilled).cast("double").alias("predrilled"), F.coalesce(back, F.lit(0.0)).alias("xpos"))
    return torques.join(middle, [HOLE, "row"])


def windows_of(frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins of the windows in a padded frame, and the windows as float32."""
    peak = int(frame[:, 7].argmax())
    begins = peak - BEFORE + np.asarray(STEPS)
    begins = begins[(begins >= 0) & (begins + ROWS <= len(frame))]
    return begins, np.stack([frame[b : b + ROWS] for b in begins]).astype(np.float32) if len(begins) else np.empty((0, ROWS, frame.shape[1]), np.float32)


def decode(heat: np.ndarray, threshold: float) -> np.ndarray:
    """Row of each window with the largest sum over the torque columns, of values that reach the threshold; the first of equals."""
    kept = np.where(heat < threshold, 0, heat)[:, :, :COLUMNS]
    return np.round(kept.sum(axis=2, dtype=np.float64), 4).argmax(axis=1)


def torque_gradient(windows: np.ndarray) -> np.ndarray:
    """The default model: how far each value lies from the row before, 0 beside padding."""
    out = np.zeros_like(windows)
    out[:, 1:] = np.abs(np.diff(windows, axis=1))
    beside = (windows[:, 1:, :COLUMNS] == FILL).all(axis=2) | (windows[:, :-1, :COLUMNS] == FILL).all(axis=2)
    out[:, 1:][beside] = 0
    return out


FOUND = "hole_id bigint, window_nr bigint, begin bigint, at bigint, xpos double"
_SCHEMA = pa.schema([(x, pa.int64()) for x in ("hole_id", "window_nr", "begin", "at")] + [("xpos", pa.float64())])


def score_windows(frame: DataFrame, model: Callable[[np.ndarray], np.ndarray] = torque_gradient, threshold: float = -1.0) -> DataFrame:
    """Per hole and window: begin and hottest row in the padded frame, and the position there."""
    names = [f"torque{i + 1}" for i in range(COLUMNS)] + ["local", "predrilled", "xpos"]
    row = F.struct("row", F.array(*(F.col(n).cast("double") for n in names)).alias("v"))
    holes = frame.groupBy(HOLE).agg(F.array_sort(F.collect_list(row)).alias("r")).select(HOLE, F.flatten(F.transform("r", lambda x: x["v"])).alias("v"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hole, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = values.values.to_numpy(zero_copy_only=False).reshape(-1, len(names))
                whole = np.full((len(data) + 2 * PAD, len(names)), FILL)
                whole[:, COLUMNS:] = data[0, COLUMNS:]  # what is no torque goes on in the padding as it begins
                whole[PAD : PAD + len(data)] = data
                begins, windows = windows_of(whole[:, : COLUMNS + 2])
                if len(begins):
                    at = begins + decode(model(windows), threshold)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (np.full(len(begins), hole), np.arange(len(begins)), begins, at, whole[at, -1])], schema=_SCHEMA
                    )

    return holes.mapInArrow(scored, FOUND)


def exits(scored: DataFrame) -> DataFrame:
    """Mean position over the windows of a hole."""
    return scored.groupBy(HOLE).agg(F.avg("xpos").alias("exit"), F.count("*").alias("windows"))
