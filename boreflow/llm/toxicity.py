"""Toxicity scores learned from confirmed toxic examples and unlabelled text (non-negative PU learning).

A document's features are marked character n-grams of its words (``<word>`` cut to 4 to 6 characters) and the words
of up to ``WHOLE`` letters themselves, each present or not. Words of any length have all their n-grams; long ones are cut
in overlapping slices, so that memory stays bounded.  Features that confirmed toxic documents have far more often than unlabelled ones are
selected by a z score; a linear classifier over them is trained in numpy on the risk

    prior * E_toxic[loss(+g)]  +  max(0, E_unlabelled[loss(-g)] - prior * E_toxic[loss(-g)])

with the sigmoid loss (bounded, so that a prior slightly off does little harm): what is unlabelled counts as negative, less the share of it that the class prior says is toxic,
and that estimate may not fall below zero (Kiryo et al., 2017).

Training uses samples by a hash of the id, in the mean of at most ``POSITIVES`` confirmed and ``UNLABELLED`` other
documents; near copies count once in the selection, and so do equal texts under three words.  Scoring reads every whole text.  A null or empty text has no
features and gets the score of the bare intercept; so does every text where there are no toxic examples. Repeated rows
are scored alike; further columns are kept, those with the name of a result give way. An empty table of documents or of
labels gives a model without features. Where labels contradict each other the toxic one holds. The sample is written to the
shared folder before it is used, so that all passes over it, and retries of lost tasks, see the same rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boreflow.llm.shared import Scratch

POSITIVES, UNLABELLED = 4000, 8000
#: Features kept, and the least z score and count of toxic documents of each.
FEATURES, LEAST_Z, LEAST_DOCS = 4096, 6.0, 5
MEMO_WORDS = 400_000
#: Letters up to which a word is a feature as a whole and its features are remembered; letters of a slice of a longer one.
WHOLE, SLICE = 60, 4096

WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> Iterator[set[str]]:
    """The features of a word, a set for each slice; slices overlap so that no n-gram is lost."""
    marked = f"<{word}>"
    for at in range(0, max(1, len(marked) - 5), SLICE):
        part = marked[at : at + SLICE + 5]
        found = {part[i : i + n] for n in (4, 5, 6) for i in range(len(part) - n + 1)}
        yield found | {marked} if len(word) <= WHOLE else found


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float
    memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: str | None) -> float:
        """Each feature counts once a document."""
        hit: set[str] = set()
        memo = self.memo
        for w in words_of(text):
            found = memo.get(w)
            if found is None:
                found = tuple({f for part in features_of(w) for f in part if f in self.weights})
                if len(w) <= WHOLE:
                    if len(memo) > MEMO_WORDS:
                        memo.clear()
                    memo[w] = found
            if found:
                hit.update(found)
        g = self.intercept + sum(self.weights[f] for f in sorted(hit))
        return float(1 / (1 + np.exp(-g))) if g > -500 else 0.0

    def __getstate__(self):
        return {"weights": self.weights, "intercept": self.intercept, "memo": {}}


def train_nnpu(
    rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float,
    steps: int = 400, rate: float = 0.3, decay: float = 1e-5,
) -> tuple[np.ndarray, float]:
    """Weights and intercept; ``rows`` has the indices of each document's features, ``positive`` marks confirmed ones."""
    w, b = np.zeros(n_features), 0.0
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    doc, cols = np.repeat(np.arange(len(rows)), sizes), np.concatenate([*rows, []]).astype(np.int64)
    n_pos, n_unl = positive.sum(), (~positive).sum()
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        g = b + np.bincount(doc, w[cols], len(rows))
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        negative = p[~positive].mean() - prior * p[positive].mean()
        slope = p * (1 - p)
        d_pos = np.where(positive, -prior * slope / n_pos, 0)  # of prior * E_toxic[loss(+g)]
        d_neg = np.where(positive, -prior * slope / n_pos, slope / n_unl)  # of the negative part
        d = d_pos + d_neg if negative >= 0 else -d_neg  # where the estimate is below zero, step back
        grad = np.append(np.bincount(cols, d[doc], n_features) + decay * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step_by = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - step_by[:-1], b - step_by[-1]
    return w, float(b)


def in_training(doc_id) -> F.Column:
    """Rows whose labels may be learned from: crc32 of the id as text leaves a remainder by 5."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) != 0


def _share(df: DataFrame, most: int) -> float:
    return min(1.0, most / max(1, df.count()))


def _some(column: str, share: float, salt: int):
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 30)) < int(share * (1 << 30))


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic"
) -> Model:
    """Train on rows with ``in_training``; of other rows no label is read."""
    known = labels.where(F.col(toxic).isNotNull()).select(F.col(doc_id).alias("id"), F.col(toxic).alias("y"))
    known = known.where(in_training("id")).groupBy("id").agg(F.max("y").alias("y"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0)).alias("k")).first()
    if not counts.k:
        return Model({}, -2.0)
    prior = min(0.9, max(1e-3, counts.k / counts.n))
    positive = known.where("y = 1")
    positive = positive.where(_some("id", _share(positive, POSITIVES), 1)).select("id", F.lit(True).alias("pos"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(in_training("id"))
    rows = rows.join(F.broadcast(positive), "id", "left")  # a sample of bounded size
    rows = rows.where(F.col("pos") | _some("id", _share(docs, UNLABELLED), 2))
    rows = scratch.save(rows.select(F.coalesce("pos", F.lit(False)).alias("pos"), "text"), "sample")

    def keyed(batches: Iterator[pa.RecordBatch]):
        """Each text with the least hash of its word triples: near copies mostly share it."""
        for b in batches:
            keys = []
            for t in b.column(1).to_pylist():
                w = WORD.findall((t or "").lower())
                runs = zip(w, w[1:], w[2:], strict=False) if len(w) > 2 else [w]
                keys.append(min(zlib.crc32(" ".join(x).encode()) for x in runs))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], ["pos", "text", "k"])

    def counted(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
                for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    fs: set[str] = set()
                    for w in words_of(t):
                        fs.update(*features_of(w))
                    seen[p].update(fs)
                for p, c in seen.items():
                    if c:
                        n = len(c)
                        cols = [pa.array(list(c), pa.string()), pa.array([p] * n), pa.array(list(c.values()), pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, ["f", "pos", "n"])

    keyed_rows = rows.mapInArrow(keyed, "pos boolean, text string, k bigint")
    sample = keyed_rows.groupBy("pos", "k").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    sample = scratch.save(sample.select("pos", F.col("one.text").alias("text")), "distinct")
    sizes = {r.pos: r["count"] for r in sample.groupBy("pos").count().collect()}
    n_pos, n_unl = sizes.get(True, 0), max(1, sizes.get(False, 0))
    df = sample.mapInArrow(counted, "f string, pos boolean, n bigint").groupBy("f").agg(
        F.sum(F.when(F.col("pos"), F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("pos"), 0).otherwise(F.col("n"))).alias("u"),
    )
    expected = F.col("u") * (n_pos / n_unl)
    z = (F.col("a") - expected) / F.sqrt(expected + 1)
    best = df.where(F.col("a") >= LEAST_DOCS).select("f", z.alias("z")).where(F.col("z") >= LEAST_Z)
    chosen = [r.f for r in best.orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    index = {f: i for i, f in enumerate(chosen)}

    def present(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                got = {index[f] for w in words_of(t) for part in features_of(w) for f in part if f in index}
                rows.append(sorted(got))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], ["pos", "x"])

    data = rows.mapInArrow(present, "pos boolean, x array<int>").collect()  # ints of the bounded sample
    data.sort(key=lambda r: (r.pos, r.x))
    is_pos = np.array([r.pos for r in data], bool)
    if not is_pos.any() or is_pos.all():
        return Model({}, -2.0)
    w, b = train_nnpu([np.array(r.x, np.int64) for r in data], is_pos, len(chosen), prior)
    return Model(dict(zip(chosen, w.tolist(), strict=True)), b)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """Adds ``out``, from 0 to 1, of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                got = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
                keep = [n for n in part.schema.names if n != out and (keep_text or n != text)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), got], [*keep, out])

    kept = [f for f in docs.schema.fields if f.name != out and (keep_text or f.name != text)]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))
