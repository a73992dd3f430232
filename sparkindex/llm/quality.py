"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every text is reduced to statistics of its characters, words and lines, computed over
the whole text; a null text counts as empty, and empty texts are scored like any other.
The statistics are standardised and mapped to random Fourier features, whose inner
products approximate a Gaussian kernel. The normal equations of a ridge regression are
summed partition by partition and solved once; its raw scores are turned into
probabilities by isotonic regression on a fold that the ridge has not seen.

Only labelled rows are learnt from, never the held-out fold (crc32 of the id as text, mod
`folds`, is 0). Fold 1 calibrates, the others fit. At most MAX_LABELLED labelled rows,
chosen by a hash of the id, are used; the score of a text depends on its text alone. Rows
without a label value or id are not learnt from; without any usable label of both kinds
every score is the share of label 1 seen, or 0.5. Repeated rows each get their score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkindex.llm.common import map_batches, materialize

FOLDS = 5
THRESHOLD = 0.3
#: Labelled rows to learn from, at most: the fit needs no more, whatever the corpus.
MAX_LABELLED = 500_000
FEATURES = 256
WIDTH = 0.22
PENALTY = 1e-3
BINS = 2048
FIT_PARTITIONS = 16
SEED = 7

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "upper", "digit", "space", "stops", "symbols", "bars", "high",
    "distinct", "top_word", "stutter", "capitals", "odd_words", "same_lines", "line_words", "repeats", "entropy",
)

_KIND = np.zeros(256, np.int64)  # 1 upper, 2 digit, 3 white space, 4 full stop or comma, 5 other ASCII symbol, 6 bar, 7 beyond ASCII
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 45, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = 5
_KIND[[44, 46]] = 4
_KIND[124] = 6
_KIND[128:] = 7
_ODD = re.compile(rb"[!-+\-/:-@\[-`{-~]\Z")


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, w = len(data), len(words)
    if not w:
        return [float(np.log1p(n))] + [0.0] * (len(STATISTICS) - 1)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=histogram, minlength=8)
    shares = histogram[histogram > 0] / n
    sizes = np.fromiter(map(len, words), np.int64, w)
    counted = Counter(words)
    common = counted.most_common(1)[0][1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    pairs = Counter(zip(words[::2], words[1::2], strict=False))
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        float(sizes.mean()),
        float(sizes.std()),
        float(kinds[1] / n),
        float(kinds[2] / n),
        float(kinds[3] / n),
        float(kinds[4] / w),
        float(kinds[5] / w),
        float(kinds[6] / w),
        float(kinds[7] / n),
        len(counted) / w**0.85,
        common / w,
        stutter / w,
        sum(x[:1].isupper() for x in words) / w,
        sum(1 for x in words if _ODD.search(x)) / w,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(w / len(lines))),
        1 - len(pairs) / max(1, sum(pairs.values())),
        float(-(shares * np.log(shares)).sum()),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([statistics(x.as_py()) for x in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["id", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return map_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, len(STATISTICS))


@dataclass
class Model:
    """What scoring needs; a few kilobytes, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0.0, 1.0)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of y, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), value) for value, _, n in blocks]) if blocks else np.empty(0)


def fold(id_col, folds: int = FOLDS):
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def _sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y: each of few partitions sends its own sum."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value.beta)
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = shared.value.features(matrix(batch.column("x")))
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ np.asarray(batch.column("y"))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    size = len(model.beta)
    parts = rows.select("x", "y").repartition(FIT_PARTITIONS).mapInArrow(run, "total binary").toLocalIterator()
    total = np.zeros((size, size + 1))
    for part in parts:
        total += np.frombuffer(part.total).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def _curve(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Points of the calibration curve, from the label counts in bins of the raw score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(shared.value.raw(matrix(batch.column("x"))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], ["raw", "y"])

    scored = rows.select("x", "y").mapInArrow(run, "raw double, y double")
    bins = scored.groupBy(F.floor(F.col("raw") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), F.avg("raw").alias("at"))
    found = sorted((r.at, r.n, r.ones) for r in bins.collect())
    if not found:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    at, n, ones = np.asarray(found).T
    value = isotonic(ones / n, n)
    starts = np.flatnonzero(np.diff(value, prepend=-1.0))
    weight = np.add.reduceat(n, starts)
    return np.add.reduceat(at * n, starts) / weight, value[starts]


def training(labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = FOLDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, y) of the labels to learn from: none of the held-out fold, about max_labelled at most."""
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y")).where("id is not null and y is not null")
    marked = marked.where(fold(F.col("id"), folds) != 0)
    known = marked.count()
    share = min(1.0, max_labelled / max(1, known))
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return marked


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = FOLDS, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the rows of stats (id, x) that labels marks, but for the held-out fold."""
    marked = training(labels, label_col, id_col, folds, max_labelled)
    rows = materialize(stats.join(marked, "id").withColumn("fold", fold(F.col("id"), folds)), "labelled")
    k = len(STATISTICS)
    summary = rows.where("fold > 1").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[f(F.get("x", F.lit(i))).alias(f"{s}{i}") for i in range(k) for s, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([summary[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([summary[f"s{i}"] or 0.0 for i in range(k)])
    draw = np.random.default_rng(SEED)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), draw.normal(0, WIDTH, (k, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.full(2, 0.5))
    if not summary.n or not 0 < summary.ones < summary.n:
        model.value = np.full(2, summary.ones / summary.n if summary.n else 0.5)
        return model
    left, right = _sums(rows.where("fold > 1"), model)
    penalty = PENALTY * summary.n / FEATURES * np.eye(len(left))
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(left + penalty, right)
    model.at, model.value = _curve(rows.where("fold = 1"), model)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) of every row of stats (id, x)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(matrix(batch.column("x"))))], ["id", "score"])

    return stats.select("id", "x").mapInArrow(run, T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) for each row of docs, by a model learnt from labels."""
    stats = materialize(with_statistics(docs, id_col, text_col), "statistics")
    return score(stats, fit(stats, labels, label_col))
