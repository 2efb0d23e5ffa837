"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

A Gaussian kernel over standardised statistics is approximated by cosines of random projections. The ridge fit needs only the sums X'X and X'y, which
partitions compute on their own and which are added up in two levels, so it takes all labelled rows, however many. Raw scores of rows kept back from the fit are
counted in bins, and a non-decreasing function of the bins' rates turns raw scores into probabilities.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of, written
from .labelled import isotonic, labels_of

STATISTICS = [
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeats_next", "repeats_second", "distinct_pairs", "upper", "digits", "ends", "commas",
    "signs", "exclaims", "spaces", "non_ascii", "short_words", "long_words", "ends_in_sign", "line_length", "repeated_lines", "compressed", "title_words", "upper_words",
]
FEATURES = 384
BINS = 1024

_CLASS = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 1 if _c >= 128 else 2 if _s.islower() else 3 if _s.isupper() else 4 if _s.isdigit() else 5 if _s.isspace() else 6 if _s in ".?;:" else 7 if _s == "," else 8 if _s == "!" else 9
_HEAD = 1 << 16


def statistics(text: str) -> list[float]:
    """The STATISTICS of a whole text; an empty one has all zeros."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=10) / n
    words = text.split()
    w = max(1, len(words))
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(data[i : i + _HEAD])) for i in range(0, n, _HEAD)) + len(packer.flush())
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(float(lengths.mean())) if words else 0.0, len(counts) / math.sqrt(w), max(counts.values(), default=0) / w,
        sum(map(str.__eq__, words, words[1:])) / w, sum(map(str.__eq__, words, words[2:])) / w, len(set(zip(words, words[1:]))) / w,
        kinds[3] / (kinds[2] + kinds[3] + 1e-3), kinds[4], kinds[6] * n / w, kinds[7] * n / w, kinds[9] * n / w, kinds[8] * n / w, kinds[5], kinds[1],
        float((lengths <= 3).mean()) if words else 0.0, float((lengths >= 14).mean()) if words else 0.0, sum(not (x[-1].isalnum() or x[-1] in ".,;:") for x in words) / w,
        math.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), packed / n, sum(x[0].isupper() for x in words) / w, sum(x.isupper() for x in words) / w,
    ]


def with_statistics(df: DataFrame, keep: list[str], text: str = "_text") -> DataFrame:
    """``keep`` columns and _x, the STATISTICS of column ``text`` (null: empty); texts stay in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "_x"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField("_x", T.ArrayType(T.DoubleType()))]))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("_x").flatten()).reshape(batch.num_rows, -1)


def summed(df: DataFrame, function, groups: int = 16) -> list[np.ndarray] | None:
    """The sum over all batches of the arrays that ``function(batch)`` returns: by partition, by ``groups`` groups of partitions, and in all."""

    def add(into, arrays):
        return arrays if into is None else [a + b for a, b in zip(into, arrays)]

    def partition(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                total = add(total, function(batch))
        if total is not None:
            data = np.concatenate([a.ravel() for a in total])
            shape = ",".join("x".join(map(str, a.shape)) or "1" for a in total)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([shape]), pa.array([data.tobytes()], pa.binary())], ["part", "shape", "data"])

    def group(batches):
        total, keys = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                keys = [batch.column(c)[k].as_py() for c in ("part", "shape")]
                x = np.frombuffer(batch.column("data")[k].as_py())
                total = x.copy() if total is None else total + x
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([keys[0]], pa.int32()), pa.array([keys[1]]), pa.array([total.tobytes()], pa.binary())], ["part", "shape", "data"])

    schema = "part int, shape string, data binary"
    parts = df.mapInArrow(partition, schema).repartition(groups, "part").sortWithinPartitions("part", "data").mapInArrow(group, schema).collect()
    if not parts:
        return None
    total = sum(np.frombuffer(r.data) for r in sorted(parts, key=lambda r: bytes(r.data)))
    out, at = [], 0
    for s in parts[0].shape.split(","):
        dims = [int(v) for v in s.split("x")]
        out.append(total[at : at + math.prod(dims)].reshape(dims))
        at += math.prod(dims)
    return out


class Projection:
    """Standardised statistics to random Fourier features (and the standardised statistics and 1 themselves)."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, width: float, features: int = FEATURES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.scale = math.sqrt(2 / features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.column_stack([self.scale * np.cos(z @ self.w + self.b), 0.1 * z / math.sqrt(z.shape[1]), np.ones(len(z))])


def fit(rows: DataFrame, fitting: Column, ridge: float, width: float):
    """(projection, weights, bin places, bin rates) from rows (_label, _x, _label_id), or None without labelled rows of both classes."""
    first = rows.filter(fitting)

    def moments(batch):
        x, y = matrix(batch), np.asarray(batch.column("_label"), dtype=float)
        return [np.array([float(len(x)), y.sum()]), x.sum(0), (x * x).sum(0)]

    total = summed(first.select("_label", "_x"), moments)
    if total is None or not 0 < total[0][1] < total[0][0]:
        return None
    n, positive = total[0]
    mean = total[1] / n
    projection = Projection(mean, np.sqrt(np.maximum(total[2] / n - mean * mean, 0)), width)
    # the rarer class weighs as much as the other
    weight = (n / (2 * (n - positive)), n / (2 * positive))

    def normal(batch):
        p, y = projection(matrix(batch)), np.asarray(batch.column("_label"), dtype=float)
        q = p * np.where(y > 0, weight[1], weight[0])[:, None]
        return [q.T @ p, q.T @ y]

    xx, xy = summed(first.select("_label", "_x"), normal)
    penalty = np.full(len(xy), ridge * n / 1000)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(xx + np.diag(penalty), xy)

    def binned(batch):
        raw, y = projection(matrix(batch)) @ weights, np.asarray(batch.column("_label"), dtype=float)
        b = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return [np.bincount(b, minlength=BINS).astype(float), np.bincount(b, weights=y, minlength=BINS), np.bincount(b, weights=raw, minlength=BINS)]

    held = summed(rows.filter(~fitting).select("_label", "_x"), binned)
    if held is None:
        held = summed(first.select("_label", "_x"), binned)
    count, positives, raw = held
    places, rates = isotonic(raw / np.maximum(count, 1), count, positives)
    return projection, weights, places, rates


def quality(
    docs: DataFrame, labels: DataFrame, learnable: Column, fitting: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, ridge: float = 0.3, width: float = 6.0,
) -> DataFrame:
    """One row per input row: id, score (0 to 1, higher is likelier good), predicted (1 if score >= ``threshold``).

    Labels are learnt only from rows for which ``learnable`` (a condition on _label_id) holds: those with ``fitting`` fit the ridge scores, the
    others the calibration. Only texts decide. A null text counts as empty and is scored like any other. Rows that repeat are scored each; an empty table gives no
    rows; where labels lack one class all scores are 1. Texts are read once, their statistics (a few numbers a document) are written and met with the labels.
    """
    table = written(with_statistics(docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")), ["_id"]), "statistics")
    scored = scores(table, labels, learnable, fitting, id_col, label_col, ridge, width)
    return scored.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(
    docs: DataFrame, labels: DataFrame, learnable: Column, fitting: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, ridge: float = 0.3, width: float = 6.0,
) -> DataFrame:
    """The rows of ``docs`` that ``quality`` predicts to be good, with all their columns.

    Rows are written once beside their statistics, so that the decision is taken in the row: texts are read once and never move. Edge cases: see ``quality``; rows that
    repeat, and rows with a null id, each go by their own text.
    """
    own = [f"_column{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, own))
    rows = docs.toDF(*own)
    table = written(with_statistics(rows, own, named[text_col]).withColumn("_id", F.col(named[id_col])), "statistics")
    scored = scores(table, labels, learnable, fitting, id_col, label_col, ridge, width)
    return scored.filter(F.col("score") >= threshold).select(*own).toDF(*docs.columns)


def scores(table: DataFrame, labels: DataFrame, learnable: Column, fitting: Column, id_col: str, label_col: str, ridge: float, width: float) -> DataFrame:
    """The rows of ``table`` (_id, _x, ...) with ``score`` for _x, learnt from those with labels."""
    known = labels_of(labels, label_col, id_col).filter(learnable)
    rows = written(table.select("_id", "_x").join(known, F.col("_id") == F.col("_label_id")).select("_label_id", "_label", "_x"), "labelled")
    fitted = fit(rows, fitting, ridge, width)
    keep = [c for c in table.columns if c != "_x"]
    if fitted is None:
        return table.select(*keep, F.lit(1.0).alias("score"))
    shared = table.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, weights, places, rates = shared.value
        for batch in batches:
            if batch.num_rows:
                raw = projection(matrix(batch)) @ weights
                # between blocks the rate rises evenly; a thousandth goes by the raw score, so that order is kept within blocks
                score = 0.999 * np.interp(raw, places, rates) + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], [*keep, "score"])

    return table.mapInArrow(run, T.StructType([*(table.schema[c] for c in keep), T.StructField("score", T.DoubleType())]))
