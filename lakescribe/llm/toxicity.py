"""Toxicity by class-conditional Kneser-Ney models of words' letters.

For each class a Kneser-Ney model gives the probability of each letter of a word after the letters before it (and of
the word's end). Orders up to ``SHARED`` are one distribution for both classes, from the continuation counts of all rows, so a letter
sequence that is rare in both classes falls back to the same probability and says nothing. A word's evidence is the difference of its toxic and
ordinary log-likelihoods. It depends on the word alone, so each distinct word is scored once per Python worker and kept in a bounded
table. A document's score compares the two length-normalised log-likelihoods: per word, over all words, and over those words that favour the toxic
model; a logistic calibration learnt on rows that the models have not seen turns them into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of
from .labelled import bounded_sample, labels_of, logistic

ORDER = 5
SHARED = 2
DISCOUNT = 0.75
#: Evidence of a word (in nats) from which it counts as favouring the toxic model.
FAVOURS = 2.0
KEPT_WORDS = 300_000
KEPT_LENGTH = 40
FEATURES = 4

_WORD_BYTES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NOT_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[bytes]:
    """The lower-cased words of a text: runs of letters, in UTF-8."""
    low = text.lower()
    if low.isascii():
        return low.encode().translate(_WORD_BYTES).split()
    return [w.encode() for w in _NOT_LETTERS.findall(low)]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of order ``ORDER`` ending at each letter and at each word's end (letters before a word are spaces), and each one's word."""
    pad = b" " * (ORDER - 1)
    buffer = np.frombuffer(pad + pad.join(words) + pad, dtype=np.uint8).astype(np.uint64)
    code = buffer.copy()
    for k in range(1, ORDER):
        code[k:] |= buffer[:-k] << np.uint64(8 * k)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    word = np.repeat(np.arange(len(words)), lengths + 1)
    at = np.arange(len(word)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1) + np.repeat(starts, lengths + 1)
    return code[at], word


class Model:
    """Differences of toxic and ordinary log-probabilities, by n-gram and by context, for both Kneser-Ney models at once."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        """``codes`` ascending packed n-grams of the highest order, ``counts`` (2, n) their counts in ordinary and toxic rows."""
        levels: list = [None] * (ORDER + 1)
        levels[ORDER] = (codes, counts.astype(float))
        for k in range(ORDER - 1, 0, -1):
            above, n = levels[k + 1]
            u, inverse = np.unique(above & np.uint64((1 << 8 * k) - 1), return_inverse=True)
            # shared orders count a sequence that both classes have once
            either = [n.max(0)] * 2 if k <= SHARED else n
            levels[k] = (u, np.array([np.bincount(inverse, weights=(x > 0), minlength=len(u)) for x in either]))
        self.gram, self.context = [None] * (ORDER + 1), [None] * (ORDER + 1)
        u, n = levels[1]
        p = (n + 0.5) / (n.sum(1, keepdims=True) + 128)
        self.gram[1] = (u, np.log(p[1] / p[0]))
        for k in range(2, ORDER + 1):
            lower = u
            u, n = levels[k]
            contexts, of = np.unique(u >> np.uint64(8), return_inverse=True)
            total = np.array([np.bincount(of, weights=n[c], minlength=len(contexts)) for c in (0, 1)])
            kinds = np.array([np.bincount(of, weights=(n[c] > 0), minlength=len(contexts)) for c in (0, 1)])
            backoff = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            below = p[:, np.searchsorted(lower, u & np.uint64((1 << 8 * (k - 1)) - 1))]
            p = np.maximum(n - DISCOUNT, 0) / np.maximum(total[:, of], 1) + backoff[:, of] * below
            self.gram[k] = (u, np.log(p[1] / p[0]))
            self.context[k] = (contexts, np.log(backoff[1] / backoff[0]))

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        if not words:
            return np.zeros(0)
        code, word = grams(words)
        out, todo = np.zeros(len(code)), np.arange(len(code))

        def found(pairs, x):
            keys, values = pairs
            i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[i] == x
            return hit, values[i[hit]]

        for k in range(ORDER, 0, -1):
            x = code[todo] & np.uint64((1 << 8 * k) - 1)
            hit, values = found(self.gram[k], x)
            out[todo[hit]] += values
            todo, x = todo[~hit], x[~hit]
            if k > 1 and len(todo):
                hit, values = found(self.context[k], x >> np.uint64(8))
                out[todo[hit]] += values
        return np.bincount(word, weights=out, minlength=len(words))


_kept: dict = {}


def document_features(texts: list[str | None], model: Model, version: str) -> np.ndarray:
    """(documents, FEATURES): see ``features_of``; words' evidence is kept in the worker for this model."""
    if _kept.get("version") != version:
        _kept.clear()
        _kept.update(version=version, words={})
    kept: dict[bytes, float] = _kept["words"]
    split = [words_of(t or "") for t in texts]
    unknown = list(set().union(*split).difference(kept)) if split else []
    kept.update(zip(unknown, model.evidence(unknown).tolist()))
    out = np.zeros((len(texts), FEATURES))
    for i, words in enumerate(split):
        if words:
            out[i] = features_of(np.fromiter(map(kept.__getitem__, words), dtype=float, count=len(words)))
    too_many = unknown[: max(0, len(kept) - KEPT_WORDS)] + [w for w in unknown if len(w) > KEPT_LENGTH]
    for w in too_many:
        kept.pop(w, None)
    return out


def features_of(evidence: np.ndarray) -> np.ndarray:
    """Of a document's words: mean evidence; mean and root-length mean of what is above FAVOURS; the largest."""
    n = len(evidence)
    above = np.maximum(evidence - FAVOURS, 0).sum()
    return np.array([evidence.mean(), np.log1p(100 * above / n), np.log1p(above / np.sqrt(n)), max(evidence.max(), 0.0)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learnable: Column, calibrating: Column, max_rows: int):
    """(model, weights) from at most ``max_rows`` labelled rows; None where a class has no rows.

    ``learnable`` and ``calibrating`` are conditions on _label_id. ``max_rows`` alone bounds the model: all n-grams of these rows are in it.
    """
    sample = bounded_sample(labels_of(labels, label_col, id_col), max_rows, learnable).withColumn("_calibrating", calibrating)
    # the sample has max_rows rows of a few bytes at most, so that it may be sent to all executors
    rows = docs.select(F.col(id_col).alias("_label_id"), text_of(text_col).alias("_text")).join(F.broadcast(sample), "_label_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_class: dict[int, dict] = {}
            labels_ = batch.column("_label").to_pylist()
            texts = batch.column("_text").to_pylist()
            for c in (0, 1):
                words = [w for t, label in zip(texts, labels_) if label == c for w in words_of(t)]
                by_class[c] = np.unique(grams(words)[0], return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            codes = np.concatenate([by_class[c][0] for c in (0, 1)]).view(np.int64)
            n = [np.concatenate([by_class[c][1] if c == k else np.zeros(len(by_class[c][1]), np.int64) for c in (0, 1)]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n[0]), pa.array(n[1])], ["code", "ordinary", "toxic"])

    counted = rows.filter(~F.col("_calibrating")).select("_label", "_text").mapInArrow(count, "code long, ordinary long, toxic long")
    counts = counted.groupBy("code").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    counts = counts.toArrow()
    codes = counts.column("code").to_numpy().view(np.uint64)
    order = np.argsort(codes)
    both = np.array([counts.column(c).to_numpy() for c in ("ordinary", "toxic")])
    if not len(codes) or not both.sum(1).all():
        return None
    model = Model(codes[order], both[:, order])
    held = features(rows.filter("_calibrating").select("_label", "_text"), ["_label"], model).toPandas()
    y = held["_label"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return model, np.array([0.0, 1.0, 0.0, 0.0, -2.0])
    return model, logistic(np.array(held["_features"].tolist()), y)


def features(df: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """``keep`` columns and _features of column _text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    version = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            x = document_features(batch.column("_text").to_pylist(), shared.value, version)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x.tolist(), pa.list_(pa.float64()))], [*keep, "_features"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("_features", T.ArrayType(T.DoubleType()))])
    return df.select(*keep, "_text").mapInArrow(run, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, learnable: Column, calibrating: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    threshold: float = 0.3, max_rows: int = 30_000,
) -> DataFrame:
    """One row per input row: id, score (0 to 1, higher is likelier toxic), predicted (1 if score >= ``threshold``).

    Labels are learnt only from rows for which ``learnable`` (a condition on _label_id) holds, at most ``max_rows`` of them; of these,
    those with ``calibrating`` fit the calibration and the others the two models. Only words decide: other columns are never looked at. A null text
    counts as empty; texts without words get the score of no evidence. Rows that repeat are scored each; an empty table gives no
    rows. Where the labels lack one class all scores are 0. Nothing of the documents is shuffled.
    """
    fitted = fit(docs, labels, id_col, text_col, label_col, learnable, calibrating, max_rows)
    ids = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    if fitted is None:
        score = ids.select("_id", F.lit(0.0).alias("score"))
    else:
        model, weights = fitted
        z = sum((F.col("_features")[i] * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
        score = features(ids, ["_id"], model).select("_id", (1 / (1 + F.exp(-z))).alias("score"))
    return score.select(F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
