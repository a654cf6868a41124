"""Quality scores by a naive Bayes support vector machine.

Features are indicators: hashed byte bigrams and trigrams of the whole text,
and how often a word repeats the one before it (a count and a share, in
buckets). Each indicator is scaled by its log-count ratio between the classes;
dual coordinate descent then fits a linear hinge-loss model, whose margin a
logistic curve turns into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.common import crc_bucket, labelled_sample, logistic, logistic_fit, table, with_columns

DIMENSIONS = 1 << 16
#: Bounds of the labelled rows that the model is fitted on: rows of each class, characters in all.
SAMPLE_PER_CLASS = 5000
SAMPLE_CHARS = 40_000_000
THRESHOLD = 0.3
_SHARES = (0.0, 0.01, 0.03, 0.1, 0.25, 0.5)
_REPEAT_COUNTS = 8
_ALL = DIMENSIONS + _REPEAT_COUNTS + len(_SHARES) + 1
_BLOCK = 1 << 20


def _codes(data: bytes) -> np.ndarray:
    p = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    two = p[:-1] * np.uint32(0x9E3779B1) + p[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + p[2:] * np.uint32(0x27D4EB2F)
    return np.concatenate((two, three)) >> np.uint32(16)


def indicators(text: str) -> np.ndarray:
    """The sorted numbers of the features that a whole text has."""
    data = text.encode("utf-8", "surrogatepass")
    there = np.zeros(_ALL, bool)
    repeats = words = 0
    last = None
    for at in range(0, max(len(data), 1), _BLOCK):
        there[_codes(data[at : at + _BLOCK])] = True
        own = data[at : at + _BLOCK].lower().split()
        words += len(own)
        repeats += sum(map(bytes.__eq__, own, [last, *own[:-1]])) if last is not None else sum(map(bytes.__eq__, own[1:], own))
        last = own[-1] if own else last
    there[DIMENSIONS + min(repeats.bit_length(), _REPEAT_COUNTS - 1)] = True
    share = repeats / max(words, 1)
    there[DIMENSIONS + _REPEAT_COUNTS + sum(share > s for s in _SHARES)] = True
    return np.flatnonzero(there)


def _log_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    sums = [np.ones(_ALL), np.ones(_ALL)]
    for at, y in zip(rows, labels.tolist(), strict=True):
        sums[y][at] += 1
    return np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """(weights, bias) that minimise half their squared norm and the hinge losses times ``cost``; rows have norm one."""
    sign, alpha = np.where(labels > 0, 1.0, -1.0), np.zeros(len(rows))
    w, bias, order = np.zeros(_ALL), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            at, value, y = rows[i], values[i], sign[i]
            new = min(max(alpha[i] - (y * (w[at] @ value + bias) - 1) / 2, 0.0), cost[i])  # each row's squared norm with the bias is 2
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[at] += step * y * value
                bias += step * y
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class QualityModel:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    curve: tuple[float, float]

    def margin(self, at: np.ndarray) -> float:
        r = self.ratio[at]
        return float(self.weights[at] @ r / max(np.linalg.norm(r), 1e-12)) + self.bias

    def score(self, text: str) -> float:
        return logistic(self.curve[0] * self.margin(indicators(text)) + self.curve[1])


def _fit_margin(rows: list[np.ndarray], labels: np.ndarray, cost: np.ndarray) -> QualityModel:
    ratio = _log_ratio(rows, labels)
    values = [ratio[at] / max(np.linalg.norm(ratio[at]), 1e-12) for at in rows]
    return QualityModel(ratio, *dual_coordinate_descent(rows, values, labels, cost), (1.0, 0.0))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> QualityModel:
    """Learn from the labelled rows; without both classes every score is the share of label 1 (a half if there is none).

    The curve is fitted on margins of rows that the model fitting them has not
    seen (five folds), weighted so that the classes stand as in all labels.
    """
    sample, totals = labelled_sample(docs, labels, label, per_class, SAMPLE_CHARS)
    table_ = with_columns(sample, "text", {"at": "string"}, lambda: lambda t: (",".join(map(str, indicators(t).tolist())),)).select("doc_id", "label", "at").orderBy("doc_id").toPandas()
    y = table_["label"].to_numpy(np.int64)
    rows = [np.array(x.split(","), np.int32) for x in table_["at"]]
    counts = np.bincount(y, minlength=2)
    if counts.min() == 0:
        share = (totals[1] + 0.5) / (totals[0] + totals[1] + 1)
        zero = np.zeros(_ALL)
        return QualityModel(zero, zero, 0.0, (1.0, float(np.log(share / (1 - share)))))
    weight = np.array([totals[c] / counts[c] for c in (0, 1)])[y]
    fold, margins = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        if np.bincount(y[fold != k], minlength=2).min():
            part = np.flatnonzero(fold != k)
            model = _fit_margin([rows[i] for i in part], y[part], np.ones(len(part)))
            for i in np.flatnonzero(fold == k):
                margins[i] = model.margin(rows[i])
    slope, intercept = logistic_fit(margins[:, None], y, weight)
    model = _fit_margin(rows, y, np.ones(len(y)))
    model.curve = (float(slope), float(intercept))
    return model


def score_quality(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each row's whole text; null counts as ''."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, "text", {column: "double"}, lambda: lambda t: (sent.value.score(t),))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.filter(crc_bucket("doc_id", 5) != 0))
    scored = score_quality(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
