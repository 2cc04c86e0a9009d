"""Quality by Bradley-Terry ranking.

A document's utility is linear in features of its text. The weights come from preference pairs, a better and a worse document each, by
logistic loss on the difference of their features; a quantile of the utilities then parts accepted from rejected documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_fold, map_texts
from tidemark.llm.labels import CUT, SAMPLE_ROWS, labelled_sample, quantile_threshold, sigmoid, to_score

FOLDS, HELD_OUT = 4, 2
#: Worse documents that each better one is set against, and the reverse.
OPPONENTS = 8

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _letters in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b"|", b"#$%&*@^~", b"-_+=<>/\\", b"()[]{}", b"\"':;`"), 1):
    _CLASS[list(_letters)] = _i
_CLASS[128:] = 14
CLASSES = 15


def features(text: str) -> list[float]:
    """What a text looks like: shares of letter classes, repetition of words and lines, lengths. Empty texts give zeros but for the constants."""
    data = text.encode()
    n = max(len(data), 1)
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=CLASSES) / n
    words = data.split()
    lines = data.split(b"\n")
    distinct = len(set(words))
    count = max(len(words), 1)
    pairs = len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1)
    return [
        *np.sqrt(shares), np.log1p(len(words)), distinct / count, np.log1p(distinct) / np.log(count + 2), pairs, len(data) / count / 10,
        np.log1p(len(data) / len(lines)), len(set(lines)) / len(lines), np.log1p(shares[7] * n / count * 100), np.log1p(shares[9] * n / count * 100),
        np.log1p(shares[8] * n / count * 100), np.log1p(shares[5] * n / count * 100), float(not words),
    ]


FEATURES = len(features(""))


def expand(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((rows - mean) / scale, -4, 4)
    return np.hstack([x, x * x])


@dataclass(frozen=True)
class PairwiseModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    quantile: float
    threshold: float

    def utility(self, rows: np.ndarray) -> np.ndarray:
        return expand(rows, self.mean, self.scale) @ self.weights


def fit_pairs(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w.(better - worse))), by Newton's method. Row i of both is one pair."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps if len(d) else 0):
        p = sigmoid(-(d @ w))
        gradient = -(d.T @ p) / len(d) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, label: np.ndarray, opponents: int = OPPONENTS, seed: int = 7) -> PairwiseModel:
    """Sets each document against some of the other class, learns the weights, and takes the score quantile that best parts the classes."""
    if not len(rows):
        return PairwiseModel(np.zeros(1), np.ones(1), np.zeros(2), 0.0, 0.0)
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale < 1e-9] = 1.0
    x = expand(rows, mean, scale)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    random = np.random.default_rng(seed)
    if len(good) and len(bad):
        n = max(len(good), len(bad)) * opponents
        better, worse = random.permutation(np.resize(good, n)), random.permutation(np.resize(bad, n))
        weights = fit_pairs(x[better], x[worse])
    else:
        weights = np.zeros(x.shape[1])
    quantile, threshold = quantile_threshold(x @ weights, label)
    return PairwiseModel(mean, scale, weights, quantile, threshold)


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> PairwiseModel:
    """Fits on a sample of at most about ``rows`` labelled documents outside the held-out fold; only their features reach the driver."""
    sample = labelled_sample(docs, labels, column, folds, held_out, rows)
    got = map_texts(sample, lambda: lambda texts: [(list(map(float, features(t))),) for t in texts], "features array<double>", ("doc_id", "label")).select("label", "features").toArrow()
    rows = np.array(got.column("features").to_pylist(), dtype=float).reshape(got.num_rows, FEATURES)
    return fit(rows, np.array(got.column("label").to_pylist(), dtype=int))


def score(docs: DataFrame, model: PairwiseModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, score (0 to 1) and predicted of each whole text; null and empty texts are scored as empty."""

    def make():
        def run(texts):
            if not len(model.weights) > 2:
                return [(CUT, 1)] * len(texts)
            s = to_score(model.utility(np.array([features(t) for t in texts])), model.threshold) if texts else []
            return [(float(v), int(v >= CUT)) for v in s]

        return run

    return map_texts(docs, make, "score double, predicted int", keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Without labelled rows of both kinds all documents score alike and are kept. Null and empty texts are scored as empty, texts of any
    length whole. Null ids are never held out; repeated rows are scored once each; a label or a score never depends on other columns. No
    rows give no rows.
    """
    model = train(docs, labels)
    return score(docs, model).select("doc_id", F.coalesce(crc32_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
