"""Labelled rows for fitting: a bounded sample without the rows of one fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_fold

#: Labelled rows that a fit uses at most, in expectation.
SAMPLE_ROWS = 12_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of about ``rows`` labelled documents whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``.

    Rows are chosen by a hash of doc_id. Null ids and labels other than 0 and 1 are left out; of several labels of an id the largest
    counts. The chosen labels are sent to all executors: ``rows`` bounds them.
    """
    use = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    use = use.where(crc32_fold("doc_id", folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    n = use.count()
    parts = 1 << 30
    chosen = use.where(F.pmod(F.xxhash64("doc_id", F.lit(folds)), F.lit(parts)) < int(parts * min(1.0, rows / max(n, 1))))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: predicted is 1 from this score on.
CUT = 0.7


def to_score(utility, threshold: float):
    """A score of 0 to 1 that is CUT at the threshold."""
    return sigmoid(np.asarray(utility) - threshold + np.log(CUT / (1 - CUT)))


def quantile_threshold(utility: np.ndarray, label: np.ndarray, care: float = 1.0) -> tuple[float, float]:
    """The quantile of utilities that best parts the labels, and a value there: the middle of the gap between two neighbours.

    Best: the largest sum of the share of label 1 above and ``care`` times the share of label 0 below; of equal ones the widest gap. With
    one label only, all utilities are on its side; with none at all, the value is 0.
    """
    if not len(utility):
        return 0.0, 0.0
    if label.min() == label.max():
        return (0.0, float(utility.min()) - 1) if label.min() else (1.0, float(utility.max()) + 1)
    order = np.argsort(utility, kind="stable")
    u, one = utility[order], (label[order] == 1)
    below = np.arange(1, len(u))
    good = (one.sum() - np.cumsum(one)[:-1]) / one.sum() + care * np.cumsum(~one)[:-1] / (~one).sum()
    gap = np.diff(u)
    good = np.where(gap > 0, np.round(good, 12), -1)
    best = np.flatnonzero(good == good.max())
    at = best[np.argmax(gap[best])]
    return float(below[at] / len(u)), float((u[at] + u[at + 1]) / 2)
