"""Toxicity by a factorization machine over hashed terms.

Each distinct term of a text, a word or the beginning of one, is hashed to one of many buckets. The score adds a weight for each bucket and, for each pair of buckets, the
inner product of their factors, so that two terms together may tell more than both alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_fold, give_back, map_texts
from tidemark.llm.labels import CUT, SAMPLE_ROWS, labelled_sample, quantile_threshold, sigmoid, to_score

FOLDS, HELD_OUT = 3, 1
BUCKET_BITS = 24
FACTORS = 4
#: In how many of the fitted texts each bucket of the model stands at least, and the share of them beyond which a bucket counts less.
LEAST_TEXTS, COMMON_TEXTS = 12, 0.05
#: Pressure towards few weights, and towards small factors; a bucket without a weight keeps its factors. Steps of the fit of each, and the factors' first step.
SPARSE, RIDGE, STEPS, FACTOR_STEPS, FIRST_RATE = 2e-3, 0.006, 100, 60, 2.0
#: How much more a clean text counts than a toxic one when the threshold is placed.
CARE = 1.5
#: Bytes of the beginnings of words that are terms too: inflected forms share them.
BEGINNINGS = (4, 5)

#: ASCII letters in lower case, other ASCII signs as blanks.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: str) -> set[bytes]:
    words = set(text.encode().translate(_FOLD).split())
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + b"*" for w in words if len(w) > n])
    return out


def bucket(term: bytes) -> int:
    return zlib.crc32(term) >> (32 - BUCKET_BITS)


@dataclass(frozen=True)
class FactorModel:
    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    threshold: float

    def index(self) -> dict[int, int]:
        return {int(b): i for i, b in enumerate(self.buckets)}


def machine(rows: np.ndarray, starts: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Utilities of texts and the sums of their factors. rows: the texts' terms one after another; starts: where each text's begin, then the end."""
    n = len(starts) - 1
    sums = np.zeros((n, factors.shape[1]))
    linear, squares = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        at = starts[:-1][full]
        for k in range(factors.shape[1]):  # one column at a time, for the driver's memory
            v = factors[:, k][rows]
            sums[full, k] = np.add.reduceat(v, at)
            squares[full] += np.add.reduceat(np.square(v, out=v), at)
        linear[full] = np.add.reduceat(weights[rows], at)
    return bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def descend(rows, starts, label, share, terms: int, factors: int, steps: int, sparse: float, ridge: float, seed: int = 11, scale: np.ndarray | None = None):
    """Bias, weights and factors that lower the weighted logistic loss, by accelerated proximal steps over all texts.

    ``sparse`` drives the weights of terms that hardly lower the loss to 0; ``ridge`` keeps factors small. A term of a ``scale`` below 1 pays
    more of both for the same effect.
    """
    n = len(starts) - 1
    scale = np.ones(terms) if scale is None else scale
    rows = rows.astype(np.int32)
    order = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[np.argsort(rows, kind="stable")]
    full, count = np.flatnonzero(np.diff(starts)), np.bincount(rows, minlength=terms)
    used = np.flatnonzero(count)
    text_at, term_at = starts[:-1][full], (np.cumsum(count) - count)[used]

    def by_text(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[full] = np.add.reduceat(x.astype(np.float32)[rows], text_at)
        return out

    def by_term(x: np.ndarray) -> np.ndarray:
        out = np.zeros(terms)
        out[used] = np.add.reduceat(x.astype(np.float32)[order], term_at)
        return out

    w, v, b = np.zeros(terms), np.random.default_rng(seed).normal(0, 0.02, (terms, factors)), 0.0
    # The largest curvature of the linear part gives the step that is safe.
    x, top = np.ones(terms), 1.0
    for _ in range(8):
        x = scale * by_term(by_text(scale * x) * share)
        top = float(np.linalg.norm(x)) or 1.0
        x /= top
    rate = 4 / (1 + top)
    ow, ov, momentum = w, v, 1.0
    for _ in range(steps):
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        push = (momentum - 1) / faster
        lw, lv, momentum = w + push * (w - ow), v + push * (v - ov), faster
        ow, ov = w, v
        sv = scale[:, None] * lv
        sums = [by_text(sv[:, k]) for k in range(factors)]
        u = b + by_text(scale * lw) + 0.5 * (sum(s * s for s in sums) - by_text((sv * sv).sum(1)))
        g = (sigmoid(u) - label) * share
        gw = by_term(g)
        w = lw - rate * scale * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
        if factors:
            gv = np.stack([by_term(g * s) for s in sums], 1) - sv * gw[:, None]
            v = lv - 0.25 * rate * (scale[:, None] * gv + ridge * lv)
        b -= rate * g.sum()
    return b, scale * w, scale[:, None] * v


def residual_factors(rows, starts, label, share, utility, terms: int, factors: int, steps: int, ridge: float, scale: np.ndarray, judge, seed: int = 11) -> np.ndarray:
    """Factors that lower the loss which the weights leave; ``utility`` is what those give.

    Accelerated steps, halved where the loss rises; of all steps, the factors that ``judge`` finds the lowest loss for are taken, none among them.
    """
    n = len(starts) - 1
    rows = rows.astype(np.int32)
    order = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[np.argsort(rows, kind="stable")]
    full, count = np.flatnonzero(np.diff(starts)), np.bincount(rows, minlength=terms)
    used = np.flatnonzero(count)
    text_at, term_at = starts[:-1][full], (np.cumsum(count) - count)[used]
    sign = 2 * label - 1

    def gathered(x, index, at, where, size):
        out = np.zeros((size, x.shape[1]))
        for k in range(x.shape[1]):  # one column at a time, for the driver's memory
            out[where, k] = np.add.reduceat(x[:, k].astype(np.float32)[index], at)
        return out

    none = np.zeros((terms, factors))
    v = old = np.random.default_rng(seed).normal(0, 0.02, (terms, factors))
    rate, momentum, last, best = FIRST_RATE, 1.0, np.inf, (judge(none), none)
    for step in range(steps if len(used) and factors else 0):
        faster = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = v + (momentum - 1) / faster * (v - old)
        own = scale[:, None] * ahead
        sums = gathered(np.hstack([own, (own * own).sum(1)[:, None]]), rows, text_at, full, n)
        u = utility + 0.5 * ((sums[:, :-1] ** 2).sum(1) - sums[:, -1])
        loss = float((share * np.logaddexp(0, -u * sign)).sum() + 0.5 * ridge * (ahead * ahead).sum())
        if not loss <= last + 1e-3:  # a step too far: back, and on by half of it
            rate, momentum, v = rate / 2, 1.0, old
            last = np.inf
            continue
        last = loss
        g = ((sigmoid(u) - label) * share)[:, None]
        back = gathered(np.hstack([g * sums[:, :-1], g]), order, term_at, used, terms)
        old, momentum = v, faster
        v = ahead - rate * (scale[:, None] * (back[:, :-1] - own * back[:, -1:]) + ridge * ahead)
        if step % 4 == 3 and (found := judge(scale[:, None] * v)) < best[0]:
            best = (found, scale[:, None] * v)
    return best[1]


def table_of(texts: list[np.ndarray], buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' places in ``buckets``, one text after another, and where each text's begin."""
    rows = []
    for t in texts:
        at = np.minimum(np.searchsorted(buckets, t), len(buckets) - 1)
        rows.append(at[buckets[at] == t].astype(np.int32) if len(buckets) else t[:0])
    return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def fit(texts: list[np.ndarray], label: np.ndarray, factors: int = FACTORS) -> FactorModel:
    """Logistic loss, both classes weighing the same: first the weights of all terms of enough texts, then factors for what those leave.

    A term needs no weight of its own to get factors: it may matter only beside another. Terms of many texts count less, but stay.
    One text in five isn't fitted: it tells when to stop, and places the threshold.
    """
    if not len(texts) or label.min() == label.max():
        return FactorModel(np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, factors)), 1.0)
    fitted = np.arange(len(texts)) % 5 != 4
    share = np.where(label == 1, 0.5 / max(1, (label[fitted] == 1).sum()), 0.5 / max(1, (label[fitted] == 0).sum()))
    found, count = np.unique(np.concatenate(texts), return_counts=True)
    keep = count >= min(LEAST_TEXTS, max(2, len(texts) // 20))
    buckets, scale = found[keep], np.sqrt(np.minimum(1, COMMON_TEXTS * len(texts) / count[keep]))
    rows, starts = table_of([texts[i] for i in np.flatnonzero(fitted)], buckets)
    b, w, _ = descend(rows, starts, label[fitted], share[fitted], len(buckets), 0, STEPS, SPARSE, 0.0, scale=scale)
    rest = np.flatnonzero(~fitted if len(set(label[~fitted])) == 2 else np.ones(len(texts), bool))
    other = table_of([texts[i] for i in rest], buckets)

    def judge(v: np.ndarray) -> float:
        return float((share[rest] * np.logaddexp(0, -machine(*other, b, w, v)[0] * (2 * label[rest] - 1))).sum())

    u, _ = machine(rows, starts, b, w, np.zeros((len(buckets), 0)))
    v = residual_factors(rows, starts, label[fitted], share[fitted], u, len(buckets), factors, FACTOR_STEPS, RIDGE, scale, judge)
    u, _ = machine(*other, b, w, v)
    _, threshold = quantile_threshold(u, label[rest], CARE)
    return FactorModel(buckets, b, w, v, threshold)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> FactorModel:
    """Fits on a sample of at most about ``rows`` labelled documents outside the held-out fold; their hashed terms reach the driver."""
    sample = labelled_sample(docs, labels, column, folds, held_out, rows)
    hashed = map_texts(sample, lambda: lambda texts: [([bucket(x) for x in terms(t)],) for t in texts], "terms array<int>", ("doc_id", "label"))
    got = hashed.select("label", "terms").toArrow()
    texts = [np.unique(x.values.to_numpy(zero_copy_only=False)) if len(x.values) else np.zeros(0, np.int32) for x in got.column("terms").combine_chunks()] if got.num_rows else []
    label = np.array(got.column("label").to_pylist(), dtype=int)
    del got
    model = fit(texts, label)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: FactorModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, score (0 to 1, higher: more toxic) and predicted of each whole text; null and empty texts have no terms."""

    def make():
        index = model.index()

        def run(texts):
            rows, lengths = [], []
            for t in texts:
                own = {i for x in terms(t) if (i := index.get(zlib.crc32(x) >> (32 - BUCKET_BITS))) is not None}
                rows += own
                lengths.append(len(own))
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            s = to_score(machine(np.array(rows, np.int64), starts, model.bias, model.weights, model.factors)[0], model.threshold)
            return [(float(v), int(v >= CUT)) for v in s]

        return run

    return map_texts(docs, make, "score double, predicted int", keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Without labelled rows of both kinds all documents score alike, below the cut. Null and empty texts have no terms, and the bias is
    their score; texts of any length are read whole. Null ids are never held out; repeated rows are scored once each; other columns are not
    looked at. No rows give no rows.
    """
    model = train(docs, labels)
    return score(docs, model).select("doc_id", F.coalesce(crc32_fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
