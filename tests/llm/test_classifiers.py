"""Classifiers on held-out labels, and their rules."""

import os
import zlib

import numpy as np
import pytest

from tidemark.llm import pairwise_quality, toxicity_fm
from tidemark.llm.common import table
from tidemark.llm.labels import CUT, quantile_threshold, to_score

SF = "/root/testdata/sf0.01"


def test_pairs_order_documents():
    random = np.random.default_rng(0)
    x = random.normal(size=(400, 3))
    better, worse = x[:200] + [1.5, 0, 0], x[200:]
    w = pairwise_quality.fit_pairs(better, worse)
    assert w[0] > 3 * max(abs(w[1]), abs(w[2]))


def test_threshold_is_a_quantile():
    u, y = np.arange(10.0), np.array([0] * 3 + [1] * 7)
    assert quantile_threshold(u, y) == (0.3, 2.5)
    assert to_score(2.5, 2.5) == pytest.approx(CUT) and to_score(3, 2.5) > CUT > to_score(2, 2.5)
    assert quantile_threshold(u, np.ones(10, int))[1] < 0 and quantile_threshold(u[:0], y[:0]) == (0.0, 0.0)


def test_interaction_is_learned():
    """Two terms that mean something only together: weights alone can't tell."""
    random = np.random.default_rng(3)
    texts, label = [], []
    for _ in range(1500):
        a, b = random.random() < 0.12, random.random() < 0.12
        if random.random() < 0.1:
            a = b = True
        noise = random.choice(np.arange(100, 160), 8, replace=False)
        texts.append(np.unique(np.concatenate([noise, [1] * a, [2] * b]).astype(np.int64)))
        label.append(int(a and b))
    label = np.array(label)
    rows, starts = toxicity_fm.table_of(texts, np.array([1, 2]))
    share = np.full(len(texts), 1 / len(texts))
    b, w, v = toxicity_fm.descend(rows, starts, label, share, 2, 4, 400, 0.0, 1e-4)
    assert v[0] @ v[1] > 0.5
    u, _ = toxicity_fm.machine(rows, starts, b, w, v)
    brute = [b + sum(w[i] for i in r) + sum(v[i] @ v[j] for k, i in enumerate(r) for j in r[k + 1 :]) for r in np.split(rows, starts[1:-1])]
    assert np.allclose(u, brute)


def test_fit_keeps_terms_that_matter_only_in_pairs(spark, make_docs):
    """Each of two words stands equally often in toxic and clean texts, together only in toxic ones."""
    random = np.random.default_rng(5)
    texts, label = [], []
    for _ in range(3000):
        toxic, at = random.random() < 0.3, random.random()
        pair = ["ab", "cd"] if toxic and at < 0.12 else [] if toxic else ["ab"] * (at < 0.12) + ["cd"] * (0.12 <= at < 0.24)
        texts.append(" ".join(pair + [f"n{i}" for i in random.choice(60, 8, replace=False)]))
        label.append(int(toxic))
    model = toxicity_fm.fit([np.unique([toxicity_fm.bucket(x) for x in toxicity_fm.terms(t)]) for t in texts], np.array(label))
    rest = " n1 n2 n3 n4 n5 n6 n7 n8"
    got = {r["doc_id"]: r["predicted"] for r in toxicity_fm.score(make_docs([(1, "ab cd" + rest), (2, "ab" + rest), (3, "cd" + rest)]), model).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_factors_help_on_held_out_labels():
    """Ranks held-out documents of sf0.1 better with factors than without, and finds more of the toxic ones."""
    import pyarrow.parquet as pq

    docs, labels = (pq.read_table(f"/root/testdata/sf0.1/{x}.parquet").to_pydict() for x in ("documents", "labels"))
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    rows = [(np.unique([toxicity_fm.bucket(x) for x in toxicity_fm.terms(texts[i] or "")]).astype(np.int64), y, zlib.crc32(str(i).encode()) % 3 == 1) for i, y in zip(labels["doc_id"], labels["toxic"], strict=True) if i in texts]
    held, y = [x for x, _, h in rows if h], np.array([y for _, y, h in rows if h])
    auc, recall = [], []
    for factors in (0, toxicity_fm.FACTORS):
        m = toxicity_fm.fit([x for x, _, h in rows if not h], np.array([y for _, y, h in rows if not h]), factors)
        u, _ = toxicity_fm.machine(*toxicity_fm.table_of(held, m.buckets), m.bias, m.weights, m.factors)
        auc.append((u[y == 1][:, None] > u[y == 0]).mean())
        recall.append((u[y == 1] >= m.threshold).mean())
    assert auc[1] > auc[0] > 0.98 and recall[1] >= recall[0] > 0.85


def test_fit_keeps_frequent_and_many_terms():
    """A word of a third of the texts tells them; some 11,000 others don't."""
    random = np.random.default_rng(7)
    label = np.arange(900) % 3 == 0
    texts = [np.unique(np.concatenate([random.choice(np.arange(100, 11_600), 250, replace=False), [1] * int(y)])).astype(np.int64) for y in label]
    model = toxicity_fm.fit(texts, label.astype(int))
    assert model.weights[model.index()[1]] == model.weights.max() > 0 and len(model.buckets) > 10_000


def test_beginnings_of_words_are_terms():
    assert {b"idiotic", b"idio*", b"idiot*"} <= toxicity_fm.terms("An IDIOTIC, text") and toxicity_fm.terms("") == set()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("module,column,folds,held,least", [(pairwise_quality, "quality", 4, 2, 0.95), (toxicity_fm, "toxic", 3, 1, 0.85)])
def test_held_out_labels(spark, module, column, folds, held, least):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in module.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) for i, r in got.items())
    rest = [(got[r["doc_id"]]["predicted"], r[column]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in rest]) >= max(least, np.mean([b == 0 for _, b in rest]) + 0.02, np.mean([b == 1 for _, b in rest]) + 0.02)


@pytest.mark.parametrize("module,kept", [(pairwise_quality, 1), (toxicity_fm, 0)])
def test_odd_texts_and_missing_labels(spark, odd, none, module, kept):
    labels = spark.createDataFrame([(None, 1, 1), (4, None, 5), (4, 1, 0), (5, 0, 1), (6, 1, 0), (9, 0, 1), (7, 1, 0), (777, 1, 1)], "doc_id long, quality int, toxic int")
    rows = module.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    assert module.classify(none, labels).count() == 0
    assert {r["predicted"] for r in module.classify(odd, labels.limit(0)).collect()} == {kept}
