"""Jaccard components, fingerprints and lattice links against brute force."""

import hashlib
import random
import re

from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tidemark.llm import fingerprints as fp
from tidemark.llm import jaccard_groups, lattice
from tidemark.llm.components import components
from tidemark.llm.shingle_sets import linked, parity_map, shingle_sets, signature

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}


@given(st.lists(st.text(st.sampled_from("ab \n\tÀA\x1cé"), max_size=40), max_size=6))
@settings(max_examples=200, deadline=None)
def test_sets(texts):
    got = list(shingle_sets(texts))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for (s, t), (x, y) in combinations(list(zip(got, texts, strict=True)), 2):
        assert len(np.intersect1d(s, x)) == len(shingles(t) & shingles(y)) and (signature(s) == signature(x)) == (shingles(t) == shingles(y))
        apart = len(np.setxor1d(s, x))
        bits = np.bitwise_count(np.frombuffer(parity_map(s), np.uint64) ^ np.frombuffer(parity_map(x), np.uint64)).sum()
        assert bits <= apart


def test_link_bound():
    a = np.arange(100, dtype=np.uint64)
    assert linked(a, a[:75]) and not linked(a, a[:74]) and not linked(a[:0], a[:0]) and linked(a[:1], a[:1])


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = [[word() for _ in range(r.choice((3, 12, 40, 120, 400)))] for _ in range(60)]
    base = [word() for _ in range(100)]
    for _ in range(40):  # a chain of edits: its ends don't link
        base = list(base)
        base[r.randrange(100)] = word()
        rows.append(base)
    for _ in range(30):  # a shared passage doesn't make documents alike unless it is most of them
        rows.append([word() for _ in range(r.choice((2, 5, 40)))] + passage)
    rows += [list(x) for x in r.sample(rows, 15)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rows)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("entries,block,wanted", [(1_200_000, 1500, 1_000_000), (300, 5, 0)])
def test_components_of_documents(make_docs, monkeypatch, entries, block, wanted):
    monkeypatch.setattr(jaccard_groups, "ENTRIES", entries)
    monkeypatch.setattr(jaccard_groups, "BLOCK", block)
    monkeypatch.setattr(jaccard_groups, "WANTED", wanted)
    rows = corpus(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_groups.jaccard_components(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_components_of_odd_documents(odd, none):
    rows = jaccard_groups.jaccard_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got == brute(ODD) and got[9] == (3, 5) and got[1] == (0, 1)
    assert [(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None] == [(1, None)]
    assert jaccard_groups.jaccard_components(none).count() == 0


def test_components_of_graphs(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    for tail in (0, 20, 1000):  # rounds of contraction alone, with a rest for one task, one task alone
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), tail).collect()}
        assert got == {x: find(parent, x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(make_docs):
    rows = [(10 * i, t) for i, t in enumerate(t for _, t in corpus(6))] + [(5, None), (15, ""), (25, "a"), (35, "ein Wort mehr"), (100_000, "last one of all texts here")]
    got = {r["doc_id"]: r for r in fp.fingerprint_documents(make_docs(rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = words_of(t), words_of(edited), words_of(after)
        for x, name in ((b, "near_edited"), (c, "near_next")):
            true = len(a & x) / len(a | x) if a | x else 1.0
            assert abs(got[i][name] - true) < (1e-9 if len(a | x) < fp.K else 0.2)
        assert got[i]["n_shingles"] == len(a) or len(a) >= fp.K and abs(got[i]["n_shingles"] / len(a) - 1) < 0.5
    same = {}
    for i, t in rows:
        assert same.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprints_of_odd_documents(odd, none, make_docs):
    assert fp.fingerprint_documents(odd).count() == len(ODD) and fp.fingerprint_documents(none).count() == 0
    one = fp.fingerprint_documents(make_docs([(1, "a b c d e f g h")])).collect()[0]
    assert one["near_next"] == 1.0


def test_sketches_merge(spark):
    text = " ".join(f"w{i}" for i in range(600))
    parts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 300), (296, 600))]
    df = spark.createDataFrame([("g", p) for p in parts], "g string, t string").select("g", fp.sketch(F.col("t")).alias("s"))
    whole = spark.createDataFrame([(text,)], "t string").select(fp.sketch(F.col("t")).alias("s")).collect()[0]["s"]
    assert fp.merge_sketches(df, ["g"], "s").collect()[0]["s"] == whole
    a, b = [r["s"] for r in df.collect()]
    row = spark.createDataFrame([(whole, a, b)], "w array<bigint>, a array<bigint>, b array<bigint>")
    row = row.select(fp.merged(F.col("a"), F.col("b")).alias("m"), fp.containment(F.col("a"), F.col("w")).alias("c"), fp.distinct_shingles(F.col("w")).alias("n"), fp.parse_fingerprint(fp.fingerprint(F.col("w"))).alias("p")).collect()[0]
    assert row["m"] == whole == row["p"] and row["c"] > 0.8 and 400 < row["n"] < 800



def test_e8_points():
    assert len({tuple(r) for r in lattice.roots()}) == 240 and {float(r @ r) for r in lattice.roots()} == {2.0}
    y = np.random.default_rng(1).normal(size=(300, 8)) * 2
    near = lattice.nearest_e8(y)
    for p, x in zip(near, y, strict=True):
        assert (2 * p == np.rint(2 * p)).all() and p.sum() % 2 == 0 and len(set((p % 1).tolist())) == 1
        assert ((x - p) ** 2).sum() <= ((x - p - lattice.roots()) ** 2).sum(1).min() + 1e-9 and ((x - p) ** 2).sum() <= 1 + 1e-9
    assert all(len({tuple(c) for c in row}) == 9 for row in lattice.cells(y, 8))


def vectors():
    r = np.random.default_rng(7)
    base = r.normal(size=(120, 32))
    near = base[:60] + r.normal(size=(60, 32)) * 0.2
    hub = base[0] + r.normal(size=(80, 32)) * 0.15
    x = np.vstack([base, near, hub]).astype(np.float32)
    return x, np.concatenate([np.arange(120) % 3, np.arange(60) % 3, np.zeros(80, int)])


def test_lattice_links(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 40)
    x, label = vectors()
    rows = [(i, [float(v) for v in e], int(k)) for i, (e, k) in enumerate(zip(x, label, strict=True))]
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 0), (1001, rows[0][1], 0), (1002, rows[0][1], 1), (1003, rows[0][1], None), (1004, None, 0), (1005, [0.0] * 32, 0), (1006, [None] + rows[0][1][1:], 0), (1007, [float("nan")] + rows[0][1][1:], 0), (None, rows[0][1], 0), (1008, [1e30] * 32, 2), (1009, [1.0, 2.0], 2), (1010, [], 2)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, cell string")
    got = {r["vec_id"]: r for r in lattice.lattice_links(df).collect()}
    ok = {i: (np.array(e), k) for i, e, k in rows if i is not None and k is not None and e and None not in e and np.isfinite(e).all() and any(e)}
    parent, links = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)
    for a, b in combinations(sorted(ok), 2):
        (u, k), (v, m) = ok[a], ok[b]
        if k == m and len(u) == len(v) and (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= 0.93:
            links[a] += 1
            links[b] += 1
            p, q = find(parent, a), find(parent, b)
            parent[max(p, q)] = min(p, q)
    assert lattice.lattice_links(df).count() == len(rows)
    found, true = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert 0.97 * true <= found <= true and all(r["n_links"] <= links[i] for i, r in got.items())
    assert all(r["component_id"] == find(parent, i) for i, r in got.items()) and all(r["kept"] == (i in (None, r["component_id"])) for i, r in got.items())
    assert lattice.lattice_links(df.limit(0)).count() == 0
