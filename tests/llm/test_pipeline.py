"""The pipeline against plain versions of its stages."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.llm.test_duplicates import brute
from tests.llm.test_tokens import packed
from tidemark.llm import queries
from tidemark.llm.common import table
from tidemark.llm.surrogates import ENTITY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for i, (name, stage) in enumerate(p.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == before.columns
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {i for i, (_, c) in brute(rows).items() if i == c}
        if name == "PII":
            found = lambda d: {x for r in d.select(F.regexp_extract_all("text", F.lit(ENTITY), 0).alias("e")).collect() for x in r["e"] or ()}
            assert not found(before) & found(docs) and len(found(before)) == len(found(docs))
            assert docs.where("n_chars <> length(text)").count() == 0
    rows = docs.collect()
    packed(rows, 4096)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert sorted(map(str, p.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


CLASH = ["n_entities", "predicted", "score", "row", "rows", "label", "value", "component_id", "_made", "_kept", "text_2"]


def test_repeated_and_odd_rows(spark, odd):
    docs = odd.select("*", *[F.lit(7).alias(c) for c in CLASH])
    kept = p.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("name,stage", p.STAGES[:2] + p.STAGES[3:])
def test_odd_rows_of_other_stages(spark, odd, none, name, stage):
    docs = odd.select("*", *[F.lit(7).alias(c) for c in CLASH])
    rows = stage(spark, docs, SF)
    if name == "best-fit packing":
        assert len(packed_rows := rows.collect()) >= docs.count() and len({r["doc_id"] for r in packed_rows}) == 10
    else:
        assert rows.columns == docs.columns
        assert all(r["predicted"] == 7 and r["n_entities"] == 7 for r in rows.collect())
    assert stage(spark, none.select("*", *[F.lit(7).alias(c) for c in CLASH]), SF).count() == 0


def test_all_are_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.QUERIES) == list(range(1, 11))
