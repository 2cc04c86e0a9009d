"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pairwise_quality, toxicity_fm
from tidemark.llm.common import cut, shared_folder, table
from tidemark.llm.jaccard_groups import jaccard_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.surrogates import replace_entities


def _whole(docs: DataFrame) -> DataFrame:
    """row (all columns, whatever their names), text."""
    return docs.select(F.struct("*").alias("row"), "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the pairwise classifier accepts.

    Null and empty texts are scored as empty, repeated rows alike; without labels of both kinds all stay. Columns may have any names. No
    rows give no rows.
    """
    model = pairwise_quality.train(docs, table(spark, sf_dir, "labels"))
    return pairwise_quality.score(_whole(docs), model, ("row",)).where("predicted = 1").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorization machine doesn't call toxic.

    Null and empty texts get the score of a text without terms, repeated rows alike; without labels of both kinds all stay. Columns may have
    any names. No rows give no rows.
    """
    model = toxicity_fm.train(docs, table(spark, sf_dir, "labels"))
    return toxicity_fm.score(_whole(docs), model, ("row",)).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of links, once; documents without an id stay.

    Texts that are null, empty or without words link with nothing. Of rows of one id one stays, the smallest text, if links lead to no smaller id.
    """
    found = jaccard_components(docs)
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"))
    rest = docs.join(gone, "doc_id", "left_anti")
    again = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return rest.join(repeated, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(again)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in all texts; n_chars, if there is such a column, follows the new text.

    Null and empty texts stay as they are, equal texts are replaced alike. Columns may have any names. No rows give no rows.
    """
    made = replace_entities(_whole(docs), keep=("row",))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences.

    Null and empty texts are the end id alone, repeated rows are packed once each. No rows give no rows.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: No stage but the last can be had in SQL; tests hold the pipeline against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    root = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{i}")
        docs = spark.read.parquet(f"{root}/{i}")
    return docs
