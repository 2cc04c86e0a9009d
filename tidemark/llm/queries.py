"""The queries of the training-data operators, by name, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pairwise_quality, toxicity_fm
from tidemark.llm.common import shared_folder, table
from tidemark.llm.compaction import shard_documents
from tidemark.llm.fingerprints import fingerprint_documents
from tidemark.llm.jaccard_groups import jaccard_components
from tidemark.llm.lattice import lattice_links
from tidemark.llm.packing import pack_documents
from tidemark.llm.piece_codec import encode_texts
from tidemark.llm.surrogates import replace_entities
from tidemark.llm.token_counts import count_tokens


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))


def op3_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shared_folder(spark, "shards"))


_ALL = (op1_pairwise_quality, op2_surrogates, op3_bottom_k, op4_toxicity_fm, op5_piece_codec, op6_token_groups, op7_best_two_fit, op8_lattice, op9_token_counts, op10_compaction)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: None of the results can be had in SQL; tests hold them against brute force, libraries or held-out labels instead.
ORACLES: dict[str, str] = {}
