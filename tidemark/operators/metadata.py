"""What a measurement holds: tag keys and values, field keys, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.measurement import Measurement, named


def tag_keys(spark: SparkSession, m: Measurement) -> DataFrame:
    return spark.createDataFrame([(t,) for t in sorted(m.tags)], "tag_key string")


def field_keys(spark: SparkSession, m: Measurement) -> DataFrame:
    names = {"double": "float", "float": "float", "bigint": "integer", "int": "integer", "boolean": "boolean"}
    return spark.createDataFrame([(f, names.get(m.kinds[f], "string")) for f in sorted(m.fields)], "field_key string, field_type string")


def tag_values(m: Measurement, tag: str) -> DataFrame:
    """Distinct values of a tag, sorted."""
    return m.df.select(m.column(tag).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


def series(m: Measurement) -> DataFrame:
    return m.df.select(*map(named, m.tags)).distinct().withColumn("series_key", m.series_key())


def series_cardinality(m: Measurement) -> DataFrame:
    return m.df.select(*map(named, m.tags)).distinct().agg(F.count(F.lit(1)).alias("n_series"))
