"""Differences between two copies of a table, by hashes of ranges first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hashed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    row = F.sha2(F.concat_ws("\x1f", *rest), 256)
    return df.select(*key, row.alias("row_hash"), F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket"))


def bucket_hashes(df: DataFrame, key: list[str], buckets: int = 1024) -> DataFrame:
    """One hash for each bucket of keys: the leaves of a two-level hash tree. Order of rows doesn't matter."""
    leaf = F.xxhash64("row_hash", *key)
    return _hashed(df, key, buckets).groupBy("bucket").agg(F.bit_xor(leaf).alias("leaf"), F.count(F.lit(1)).alias("n"))


def table_diff(a: DataFrame, b: DataFrame, key: list[str], buckets: int = 1024) -> DataFrame:
    """Keys whose rows differ, with ``state``: only_a, only_b or changed. Only buckets whose hashes differ are compared row by row."""
    x, y = bucket_hashes(a, key, buckets), bucket_hashes(b, key, buckets)
    odd = x.alias("x").join(y.alias("y"), "bucket", "full_outer").where("NOT (x.leaf <=> y.leaf AND x.n <=> y.n)").select("bucket")
    left = _hashed(a, key, buckets).join(odd, "bucket", "left_semi").withColumnRenamed("row_hash", "_a").drop("bucket")
    right = _hashed(b, key, buckets).join(odd, "bucket", "left_semi").withColumnRenamed("row_hash", "_b").drop("bucket")
    state = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("changed")
    return left.join(right, key, "full_outer").where("NOT (_a <=> _b)").select(*key, state.alias("state"))
