"""Tables of measurements in Parquet, sharded by time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durations import micros
from tidemark.plans.measurement import Measurement
from tidemark.sources import files
from tidemark.sources.points import wide


def shard_id(time: F.Column, width: str) -> F.Column:
    us = F.unix_micros(time.cast("timestamp"))
    return ((us - F.pmod(us, F.lit(micros(width)))) / micros(width)).cast("bigint")


def write_table(df: DataFrame, path: str, time: str = "time", tags: tuple[str, ...] = (), width: str = "1d", mode: str = "append") -> None:
    """Writes a wide table: a folder for each shard, rows of a series together and by time within files, so that statistics can skip most.

    Rows are dealt by shard, and Spark splits the tasks of a busy shard by size while it runs (``rebalance``): the current day isn't one task.
    """
    rows = df.withColumn("shard_id", shard_id(F.col(time), width)).hint("rebalance", "shard_id")
    rows.sortWithinPartitions("shard_id", *[F.col(f"`{t}`") for t in tags], time).write.partitionBy("shard_id").mode(mode).parquet(path)


def write_once(spark: SparkSession, make: Callable[[], DataFrame], path: str, turn: str, time: str = "time", tags: tuple[str, ...] = (), width: str = "1d") -> None:
    """Adds the rows that ``make`` gives to a table under the name of a turn: however often a turn is repeated after a failure, its rows are there once.

    They are written aside first; when they are whole, their files move into the shards under names of the turn. ``forget`` ends a turn, once
    the caller has recorded it.
    """
    aside = f"{path}/_turns/{turn}"
    if not files.exists(spark, f"{aside}/_SUCCESS"):
        write_table(make(), aside, time, tags, width, mode="overwrite")
    for shard in files.names(spark, aside):
        for name in files.names(spark, f"{aside}/{shard}") if shard.startswith("shard_id=") else []:
            if name.endswith(".parquet"):
                files.move(spark, f"{aside}/{shard}/{name}", f"{path}/{shard}/{turn}-{name}")


def unfinished(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Turns of a kind, the first part of their names, that were written whole but not forgotten."""
    found = files.names(spark, f"{path}/_turns")
    return [t for t in found if t.startswith(f"{kind}@") and files.exists(spark, f"{path}/_turns/{t}/_SUCCESS")]


def forget(spark: SparkSession, path: str, turn: str) -> None:
    files.remove(spark, f"{path}/_turns/{turn}")


def read_table(spark: SparkSession, path: str, name: str, tags: tuple[str, ...], fields: tuple[str, ...], time: str = "time", sequence: tuple[str, ...] = ()) -> Measurement:
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return Measurement(df.withColumn("shard_id", F.col("shard_id").cast("bigint")), time, tags, fields, sequence, name)


def write_points(points: DataFrame, root: str, width: str = "1d") -> dict[str, tuple[tuple[str, ...], tuple[str, ...]]]:
    """Appends points of any measurements to their tables under ``root``; tags and fields of each. Measurements' names reach the driver.

    Points are parsed once: they are written aside by measurement, and each table is made from its own part.
    """
    spark = points.sparkSession
    aside = f"{root}/_points/{uuid.uuid4().hex}"
    try:
        points.withColumn("_m", F.col("measurement")).write.partitionBy("_m").parquet(aside)
        written = spark.read.schema(points.schema.add("_m", "string")).parquet(aside)  # a measurement's folder is all that a filter reads
        out = {}
        for name in sorted(r[0] for r in written.select("_m").distinct().collect()):
            df, tags, fields = wide(written.where(F.col("_m") == name), name)
            write_table(df, f"{root}/{name}", "time", tags, width)
            out[name] = (tags, fields)
        return out
    finally:
        files.remove(spark, aside)
