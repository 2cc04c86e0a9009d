"""Points as CSV with a header or without."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.points import time_of, typed_text, written_time


def read_csv(spark: SparkSession, path: str, measurement: str | None = None, measurement_column: str = "measurement", time_column: str = "time", tags: tuple[str, ...] = (), header: bool = True, delimiter: str = ",") -> DataFrame:
    """Points of CSV files. Without a header columns are col0, col1, ...; cells are typed one by one, empty ones are missing, rows without fields are dropped, rows of another length fail.

    The measurement comes from its column, or is ``measurement`` for all rows.
    """
    df = spark.read.csv(path, header=header, sep=delimiter, ignoreLeadingWhiteSpace=True, mode="FAILFAST", enforceSchema=False, multiLine=True, escape='"')
    if not header:
        df = df.toDF(*[f"col{i}" for i in range(len(df.columns))])
    named = measurement_column in df.columns
    if not named and not measurement:
        raise ValueError(f"no column {measurement_column!r} and no measurement given")
    fields = [c for c in df.columns if c not in (*tags, time_column) and not (named and c == measurement_column)]

    def pairs(names, of):
        entries = [F.struct(F.lit(c).alias("key"), F.when(F.coalesce(F.col(f"`{c}`"), F.lit("")) != "", of(F.col(f"`{c}`"))).alias("value")) for c in names]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    ns = written_time(F.trim(F.col(f"`{time_column}`"))) if time_column in df.columns else F.unix_micros(F.current_timestamp()) * 1000
    tag_map = pairs(tags, lambda c: c) if tags else F.create_map().cast("map<string,string>")
    made = df.select((F.col(f"`{measurement_column}`") if named else F.lit(measurement)).alias("measurement"), ns.alias("time_ns"), tag_map.alias("tags"), pairs(fields, typed_text).alias("fields"))
    return made.where(F.size("fields") > 0).select("measurement", time_of(F.col("time_ns")).alias("time"), "time_ns", "tags", "fields")


def to_csv_columns(df: DataFrame, measurement: str, time: str, tags: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """A wide table in the order that CSV files have: time (RFC 3339), measurement, tags and fields by name. Write it with ``.write.csv(path, header=True)``."""
    at = F.concat(F.date_format(F.col(f"`{time}`"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return df.select(at.alias("time"), F.lit(measurement).alias("measurement"), *[F.col(f"`{c}`") for c in (*sorted(tags), *sorted(fields))])
