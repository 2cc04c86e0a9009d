"""Import and export of files by their kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scan import time_range
from tidemark.plans.measurement import Measurement
from tidemark.sources.csv_points import read_csv, to_csv_columns
from tidemark.sources.json_points import parse_json, to_json
from tidemark.sources.line_protocol import parse_lines, to_lines
from tidemark.sources.points import narrow

KINDS = ("line", "json", "csv")


def kind_of(path: str) -> str:
    """The format that a name's ending tells: json, csv, and line protocol for all others."""
    end = path.rsplit("/", 1)[-1].lower().removesuffix(".gz").rsplit(".", 1)[-1]
    return end if end in ("json", "csv") else "line"


def read_points(spark: SparkSession, path: str, kind: str | None = None, unit: str = "ns", strict: bool = True, **csv) -> DataFrame:
    """Points of a file or folder; ``csv``: what ``read_csv`` takes besides. A JSON file is one document, or one a line (``.jsonl``, or ``kind`` json)."""
    kind = kind or ("jsonl" if path.lower().removesuffix(".gz").endswith(".jsonl") else kind_of(path))
    if kind == "csv":
        return read_csv(spark, path, **csv)
    if kind in ("json", "jsonl"):
        return parse_json(spark.read.text(path, wholetext=kind == "json"), unit, strict)
    if kind != "line":
        raise ValueError(f"unknown format {kind!r}")
    return parse_lines(spark.read.text(path), unit, strict=strict)


def export(m: Measurement, path: str, kind: str | None = None, start=None, end=None) -> None:
    """Writes the points of a measurement between two instants, both included, as a folder of files of a format."""
    kind = kind or kind_of(path)
    m = time_range(m, start, end)
    if kind == "csv":
        to_csv_columns(m.df, m.name, m.time, m.tags, m.fields).write.csv(path, header=True, escape='"')
    elif kind in ("line", "json"):
        points = narrow(m.df, m.name, m.time, m.tags, m.fields)
        (to_lines(points) if kind == "line" else to_json(points)).write.text(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def count_points(points: DataFrame) -> DataFrame:
    """How many points of each measurement an import brings."""
    return points.groupBy("measurement").agg(F.count(F.lit(1)).alias("n"))
