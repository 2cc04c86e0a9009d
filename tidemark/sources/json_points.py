"""Points as JSON: an object, an array of them, or ``{"points": [...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.points import precision, time_of, value, written_time

_POINT = "struct<measurement:string,tags:map<string,string>,fields:map<string,variant>,timestamp:bigint,time:string>"


def _typed(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "STRING", value("string", s=F.try_variant_get(v, "$", "string")))
        .when(kind == "BOOLEAN", value("boolean", b=F.try_variant_get(v, "$", "boolean")))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|TINYINT|SMALLINT)"), value("float", f=F.try_variant_get(v, "$", "double")))
    )


def parse_json(documents: DataFrame, unit: str = "ns", strict: bool = True) -> DataFrame:
    """Points of a text column ``value`` with a JSON document a row. Numbers are floats; null and nested fields, points without a name or fields, and unreadable
    documents fail the read, or with ``strict`` false are left out. ``unit`` counts for integer timestamps only.
    """
    text = F.trim("value")
    many = F.from_json(text, f"array<{_POINT}>")
    batch = F.from_json(text, f"struct<points:array<{_POINT}>>")["points"]
    one = F.array(F.from_json(text, _POINT))
    points = F.when(F.startswith(text, F.lit("[")), many).when(text.rlike(r'^\{\s*"points"\s*:'), batch).otherwise(one)
    p = documents.select("value", F.explode_outer(points).alias("p")).select("value", "p.*")
    fields = F.transform_values("fields", lambda _, v: _typed(v))
    bad = F.col("measurement").isNull() | (F.col("measurement") == "") | F.coalesce(F.size("fields") <= 0, F.lit(True)) | F.exists(F.map_values(fields), lambda v: v.isNull())
    bad = F.coalesce(bad, F.lit(True))
    p = p.where(~bad) if not strict else p.withColumn("measurement", F.when(bad, F.raise_error(F.concat(F.lit("not a point: "), "value"))).otherwise(F.col("measurement")))
    ns = F.coalesce(F.col("timestamp") * precision(unit), written_time(F.col("time")), F.unix_micros(F.current_timestamp()) * 1000)
    made = p.select("measurement", ns.alias("time_ns"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), fields.alias("fields"))
    return made.select("measurement", time_of(F.col("time_ns")).alias("time"), "time_ns", "tags", "fields")


def to_json(points: DataFrame) -> DataFrame:
    """One JSON object for each point, as ``value``, with its timestamp in nanoseconds."""
    def text(v: Column) -> Column:
        return F.when(v["type"] == "string", F.to_json(F.struct(v["s"].alias("x")))).when(v["type"] == "boolean", F.to_json(F.struct(v["b"].alias("x")))).when(v["type"] == "integer", F.to_json(F.struct(v["i"].alias("x")))).otherwise(F.to_json(F.struct(v["f"].alias("x"))))

    def quoted(s: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r'^\{"x":(.*)\}$', 1)

    pairs = F.transform(F.array_sort(F.map_keys("fields")), lambda k: F.concat(quoted(k), F.lit(":"), F.regexp_extract(text(F.col("fields")[k]), r'^\{"x":(.*)\}$', 1)))
    line = F.concat(F.lit('{"measurement":'), quoted(F.col("measurement")), F.lit(',"tags":'), F.to_json("tags"), F.lit(',"fields":{'), F.array_join(pairs, ","), F.lit('},"timestamp":'), F.col("time_ns").cast("string"), F.lit("}"))
    return points.select(line.alias("value"))
