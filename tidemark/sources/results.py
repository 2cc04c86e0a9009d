"""Results as nested JSON and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def series_json(df: DataFrame, name: str, tags: tuple[str, ...], time: str = "time", points: int = 8192) -> DataFrame:
    """One row for each chunk of a series, as ``series``: ``{"name", "tags", "columns", "chunk", "values"}``, times in RFC 3339, values by time.

    A chunk has at most ``points`` points; the chunks of a series in order of their numbers, which have gaps, give its points by time. Rows are
    dealt by ranges of tags and time, so neither a cell nor a task grows with the series.
    """
    columns = [time, *[c for c in df.columns if c not in (*tags, time)]]
    cells = [F.concat(F.date_format(_named(time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias(time), *[F.col(f"`{c}`") for c in columns[1:]]]
    dealt = df.repartitionByRange(*map(_named, (*tags, *columns))).sortWithinPartitions(*map(_named, (*tags, *columns)))
    rows = dealt.withColumn("_chunk", F.expr(f"monotonically_increasing_id() div {int(points)}")).groupBy(*map(_named, tags), "_chunk").agg(F.array_sort(F.collect_list(F.struct(*cells))).alias("values"))
    tag_map = F.create_map(*[x for t in tags for x in (F.lit(t), _named(t).cast("string"))]) if tags else F.create_map().cast("map<string,string>")
    body = F.struct(F.lit(name).alias("name"), tag_map.alias("tags"), F.array(*map(F.lit, columns)).alias("columns"), F.col("_chunk").alias("chunk"), "values")
    return rows.select(F.to_json(body).alias("series"))


def statements(*results: DataFrame) -> DataFrame:
    """Results of several statements, each given by ``series_json``, as ``response``: ``{"results": [{"statement_id", "series": [...]}]}``, a document a chunk.

    Statements are numbered in order; a chunk's document can be read by itself, so that no document grows with a result.
    """
    def one(i: int, df: DataFrame) -> DataFrame:
        body = F.concat(F.lit('{"results":[{"statement_id":' + str(i) + ',"series":['), F.col("series"), F.lit("]}]}"))
        return df.select(F.lit(i).alias("statement_id"), body.alias("response"))

    out = one(0, results[0])
    for i, df in enumerate(results[1:], 1):
        out = out.unionByName(one(i, df))
    return out


def csv_rows(df: DataFrame, time: str = "time") -> DataFrame:
    """A result as lines of CSV, ``value``: time as nanoseconds, texts in quotes, NULL as nothing, columns in their order. ``header`` gives the first line."""
    def cell(name: str, kind: str) -> Column:
        c = _named(name)
        if name == time:
            text = (F.unix_micros(c.cast("timestamp")) * 1000).cast("string")
        elif kind == "string":
            text = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
        else:
            text = c.cast("string")
        return F.coalesce(text, F.lit(""))

    return df.select(F.concat_ws(",", *[cell(n, k) for n, k in df.dtypes]).alias("value"))


def header(df: DataFrame) -> str:
    return ",".join(df.columns)
