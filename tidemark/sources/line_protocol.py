"""Line protocol: ``tank,site=north level=1.5,state="open" 1700000000000000000``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.points import last_wins, precision, time_of, value

_HEAD = r"^((?:[^\\ ]++|\\.)++) ++(.*)$"
_TOKEN = r"((?:[^\\,]++|\\.)++)"
_FIELD = r'((?:[^\\,"]++|\\.|"(?:[^"\\]++|\\.)*+")++)'
_PAIR = r"^((?:[^\\=]++|\\.)++)=(.*)$"
_TIME = r" +(-?\d+) *$"
# How booleans are written.
TRUE, FALSE = ("t", "T", "true", "True", "TRUE"), ("f", "F", "false", "False", "FALSE")


def _plain(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([,= \\])", "$1")).otherwise(text)


def _field_value(text: Column) -> Column:
    return (
        F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value("float", f=text.cast("double")))
        .when(F.startswith(text, F.lit('"')), F.when(text.rlike(r'^"(?:[^"\\]++|\\.)*+"$'), value("string", s=F.regexp_replace(F.regexp_extract(text, '^"(.*)"$', 1), r'\\(["\\])', "$1"))))
        .when(text.isin(*TRUE), value("boolean", b=F.lit(True)))
        .when(text.isin(*FALSE), value("boolean", b=F.lit(False)))
        .when(text.rlike(r"^[+-]?\d+i$"), value("integer", i=F.regexp_extract(text, r"^(.*)i$", 1).try_cast("bigint")))
    )


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row, however often they are used: an expression isn't copied beyond a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_lines(lines: DataFrame, unit: str = "ns", now: datetime | None = None, strict: bool = True) -> DataFrame:
    """Points of a DataFrame with a text column ``value``.

    Blank lines and those that begin with ``#`` are skipped. A missing timestamp, or 0, is ``now``. A line that isn't valid fails the whole read, or with
    ``strict`` false is left out.
    """
    at = int((now or datetime.now(timezone.utc)).replace(tzinfo=timezone.utc).timestamp() * 1_000_000) * 1000
    raw = lines.select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    # Without escapes and quotes, and with single blanks only, a line is cut by single letters; other lines take the patterns.
    raw = _once(raw, cut=F.when(~F.contains("line", F.lit("\\")) & ~F.contains("line", F.lit('"')), F.split("line", " ")))
    easy = F.coalesce((F.size("cut") == 2) | ((F.size("cut") == 3) & F.get("cut", F.lit(2)).rlike(r"^-?\d+$")), F.lit(False))
    part = lambda i, other: F.when(F.col("easy"), F.coalesce(F.get("cut", F.lit(i)), F.lit(""))).otherwise(other)
    df = _once(raw, easy=easy)
    df = _once(df, head=part(0, F.regexp_extract("line", _HEAD, 1)), rest=part(1, F.regexp_replace(F.regexp_extract("line", _HEAD, 2), _TIME, "")), stamp=part(2, F.regexp_extract("line", _TIME, 1)))
    tokens = F.when(F.col("easy"), F.split("head", ",")).otherwise(F.regexp_extract_all("head", F.lit(_TOKEN), 1))
    parts = F.when(F.col("easy"), F.split("rest", ",")).otherwise(F.regexp_extract_all("rest", F.lit(_FIELD), 1))
    df = _once(df, tokens=tokens, parts=parts)

    def pairs(texts: Column, of) -> Column:
        def easy_pair(x):
            return F.when(F.contains(x, F.lit("=")), F.struct(F.substring_index(x, "=", 1).alias("key"), of(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("value"))).otherwise(F.struct(F.lit("").alias("key"), of(F.lit("")).alias("value")))

        def pair(x):
            return F.struct(_plain(F.regexp_extract(x, _PAIR, 1)).alias("key"), of(F.regexp_extract(x, _PAIR, 2)).alias("value"))

        return F.when(F.col("easy"), F.transform(texts, easy_pair)).otherwise(F.transform(texts, pair))

    tags = F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0)))
    written = F.when(F.col("stamp") != "", F.col("stamp").try_cast("bigint"))
    df = _once(df, t=pairs(tags, _plain), f=pairs(F.col("parts"), _field_value), written=written)
    bad = (
        (F.col("head") == "") | F.startswith("head", F.lit(",")) | (F.size("f") == 0) | (~F.col("easy") & ((F.array_join("parts", ",") != F.col("rest")) | (F.array_join("tokens", ",") != F.col("head"))))
        | F.exists("t", lambda x: (x["key"] == "") | (x["value"] == "")) | F.exists("f", lambda x: (x["key"] == "") | x["value"].isNull() | ((x["value"]["type"] == "integer") & x["value"]["i"].isNull()))
        | ((F.col("stamp") != "") & F.col("written").isNull())
    )
    df = df.where(~bad) if not strict else df.withColumn("head", F.when(bad, F.raise_error(F.concat(F.lit("not line protocol: "), "line"))).otherwise(F.col("head")))
    ns = F.when(F.coalesce("written", F.lit(0)) == 0, F.lit(at)).otherwise(F.col("written") * precision(unit))
    name = _plain(F.when(F.col("head").isNotNull(), F.col("tokens")[0]))
    return df.select(name.alias("measurement"), ns.alias("time_ns"), last_wins(F.col("t")).alias("tags"), last_wins(F.col("f")).alias("fields")).select("measurement", time_of(F.col("time_ns")).alias("time"), "time_ns", "tags", "fields")


def read_lines(spark, path: str, unit: str = "ns", now: datetime | None = None, strict: bool = True) -> DataFrame:
    return parse_lines(spark.read.text(path), unit, now, strict)


def _escaped(text: Column, letters: str) -> Column:
    return F.regexp_replace(text, rf"([{letters}])", r"\\$1")


def to_lines(points: DataFrame) -> DataFrame:
    """One line for each point, as ``value``: tags and fields by name, escaped, times in nanoseconds."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit(","), _escaped(e["key"], ",= "), F.lit("="), _escaped(e["value"], ",= ")))

    def text(v: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.regexp_replace(v["s"], r'(["\\])', r"\\$1"), F.lit('"'))
        return F.when(v["type"] == "string", quoted).when(v["type"] == "integer", F.concat(v["i"].cast("string"), F.lit("i"))).when(v["type"] == "boolean", v["b"].cast("string")).otherwise(v["f"].cast("string"))

    names = F.array_sort(F.map_keys("fields"))
    fields = F.transform(names, lambda k: F.concat(_escaped(k, ",= "), F.lit("="), text(F.col("fields")[k])))
    line = F.concat(_escaped(F.col("measurement"), ", "), F.array_join(tags, ""), F.lit(" "), F.array_join(fields, ","), F.lit(" "), F.col("time_ns").cast("string"))
    return points.select(line.alias("value"))
