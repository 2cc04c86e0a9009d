"""Points of any measurement, and the wide table of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUE = "struct<type:string,f:double,i:bigint,s:string,b:boolean>"
SCHEMA = f"measurement string, time timestamp_ntz, time_ns bigint, tags map<string,string>, fields map<string,{VALUE}>"
#: Nanoseconds of each precision.
PRECISION = {"ns": 1, "n": 1, "us": 1_000, "u": 1_000, "µ": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


def precision(name: str) -> int:
    """Nanoseconds of a unit of written timestamps."""
    if name not in PRECISION:
        raise ValueError(f"unknown precision {name!r}")
    return PRECISION[name]


def time_of(ns: Column) -> Column:
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(20,0)")).cast("bigint")).cast("timestamp_ntz")


def value(kind: Column | str, f: Column | None = None, i: Column | None = None, s: Column | None = None, b: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = {"f": (f, "double"), "i": (i, "bigint"), "s": (s, "string"), "b": (b, "boolean")}
    return F.struct(kind.alias("type"), *[(F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in parts.items()])


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value); of equal keys the last counts."""
    later = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    repeated = F.size(F.array_distinct(F.transform(entries, lambda e: e["key"]))) < F.size(entries)
    return F.map_from_entries(F.when(repeated, later).otherwise(entries))


def typed_text(text: Column) -> Column:
    """A value of a cell: boolean, integer, float or string, the first that fits."""
    return (
        F.when(F.lower(text).isin("true", "false"), value("boolean", b=F.lower(text) == "true"))
        .when(text.rlike(r"^[+-]?\d{1,18}$"), value("integer", i=text.cast("bigint")))
        .when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value("float", f=text.cast("double")))
        .otherwise(value("string", s=text))
    )


def written_time(text: Column) -> Column:
    """Nanoseconds of a written time: digits by their size (ns, us, ms or s), else RFC 3339, a date, or date and time."""
    n = F.try_to_number(text, F.lit("S9999999999999999999")).cast("decimal(20,0)")
    scale = F.when(n > 10**18, F.lit(1)).when(n > 10**15, F.lit(1_000)).when(n > 10**12, F.lit(1_000_000)).otherwise(F.lit(1_000_000_000))
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    return F.when(text.rlike(r"^-?\d+$"), (n * scale).cast("bigint")).otherwise(F.unix_micros(parsed) * 1000)


def wide(points: DataFrame, measurement: str) -> tuple[DataFrame, tuple[str, ...], tuple[str, ...]]:
    """The table of a measurement (time, time_ns, tags, fields), its tags and its fields; absent ones are NULL.

    A field of integers and floats is a float; other mixtures of types are an error. Names of tags and fields, one row each, reach the driver.
    """
    own = points.where(F.col("measurement") == measurement)
    tags = tuple(sorted(r[0] for r in own.select(F.explode(F.map_keys("tags"))).distinct().collect()))
    found = own.select(F.explode("fields").alias("name", "v")).select("name", "v.type").distinct().collect()
    kinds: dict[str, set[str]] = {}
    for name, kind in found:
        kinds.setdefault(name, set()).add(kind)
    made = []
    for name in sorted(kinds):
        v = F.col("fields")[name]
        k = kinds[name]
        if k == {"integer", "float"}:
            made.append(F.coalesce(v["f"], v["i"].cast("double")).alias(name))
        elif len(k) > 1:
            raise ValueError(f"field {name!r} of {measurement!r} has values of types {sorted(k)}")
        else:
            made.append(v[{"float": "f", "integer": "i", "string": "s", "boolean": "b"}[next(iter(k))]].alias(name))
    both = set(tags) & set(kinds)
    if both:
        raise ValueError(f"{sorted(both)} are tags and fields of {measurement!r}")
    return own.select("time", "time_ns", *[F.col("tags")[t].alias(t) for t in tags], *made), tags, tuple(sorted(kinds))


def narrow(df: DataFrame, measurement: str, time: str, tags: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Points of a wide table; NULL tags and fields are left out, and rows without fields too."""
    kinds = dict(df.dtypes)

    def of(name: str) -> Column:
        c, k = F.col(f"`{name}`"), kinds[name]
        if k == "boolean":
            return value("boolean", b=c)
        if k in ("tinyint", "smallint", "int", "bigint"):
            return value("integer", i=c)
        return value("string", s=c) if k == "string" else value("float", f=c)

    def kept(pairs: list[Column]) -> Column:
        return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))

    tag_map = kept([F.struct(F.lit(t).alias("key"), F.col(f"`{t}`").cast("string").alias("value")) for t in tags]) if tags else F.create_map().cast("map<string,string>")
    field_map = kept([F.struct(F.lit(f).alias("key"), F.when(F.col(f"`{f}`").isNotNull(), of(f)).alias("value")) for f in fields])
    ns = F.col("time_ns") if "time_ns" in kinds else F.unix_micros(F.col(time).cast("timestamp")) * 1000
    out = df.select(F.lit(measurement).alias("measurement"), F.col(time).alias("time"), ns.alias("time_ns"), tag_map.alias("tags"), field_map.alias("fields"))
    return out.where(F.size("fields") > 0)
