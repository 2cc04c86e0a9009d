"""Queries over the test tables seen as measurements, with SQL for each."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import diff, group, metadata
from tidemark.plans.measurement import Measurement
from tidemark.plans.query import Query
from tidemark.sources.csv_points import read_csv, to_csv_columns
from tidemark.sources.json_points import parse_json, to_json
from tidemark.sources.line_protocol import parse_lines, to_lines
from tidemark.sources.points import narrow, typed_text, written_time
from tidemark.sources.results import csv_rows, series_json, statements
from tidemark.sources.store import read_table, write_table
from tidemark.sources.transfer import export, read_points
from tidemark.streaming.continuous import ContinuousQuery
from tidemark.streaming.lifecycle import Downsample, RetentionPolicy, compact, downsampled, enforce, keep

NOW = "2024-01-20T00:00:00Z"
Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}


def events(spark: SparkSession, d: str) -> Measurement:
    df = spark.read.parquet(f"{d}/events.parquet").withColumn("user_id", F.col("user_id").cast("string"))
    return Measurement(df, "ts", ("event_type",), ("value",), ("event_id",), "events")


def events_by_user(spark: SparkSession, d: str) -> Measurement:
    m = events(spark, d)
    return Measurement(m.df, "ts", ("event_type", "user_id"), ("value",), ("event_id",), "events")


def lineitem(spark: SparkSession, d: str) -> Measurement:
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    fields = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return Measurement(df, "l_shipdate", ("l_returnflag", "l_linestatus"), fields, ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "lineitem")


def orders(spark: SparkSession, d: str) -> Measurement:
    df = spark.read.parquet(f"{d}/orders.parquet")
    return Measurement(df, "o_orderdate", ("o_orderpriority", "o_orderstatus"), ("o_totalprice",), ("o_orderkey",), "orders")


def register(sql: str | None, name: str | None = None):
    def put(f: Q) -> Q:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Scans, projections, filters

_ALL = "SELECT ts, event_type, value FROM events"


@register(_ALL)
def scan_all(s, d):
    return Query(events(s, d)).run()


@register("SELECT ts, value FROM events")
def select_fields(s, d):
    return Query(events(s, d)).select("ts", "value").run()


@register("SELECT event_id, value AS v, event_type AS kind FROM events")
def select_alias(s, d):
    return Query(events(s, d)).select(F.col("event_id"), F.col("value").alias("v"), F.col("event_type").alias("kind")).run()


@register("SELECT event_id, round((value * 2 + 1) / 4 - (-value), 6) AS x FROM events")
def select_arith(s, d):
    return Query(events(s, d)).select(F.col("event_id"), F.round((F.col("value") * 2 + 1) / 4 - (-F.col("value")), 6).alias("x")).run()


_CONDITIONS = {
    "filter_numeric": ("value > 40", "value > 40"),
    "filter_neq": ("value <> 50", "value <> 50"),
    "filter_and_or": ("value > 40 AND event_type = 'click' OR value < 5", "value > 40 AND event_type = 'click' OR value < 5"),
    "filter_paren": ("value > 40 AND (event_type = 'click' OR value < 45)", "value > 40 AND (event_type = 'click' OR value < 45)"),
    "filter_not": ("NOT (value >= 10)", "NOT (value >= 10)"),
    "filter_arith": ("value * 2 - 10 >= 30", "value * 2 - 10 >= 30"),
}
for _name, (_spark, _sql) in _CONDITIONS.items():
    register(f"{_ALL} WHERE {_sql}", _name)(lambda s, d, c=_spark: Query(events(s, d)).where(c).run())


@register(f"{_ALL} WHERE event_type = 'click'")
def filter_tag_eq(s, d):
    return Query(events(s, d)).tags(event_type="click").run()


@register("SELECT ts, event_type, user_id::varchar AS user_id, value FROM events WHERE event_type = 'click' AND user_id = 7")
def filter_tags_all(s, d):
    return Query(events_by_user(s, d)).tags(event_type="click", user_id="7").run()


@register("SELECT ts, event_type, user_id::varchar AS user_id, value FROM events WHERE event_type = 'click' OR user_id IN (7, 8)")
def filter_tags_any(s, d):
    return Query(events_by_user(s, d)).any_tag(event_type="click", user_id=["7", "8"]).run()


@register(f"{_ALL} WHERE ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-07'")
def filter_time_range(s, d):
    return Query(events(s, d)).time_range("2024-01-05", "2024-01-07", include_start=False).run()


@register(f"{_ALL} WHERE ts >= TIMESTAMP '2024-01-05 11:30:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'")
def filter_time_string(s, d):
    return Query(events(s, d)).time_range("2024-01-05T12:30:00+01:00", "2024-01-06T00:00:00Z", include_end=False).run()


@register(f"{_ALL} WHERE ts >= TIMESTAMP '2024-01-10'")
def filter_time_ns(s, d):
    return Query(events(s, d)).time_range(1_704_844_800_000_000_000).run()


@register(f"{_ALL} WHERE ts >= TIMESTAMP '2024-01-18 12:00:00' AND ts <= TIMESTAMP '2024-01-20'")
def filter_now_minus(s, d):
    return Query(events(s, d)).since("1d12h", NOW).run()


# Aggregates

_FIRST, _LAST = "first(value ORDER BY ts, event_id)", "first(value ORDER BY ts DESC, event_id)"
_AGGREGATES = {
    "agg_count": ([("count", "value", "n")], "count(value) AS n"),
    "agg_count_star": ([("count", "*", "n")], "count(*) AS n"),
    "agg_sum": ([("sum", "value", "x")], "round(sum(value), 4) AS x"),
    "agg_mean": ([("mean", "value", "x"), ("avg", "value", "y")], "round(avg(value), 6) AS x, round(avg(value), 6) AS y"),
    "agg_min_max": ([("min", "value", "lo"), ("max", "value", "hi")], "min(value) AS lo, max(value) AS hi"),
    "agg_median": ([("median", "value", "x")], "round(median(value), 6) AS x"),
    "agg_percentile_95": ([("percentile", "value", "x", 95)], "round(quantile_cont(value, 0.95), 6) AS x"),
    "agg_stddev": ([("stddev", "value", "x")], "round(stddev_samp(value), 6) AS x"),
    "agg_first_last": ([("first", "value", "a"), ("last", "value", "b")], f"{_FIRST} AS a, {_LAST} AS b"),
}
for _name, (_specs, _sql) in _AGGREGATES.items():

    def _run(s, d, specs=_specs, digits=4 if _name == "agg_sum" else 6):
        df = Query(events(s, d)).agg(*specs).group_by("event_type").run()
        return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    register(f"SELECT event_type, {_sql} FROM events GROUP BY event_type", _name)(_run)


@register("SELECT count(*) AS n, round(avg(value), 6) AS mean, min(value) AS lo FROM events WHERE value > 10")
def agg_global(s, d):
    return rounded(Query(events(s, d)).where("value > 10").agg(("count", "*", "n"), ("mean", "value", "mean"), ("min", "value", "lo")).run())


@register("SELECT count(value) AS n, sum(value) AS s, avg(value) AS m, stddev_samp(value) AS sd FROM events WHERE value > 1e12")
def agg_empty(s, d):
    return Query(events(s, d)).where("value > 1e12").agg(("count", "value", "n"), ("sum", "value", "s"), ("mean", "value", "m"), ("stddev", "value", "sd")).run()


@register("SELECT l_returnflag, first(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS a, first(l_extendedprice ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS b FROM lineitem GROUP BY l_returnflag")
def agg_first_last_ties(s, d):
    return Query(lineitem(s, d)).agg(("first", "l_extendedprice", "a"), ("last", "l_extendedprice", "b")).group_by("l_returnflag").run()


@register("SELECT event_type, count(CASE WHEN value < 50 THEN value END) AS n, round(avg(CASE WHEN value < 50 THEN value END), 6) AS m, max(CASE WHEN value < 50 THEN value END) AS hi FROM events GROUP BY event_type")
def agg_nan_is_missing(s, d):
    m = events(s, d)
    return rounded(Query(m.over(m.df.withColumn("value", F.when(F.col("value") < 50, F.col("value")).otherwise(F.lit(float("nan")))))).agg(("count", "value", "n"), ("mean", "value", "m"), ("max", "value", "hi")).group_by("event_type").run())


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def group_tag(s, d):
    df = Query(events(s, d)).agg(("count", "*", "n"), ("sum", "value", "total")).group_by("event_type").run()
    return df.select("event_type", "n", F.round("total", 4).alias("total"))


for _name, _width, _sql in (("5m", "5m", "5 MINUTE"), ("7m", "7m", "7 MINUTE"), ("1h", "1h", "1 HOUR"), ("1d", "1d", "1 DAY"), ("1w", "1w", "7 DAY")):
    register(f"SELECT time_bucket(INTERVAL '{_sql}', ts) AS time, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1", f"group_time_{_name}")(
        lambda s, d, w=_width: rounded(Query(events(s, d)).agg(("mean", "value", "mean"), ("count", "*", "n")).group_by(every=w).run())
    )


@register("SELECT time_bucket(INTERVAL '7 DAY', ts, TIMESTAMP '1970-01-01') AS time, count(*) AS n FROM events GROUP BY 1")
def group_time_1w_1970(s, d):
    return Query(events(s, d)).agg(("count", "*", "n")).group_by(every="7d", align="unix").run()


@register(f"SELECT time_bucket(INTERVAL '1 HOUR', ts) AS time, event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, {_FIRST} AS a, {_LAST} AS b FROM events GROUP BY 1, 2")
def group_time_tags(s, d):
    return rounded(Query(events(s, d)).agg(("mean", "value", "mean"), ("percentile", "value", "p90", 90), ("first", "value", "a"), ("last", "value", "b")).group_by("event_type", every="1h").run())


@register("SELECT time_bucket(INTERVAL '7 DAY', l_shipdate) AS time, l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS q, round(max(l_discount), 6) AS d, round(median(l_extendedprice), 6) AS p FROM lineitem GROUP BY 1, 2")
def group_multi_agg(s, d):
    return rounded(Query(lineitem(s, d)).agg(("count", "*", "n"), ("mean", "l_quantity", "q"), ("max", "l_discount", "d"), ("median", "l_extendedprice", "p")).group_by("l_returnflag", every="1w").run())


@register("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1, 2")
def agg_per_series(s, d):
    return rounded(Query(lineitem(s, d)).agg(("mean", "l_quantity", "mean")).group_by(per_series=True).run())


@register("SELECT round(avg(l_quantity), 6) AS mean FROM lineitem")
def agg_merged(s, d):
    return rounded(Query(lineitem(s, d)).agg(("mean", "l_quantity", "mean")).run())


# Order and limits

_PLACE = "qualify row_number() over (partition by event_type order by"


@register("SELECT ts, event_type, value FROM events")
def order_value_desc(s, d):
    return Query(events(s, d)).order_by("value", descending=True).run()


@register(f"{_ALL} {_PLACE} ts, event_id) <= 5")
def limit_per_series(s, d):
    return Query(events(s, d)).limit(5).run()


@register(f"{_ALL} {_PLACE} ts, event_id) BETWEEN 3 AND 7")
def limit_offset_per_series(s, d):
    return Query(events(s, d)).limit(5, 2).run()


@register(f"{_ALL} {_PLACE} ts, event_id) > 40")
def offset_only(s, d):
    return Query(events(s, d)).limit(0, 40).run()


@register(f"{_ALL} {_PLACE} value DESC, ts, event_id) <= 10")
def topk_per_series(s, d):
    return Query(events(s, d)).order_by("value", descending=True).limit(10).run()


@register("SELECT time_bucket(INTERVAL '1 DAY', ts) AS time, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY time_bucket(INTERVAL '1 DAY', ts)) <= 3")
def limit_of_groups(s, d):
    return Query(events(s, d)).agg(("count", "*", "n")).group_by("event_type", every="1d").limit(3).run()


# Metadata

@register("SELECT * FROM (VALUES ('l_linestatus'), ('l_returnflag')) t(tag_key)")
def show_tag_keys(s, d):
    return metadata.tag_keys(s, lineitem(s, d))


@register("SELECT * FROM (VALUES ('l_discount', 'float'), ('l_extendedprice', 'float'), ('l_quantity', 'float'), ('l_tax', 'float')) t(field_key, field_type)")
def show_field_keys(s, d):
    return metadata.field_keys(s, lineitem(s, d))


@register("SELECT DISTINCT event_type AS value FROM events")
def tag_values(s, d):
    return metadata.tag_values(events(s, d), "event_type")


@register("SELECT DISTINCT l_returnflag, l_linestatus, 'lineitem,l_linestatus=' || l_linestatus || ',l_returnflag=' || l_returnflag AS series_key FROM lineitem")
def show_series(s, d):
    return metadata.series(lineitem(s, d))


@register("SELECT count(*) AS n_series FROM (SELECT DISTINCT event_type, user_id FROM events)")
def series_cardinality(s, d):
    return metadata.series_cardinality(events_by_user(s, d))


# Continuous queries and retention

@register("SELECT time_bucket(INTERVAL '1 HOUR', ts, TIMESTAMP '1970-01-01') AS time, event_type, round(avg(value), 6) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07 13:00:00' GROUP BY 1, 2")
def cq_downsample_mean(s, d):
    cq = ContinuousQuery("hourly", "db", "events", "events_1h", "value", "mean", "1h")
    return rounded(cq.batch(events(s, d), "2024-01-05", "2024-01-07T13:59:00Z"))


@register("SELECT time_bucket(INTERVAL '7 DAY', ts, TIMESTAMP '1970-01-01') AS time, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def cq_downsample_week_1970(s, d):
    df = ContinuousQuery("weekly", "db", "events", "events_1w", "value", "sum", "7d").batch(events(s, d))
    return df.select("time", "event_type", F.round("value", 4).alias("value"))


for _f, _sql in (("count", "count(value)"), ("min", "min(value)"), ("max", "max(value)"), ("first", _FIRST), ("last", _LAST)):
    register(f"SELECT time_bucket(INTERVAL '1 DAY', ts, TIMESTAMP '1970-01-01') AS time, event_type, {_sql} AS value FROM events GROUP BY 1, 2", f"cq_daily_{_f}")(
        lambda s, d, f=_f: ContinuousQuery("daily", "db", "events", "events_1d", "value", f, "1d").batch(events(s, d))
    )


@register("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-13'")
def retention_keep(s, d):
    return keep(events(s, d), "7d", NOW).df.select("event_id")


@register("SELECT time_bucket(INTERVAL '1 HOUR', ts, TIMESTAMP '1970-01-01') AS time, event_type, round(avg(value), 6) AS value_mean, max(value) AS value_max, count(value) AS value_count FROM events WHERE ts < TIMESTAMP '2024-01-13' GROUP BY 1, 2")
def retention_downsample(s, d):
    m = events(s, d)
    return rounded(downsampled(m.over(m.df.where("ts < timestamp_ntz'2024-01-13'")), Downsample("1h", ("mean", "max", "count"), "_1h")))


# Formats

@register("SELECT o_orderkey::varchar AS key, o_orderstatus AS status, o_orderdate AS time, o_totalprice AS price FROM orders")
def line_roundtrip(s, d):
    p = parse_lines(to_lines(_order_points(s, d)))
    return p.select(F.col("tags")["o_orderkey"].alias("key"), F.col("tags")["o_orderstatus"].alias("status"), "time", F.col("fields")["o_totalprice"]["f"].alias("price"))


def _order_points(s, d):
    df = s.read.parquet(f"{d}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return narrow(df, "orders, all", "o_orderdate", ("o_orderkey", "o_orderstatus", "o_orderpriority"), ("o_totalprice",))


@register("SELECT o_orderkey::varchar AS key, o_orderpriority AS priority, o_orderdate AS time, o_totalprice AS price FROM orders")
def json_roundtrip(s, d):
    p = parse_json(to_json(_order_points(s, d)))
    return p.select(F.col("tags")["o_orderkey"].alias("key"), F.col("tags")["o_orderpriority"].alias("priority"), "time", F.col("fields")["o_totalprice"]["f"].alias("price"))


@register("SELECT o_orderkey AS key, o_orderstatus AS status, o_orderdate AS time, o_totalprice AS price FROM orders")
def csv_roundtrip(s, d):
    """The text of CSV cells, typed again."""
    df = s.read.parquet(f"{d}/orders.parquet")
    text = to_csv_columns(df.select("o_orderdate", "o_orderstatus", "o_orderkey", "o_totalprice"), "orders", "o_orderdate", ("o_orderstatus",), ("o_orderkey", "o_totalprice"))
    key, price = typed_text(F.col("o_orderkey").cast("string")), typed_text(F.col("o_totalprice").cast("string"))
    price = F.coalesce(price["f"], price["i"].cast("double"))
    return text.select(key["i"].alias("key"), F.col("o_orderstatus").alias("status"), F.timestamp_micros((written_time(F.col("time")) / 1000).cast("bigint")).cast("timestamp_ntz").alias("time"), price.alias("price"))


@register("SELECT 'events,event_type=' || event_type || ' value=' AS head, count(*) AS n FROM events GROUP BY 1")
def line_heads(s, d):
    df = s.read.parquet(f"{d}/events.parquet")
    lines = to_lines(narrow(df, "events", "ts", ("event_type",), ("value",)))
    return lines.groupBy(F.regexp_extract("value", "^(.* value=)", 1).alias("head")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def series_values(s, d):
    out = series_json(Query(events(s, d)).run().withColumnRenamed("ts", "time"), "events", ("event_type",))
    parsed = F.from_json("series", "struct<tags:map<string,string>,values:array<struct<time:string,value:double>>>")
    return out.select(parsed.alias("p")).groupBy(F.col("p.tags")["event_type"].alias("event_type")).agg(F.sum(F.size("p.values")).alias("n"))


@register("SELECT o_orderkey, 'changed' AS state FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 89 <> 0 UNION ALL SELECT o_orderkey, 'only_a' FROM orders WHERE o_orderkey % 89 = 0")
def merkle_diff(s, d):
    a = s.read.parquet(f"{d}/orders.parquet")
    b = a.where("o_orderkey % 89 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return diff.table_diff(a, b, ["o_orderkey"])


@register("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2")
def orders_by_series(s, d):
    df = group.group(Query(orders(s, d)).time_range("1995-01-01").m, [("count", "*", "n"), ("mean", "o_totalprice", "mean")], per_series=True)
    return df.select("o_orderpriority", "o_orderstatus", "n", F.round("mean", 4).alias("mean"))



# What is written and read again

def _scratch(s: SparkSession) -> str:
    """A new folder that the driver and all executors share; a local one only where all is one machine."""
    shared = s.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-")
    return f"{shared.rstrip('/')}/queries/{uuid.uuid4().hex}"


@register("SELECT o_orderkey AS key, o_orderstatus AS status, o_orderdate AS time, o_totalprice AS price FROM orders")
def csv_files(s, d):
    """Exported as CSV files and read again by the files' kind."""
    df = s.read.parquet(f"{d}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))
    path = f"{_scratch(s)}/orders.csv"
    export(Measurement(df, "o_orderdate", ("o_orderstatus",), ("o_orderkey", "o_totalprice"), (), "orders"), path)
    p = read_csv(s, path, tags=("o_orderstatus",))
    price = F.coalesce(F.col("fields")["o_totalprice"]["f"], F.col("fields")["o_totalprice"]["i"].cast("double"))
    return p.select(F.col("fields")["o_orderkey"]["i"].alias("key"), F.col("tags")["o_orderstatus"].alias("status"), "time", price.alias("price"))


@register("SELECT event_type, ts AS time, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09'")
def line_files(s, d):
    """A range exported as line protocol and imported again."""
    path = f"{_scratch(s)}/events.lp"
    export(events(s, d), path, start="2024-01-05", end="2024-01-09")
    return read_points(s, path).select(F.col("tags")["event_type"].alias("event_type"), "time", F.col("fields")["value"]["f"].alias("value"))


@register("SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, ts, event_id) AS place FROM events")
def order_places(s, d):
    """The place that each row has in the ordered result."""
    out = Query(events(s, d)).order_by("value", descending=True).run().withColumn("_id", F.monotonically_increasing_id())
    return out.select("event_type", "value", F.row_number().over(Window.partitionBy("event_type").orderBy("_id")).alias("place"))


@register("SELECT ts, event_type, value FROM events WHERE ts <= TIMESTAMP '2024-01-20'")
def until_now(s, d):
    """A query without an end leaves out what comes after now."""
    return Query(events(s, d)).at(NOW).run()


@register("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def sharded_range(s, d):
    """A range of a table sharded by day: only its shards are read."""
    path = f"{_scratch(s)}/events"
    write_table(events(s, d).df.withColumnRenamed("ts", "time"), path, tags=("event_type",))
    m = read_table(s, path, "events", ("event_type",), ("value",), sequence=("event_id",))
    q = Query(m).time_range("2024-01-10", "2024-01-12", include_end=False, shard_width="1d")
    return q.agg(("count", "*", "n"), ("sum", "value", "total")).group_by("event_type").run().select("event_type", "n", F.round("total", 4).alias("total"))


@register("SELECT time_bucket(INTERVAL '6 HOUR', ts, TIMESTAMP '1970-01-01') AS time, event_type, max(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-14' GROUP BY 1, 2")
def cq_turns(s, d):
    """Three turns of a continuous query, the second one twice, as after a failure: its buckets are there once."""
    path, q, m = f"{_scratch(s)}/events_6h", ContinuousQuery("q", "db", "events", "events_6h", "value", "max", "6h"), events(s, d)
    at = q.run(m, path, "2024-01-11T06:00:00Z", q.floor("2024-01-10"))
    q.forget(s, path)
    q.run(m, path, "2024-01-12T09:00:00Z", at)
    at = q.run(m, path, "2024-01-12T23:00:00Z", at)
    q.forget(s, path)
    q.run(m, path, "2024-01-14T06:00:00Z", at)
    return s.read.parquet(path).select("time", "event_type", "value")


@register("SELECT event_type, 'kept' AS part, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-13' GROUP BY 1 UNION ALL SELECT event_type, 'aggregated', count(value) FROM events WHERE ts < TIMESTAMP '2024-01-13' GROUP BY 1")
def retention_enforced(s, d):
    """Two loads of a table by day, cold days compacted, six and a half days kept by whole days, the rest aggregated by hour."""
    path = f"{_scratch(s)}/events"
    for odd in (0, 1):
        write_table(events(s, d).df.where(F.col("event_id") % 2 == odd).withColumnRenamed("ts", "time"), path, tags=("event_type",))
    table = lambda: read_table(s, path, "events", ("event_type",), ("value",), sequence=("event_id",))
    compact(table(), path, NOW, "1d")
    enforce(table(), path, [RetentionPolicy("week", "156h", downsample=Downsample("1h", ("count",), "_1h"))], NOW, "1d")
    kept = s.read.parquet(path).groupBy("event_type").agg(F.lit("kept").alias("part"), F.count(F.lit(1)).alias("n"))
    return kept.unionByName(s.read.parquet(f"{path}_1h").groupBy("event_type").agg(F.lit("aggregated").alias("part"), F.sum("value_count").alias("n")))


@register("SELECT 0 AS statement_id, event_type, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 1, event_type, 1 FROM events GROUP BY 2")
def statement_responses(s, d):
    """Two statements' responses, points and a maximum a series, read back from their JSON."""
    q = Query(events(s, d))
    points = series_json(q.run().withColumnRenamed("ts", "time"), "events", ("event_type",))
    top = series_json(q.agg(("max", "value", "value")).group_by("event_type", every="52w").run().groupBy("event_type").agg(F.min("time").alias("time"), F.max("value").alias("value")), "events", ("event_type",))
    shape = "struct<results:array<struct<statement_id:int,series:array<struct<tags:map<string,string>,values:array<struct<time:string,value:double>>>>>>>"
    p = statements(points, top).select(F.from_json("response", shape).alias("p")).select(F.explode("p.results").alias("r")).select("r.statement_id", F.explode("r.series").alias("x"))
    return p.groupBy("statement_id", F.col("x.tags")["event_type"].alias("event_type")).agg(F.sum(F.size("x.values")).alias("n"))


@register("""SELECT epoch_us(ts)::varchar || '000,"' || event_type || '",' || coalesce(event_id::varchar, '') AS value FROM events""")
def csv_lines(s, d):
    m = events(s, d)
    return csv_rows(m.df.select("ts", "event_type", "event_id"), "ts")
