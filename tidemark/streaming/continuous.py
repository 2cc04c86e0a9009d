"""Continuous queries: tumbling aggregates of one measurement kept up in another."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.aggregates import aggregate
from tidemark.functions.durations import instant, micros
from tidemark.functions.timebucket import offset
from tidemark.operators.group import group
from tidemark.operators.scan import time_range
from tidemark.plans.measurement import Measurement
from tidemark.sources.store import forget, shard_id, unfinished, write_once

_STAMP = "%Y%m%dT%H%M%S.%f"
FUNCTIONS = ("mean", "avg", "sum", "count", "min", "max", "first", "last")


@dataclass(frozen=True)
class ContinuousQuery:
    """``function`` of ``field`` over buckets of ``every`` for each series, written under the field's name to ``destination``."""

    name: str
    database: str
    source: str
    destination: str
    field: str
    function: str
    every: str
    by: tuple[str, ...] | None = None
    enabled: bool = True

    def __post_init__(self):
        empty = [k for k in ("name", "database", "source", "destination", "field") if not getattr(self, k)]
        if empty:
            raise ValueError(f"a continuous query needs {', '.join(empty)}")
        if self.function not in FUNCTIONS:
            raise ValueError(f"a continuous query can't use {self.function!r}")
        if micros(self.every) <= 0:
            raise ValueError("the interval must be positive")

    def tags(self, m: Measurement) -> tuple[str, ...]:
        return m.tags if self.by is None else self.by

    def batch(self, m: Measurement, start=None, end=None) -> DataFrame:
        """The buckets that lie wholly between two instants (start included, end not), aligned to 1970."""
        if start is not None or end is not None:
            m = time_range(m, self.floor(start) if start is not None else None, self.floor(end) if end is not None else None, include_end=False)
        return group(m, [(self.function, self.field, self.field)], self.every, self.tags(m), align="unix")

    def floor(self, at) -> datetime:
        at = instant(at)
        return at - ((at - datetime(1970, 1, 1)) % timedelta(microseconds=micros(self.every)))

    def run(self, m: Measurement, path: str, now, processed: datetime | None = None, look_back: str = "24h", width: str = "1d") -> datetime:
        """One turn: appends the buckets that ended since the last turn, leaving the newest open bucket to late points. Returns how far it came.

        Turns begin and end at bucket starts, so that no bucket is written twice. A turn is forgotten by the caller, once it has recorded
        how far it came; one that isn't, because the caller failed, is ended as it was begun.
        """
        spark = m.df.sparkSession
        for turn in unfinished(spark, path, self.name):
            begun, ended = (datetime.strptime(x, _STAMP) for x in turn.split("@")[-2:])
            write_once(spark, lambda: None, path, turn)
            if processed is None or begun == processed:
                return ended
            forget(spark, path, turn)  # it was recorded
        end = self.floor(instant(now) - timedelta(microseconds=micros(self.every)))
        start = processed if processed is not None else self.floor(instant(now) - timedelta(microseconds=micros(look_back)))
        if start >= end:
            return start
        write_once(spark, lambda: self.batch(m, start, end), path, f"{self.name}@{start:{_STAMP}}@{end:{_STAMP}}", "time", self.tags(m), width)
        return end

    def forget(self, spark: SparkSession, path: str) -> None:
        for turn in unfinished(spark, path, self.name):
            forget(spark, path, turn)

    def aggregated(self, m: Measurement, late: str | None = None) -> DataFrame:
        """The same buckets of a stream, each once, when points can't come for it any more: ``late`` (default: one bucket) after its end."""
        us = micros(self.every)
        stamp = m.df.withColumn("_at", F.col(m.time).cast("timestamp")).withWatermark("_at", f"{micros(late) // 1000 if late else us // 1000} milliseconds")
        begin = F.window("_at", f"{us} microseconds", f"{us} microseconds", f"{offset(self.every, 'unix')} microseconds")
        x = aggregate(self.function, F.col(self.field), m.kinds[self.field], F.col(m.time), [F.col(c) for c in m.sequence])
        out = stamp.groupBy(begin.alias("_w"), *self.tags(m)).agg(x.alias(self.field))
        return out.select(F.col("_w.start").cast("timestamp_ntz").alias("time"), *self.tags(m), self.field)

    def start(self, m: Measurement, path: str, checkpoint: str, late: str | None = None, every: str | None = None, width: str = "1d") -> StreamingQuery:
        """Writes the buckets of a stream to a sharded table; ``every``: how often it looks for points, or once through what is there."""
        out = self.aggregated(m, late).withColumn("shard_id", shard_id(F.col("time"), width))
        writer = out.writeStream.queryName(f"cq_{self.name}").outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("shard_id")
        writer = writer.trigger(processingTime=f"{micros(every) // 1000} milliseconds") if every else writer.trigger(availableNow=True)
        return writer.start()
