"""Retention of sharded tables, aggregation of what expires, and compaction of cold shards."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.durations import instant, micros
from tidemark.operators.group import group
from tidemark.plans.measurement import Measurement
from tidemark.sources import files
from tidemark.sources.store import forget, unfinished, write_once

AGGREGATES = ("mean", "avg", "sum", "count", "min", "max")


@dataclass(frozen=True)
class Downsample:
    every: str
    aggregates: tuple[str, ...]
    suffix: str

    def __post_init__(self):
        if micros(self.every) <= 0 or not self.suffix or not self.aggregates or set(self.aggregates) - set(AGGREGATES):
            raise ValueError("a downsampling needs an interval, a suffix and known aggregates")


@dataclass(frozen=True)
class RetentionPolicy:
    """How long points are kept; a duration of 0 keeps them for ever."""

    name: str
    duration: str = "0s"
    shard_duration: str | None = None
    replication: int = 1
    default: bool = False
    downsample: Downsample | None = None

    def __post_init__(self):
        if not self.name or micros(self.duration) < 0 or self.replication < 1:
            raise ValueError("a policy needs a name, a duration of 0 or more, and a replication of 1 or more")

    def shard_width(self) -> str:
        return self.shard_duration or default_shard_duration(self.duration)

    def expired(self, at, now) -> bool:
        d = micros(self.duration)
        return d > 0 and instant(at) < instant(now) - timedelta(microseconds=d)


def default_shard_duration(retention: str) -> str:
    """A tenth of the retention, one hour at least and seven days at most; seven days if nothing expires."""
    d = micros(retention)
    us = 7 * 86_400_000_000 if d == 0 else min(max(d // 10, 3_600_000_000), 7 * 86_400_000_000)
    return f"{us}us"


def keep(m: Measurement, duration: str, now) -> Measurement:
    """The points that haven't expired."""
    if micros(duration) == 0:
        return m
    cutoff = instant(now) - timedelta(microseconds=micros(duration))
    return m.over(m.df.where(F.col(m.time) >= F.lit(cutoff).cast("timestamp_ntz")))


def downsampled(m: Measurement, how: Downsample) -> DataFrame:
    """For each field and aggregate a column ``field_aggregate``, per bucket and series."""
    specs = [(a, f, f"{f}_{a}") for f in m.fields if m.kinds[f] not in ("string", "boolean") for a in how.aggregates]
    return group(m, specs, how.every, m.tags, align="unix")


def shards(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    """Files and bytes of each shard of a table: one entry a folder."""
    fs, p = files.fs_of(spark, path)
    found = {}
    for f in fs.listStatus(p) if fs.exists(p) else []:
        if f.isDirectory() and (m := re.fullmatch(r"shard_id=(-?\d+)", f.getPath().getName())):
            own = [x for x in fs.listStatus(f.getPath()) if x.getPath().getName().endswith(".parquet")]
            found[int(m[1])] = (len(own), sum(x.getLen() for x in own))
    return found


def _end(shard: int, width: str) -> datetime:
    return datetime(1970, 1, 1) + timedelta(microseconds=(shard + 1) * micros(width))


def enforce(m: Measurement, path: str, policies: list[RetentionPolicy], now, width: str) -> list[int]:
    """Drops the shards that end before the shortest finite policy's cutoff, first writing aggregates where a policy asks for them. Which were dropped.

    After a failure between the two, the next call ends that turn first, with the shards it was for: no aggregate is there twice.
    """
    spark = m.df.sparkSession
    finite = [p for p in policies if micros(p.duration) > 0]
    if not finite:
        return []
    cutoff = instant(now) - timedelta(microseconds=min(micros(p.duration) for p in finite))
    old = sorted(s for s in shards(spark, path) if _end(s, width) < cutoff)
    asked = [(p, f"{path}{p.downsample.suffix}") for p in finite if p.downsample]
    begun = sorted({tuple(map(int, t.split("@")[-2:])) for p, to in asked for t in unfinished(spark, to, f"expire-{p.name}")})
    turns = [[s for s in old if low <= s <= high] for low, high in begun]
    turns.append([s for s in old if not any(low <= s <= high for low, high in begun)])
    for (low, high), gone in zip([*begun, (None, None)], turns, strict=True):
        if low is None and not gone:
            continue
        low, high = (gone[0], gone[-1]) if low is None else (low, high)
        leaving = m.over(m.df.where(F.col("shard_id").isin(gone)))
        names = [(p, to, f"expire-{p.name}@{low}@{high}") for p, to in asked]
        for p, to, turn in names:
            write_once(spark, lambda p=p: downsampled(leaving, p.downsample), to, turn, "time", m.tags, width)  # noqa: B023
        for s in gone:
            files.remove(spark, f"{path}/shard_id={s}")
        for _, to, turn in names:
            forget(spark, to, turn)
    return old


def recover(spark: SparkSession, path: str) -> None:
    """Ends or undoes compactions that failed half way: a shard whose old folder has gone aside gets its new one."""
    for name in files.names(spark, f"{path}/_compact"):
        work, here = f"{path}/_compact/{name}", f"{path}/shard_id={name.split('@')[0]}"
        if files.exists(spark, f"{work}/old"):
            if files.exists(spark, f"{work}/new"):
                _swap_in(spark, work, here)
            _late(spark, work, here)
        files.remove(spark, work)


def _swap_in(spark: SparkSession, work: str, here: str) -> None:
    if files.exists(spark, here):  # points were appended in between
        for n in files.names(spark, f"{work}/new"):
            files.move(spark, f"{work}/new/{n}", f"{here}/{n}")
    else:
        files.move(spark, f"{work}/new", here)


def _late(spark: SparkSession, work: str, here: str) -> None:
    """Files that were appended to the old folder after it was read belong to the new one."""
    read = set(files.read_text(spark, f"{work}/read").split("\n"))
    for n in files.names(spark, f"{work}/old"):
        if n.endswith(".parquet") and n not in read:
            files.move(spark, f"{work}/old/{n}", f"{here}/{n}")


def compact(m: Measurement, path: str, now, width: str, fewest: int = 2, most_bytes: int = 1 << 30, target: int = 128 << 20, cold_after: str = "24h") -> list[int]:
    """Rewrites each cold shard of several small files as files of about ``target`` bytes. Which were rewritten.

    The new folder is complete before it takes the old one's place by two renames: nobody reads a row twice. A reader that finds files gone
    has to read again; what a failure leaves between the renames, the next call (or ``recover``) ends.
    """
    spark = m.df.sparkSession
    recover(spark, path)
    before = instant(now) - timedelta(microseconds=micros(cold_after))
    done = []
    for s, (count, size) in sorted(shards(spark, path).items()):
        if count < fewest or size > most_bytes or _end(s, width) >= before:
            continue
        here, work = f"{path}/shard_id={s}", f"{path}/_compact/{s}@{uuid.uuid4().hex}"
        read = [n for n in files.names(spark, here) if n.endswith(".parquet")]
        rows = spark.read.option("mergeSchema", "true").parquet(*[f"{here}/{n}" for n in read]).coalesce(max(1, -(-size // target)))
        rows.sortWithinPartitions(*[F.col(f"`{t}`") for t in m.tags], m.time).write.parquet(f"{work}/new")
        files.put_once(spark, f"{work}/read", "\n".join(read))
        files.move(spark, here, f"{work}/old")
        _swap_in(spark, work, here)
        _late(spark, work, here)
        files.remove(spark, work)
        done.append(s)
    return done
