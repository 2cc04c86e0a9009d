"""Filters that reach the scan: time bounds, tags, any condition."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.durations import instant, micros
from tidemark.plans.measurement import Measurement, named


def time_literal(at: str | int | datetime) -> Column:
    return F.lit(instant(at)).cast("timestamp_ntz")


def before_now(now: str | int | datetime, duration: str) -> datetime:
    """``now() - duration``; ``now`` is given, so that a query is bound to one moment and can be repeated."""
    from datetime import timedelta

    return instant(now) - timedelta(microseconds=micros(duration))


def time_range(m: Measurement, start=None, end=None, include_start: bool = True, include_end: bool = True, shard_width: str | None = None) -> Measurement:
    """Points between two instants; an open side is None. With ``shard_width`` the shard column is bounded too, so that whole shards aren't read."""
    df, t = m.df, named(m.time)
    if start is not None:
        df = df.where(t >= time_literal(start) if include_start else t > time_literal(start))
    if end is not None:
        df = df.where(t <= time_literal(end) if include_end else t < time_literal(end))
    if shard_width is not None and "shard_id" in m.kinds:
        d = micros(shard_width)
        for at, low in ((start, True), (end, False)):
            if at is not None:
                number = (instant(at) - datetime(1970, 1, 1)) // _us(d)
                df = df.where(F.col("shard_id") >= number if low else F.col("shard_id") <= number)
    return m.over(df)


def _us(n: int):
    from datetime import timedelta

    return timedelta(microseconds=n)


def tags_all(m: Measurement, values: dict[str, str]) -> Measurement:
    """Points of the series that have all these tag values."""
    df = m.df
    for tag, value in values.items():
        df = df.where(m.column(tag) == F.lit(value))
    return m.over(df)


def tags_any(m: Measurement, values: dict[str, str | list[str]]) -> Measurement:
    """Points of the series that have at least one of these tag values."""
    some = F.lit(False)
    for tag, value in values.items():
        some = some | m.column(tag).isin(value if isinstance(value, list) else [value])
    return m.over(m.df.where(some))


def where(m: Measurement, condition: Column) -> Measurement:
    """Points for which a condition over tags, fields and time is true; NULL isn't."""
    return m.over(m.df.where(condition))
