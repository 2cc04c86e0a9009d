"""Aggregation by time buckets and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import aggregate
from tidemark.functions.timebucket import bucket
from tidemark.plans.measurement import Measurement, named

#: (aggregate, field or *, name, further argument)
Spec = tuple


def group(m: Measurement, aggregates: list[Spec], every: str | None = None, by: tuple[str, ...] = (), align: str = "monday", per_series: bool = False) -> DataFrame:
    """One row for each bucket and tag values that have points; without both, one row in all.

    ``per_series`` groups by all tags besides. Aggregates: (name, field, alias) or (name, field, alias, argument); the field of count may be ``*``.
    """
    tags = m.tags if per_series else tuple(by)
    for t in tags:
        m.column(t)
    time, sequence = named(m.time), [named(c) for c in m.sequence]
    made = []
    for name, column, alias, *arg in aggregates:
        if column == "*":
            if name.lower() != "count":
                raise ValueError(f"{name}(*) isn't defined")
            made.append(F.count(F.lit(1)).alias(alias))
        else:
            made.append(aggregate(name, m.column(column), m.kinds[column], time, sequence, *arg).alias(alias))
    keys = [bucket(time, every, align).alias("time")] if every else []
    keys += [named(t) for t in tags]
    return m.df.groupBy(*keys).agg(*made) if keys else m.df.agg(*made)
