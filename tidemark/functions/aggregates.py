"""Aggregates by name. NaN counts as missing; without values all give NULL but for count, which gives 0."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(column: Column, kind: str) -> Column:
    """The column with NaN as NULL."""
    return F.when(~F.isnan(column), column) if kind in ("double", "float") else column


def order_key(time: Column, sequence: Sequence[Column], falling: bool = False) -> Column:
    """What first and last order by: the time, and among equal times the sequence columns, reversed for last, so that of ties the earliest row wins.

    With one sequence column the key is one number, which Spark can keep in a hash aggregate.
    """
    if len(sequence) == 1:
        own = -sequence[0] if falling else sequence[0]
        return F.unix_micros(time.cast("timestamp")).cast("decimal(38,0)") * F.lit(Decimal(10**19)) + own.cast("decimal(19,0)")
    return F.struct(time, *[-s if falling else s for s in sequence])


def _first(x: Column, time: Column, sequence: Sequence[Column]) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), order_key(time, sequence)))


def _last(x: Column, time: Column, sequence: Sequence[Column]) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), order_key(time, sequence, falling=True)))


NUMERIC: dict[str, Callable[..., Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "median": F.median,
    "stddev": F.stddev_samp,
}
NAMES = ("count", "sum", "mean", "avg", "min", "max", "first", "last", "median", "percentile", "stddev")


def aggregate(name: str, column: Column, kind: str, time: Column, sequence: Sequence[Column], arg: float | None = None) -> Column:
    """The aggregate of a column of a type. ``percentile`` takes a number of 0 to 100 and interpolates."""
    name = name.lower()
    if name not in NAMES:
        raise ValueError(f"unknown aggregate {name!r}")
    if name == "percentile" and (arg is None or not 0 <= arg <= 100):
        raise ValueError("percentile needs a number of 0 to 100")
    if name in (*NUMERIC, "percentile") and kind in ("string", "boolean"):
        raise ValueError(f"{name} needs a number, not {kind}")
    x = masked(column, kind)
    if name in NUMERIC:
        return NUMERIC[name](x)
    if name == "percentile":
        return F.percentile(x, F.lit(arg / 100))
    if name == "first":
        return _first(x, time, sequence)
    if name == "last":
        return _last(x, time, sequence)
    return {"count": F.count, "min": F.min, "max": F.max}[name](x)
