"""Tumbling time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.durations import micros

#: Seconds from 0001-01-01, a Monday, to 1970-01-01.
_YEAR_ONE = 62_135_596_800


def offset(width: str | int, align: str = "monday") -> int:
    """Microseconds after a multiple of the width since 1970 at which buckets begin."""
    d = micros(width)
    if d <= 0:
        raise ValueError("a bucket's width must be positive")
    if align not in ("monday", "unix"):
        raise ValueError(f"unknown alignment {align!r}")
    return -_YEAR_ONE * 1_000_000 % d if align == "monday" else 0


def bucket(time: Column, width: str | int, align: str = "monday") -> Column:
    """Start of the bucket of a time: of multiples of the width since 0001-01-01 (``monday``) or 1970-01-01 (``unix``). The session's time zone must be UTC."""
    us = F.unix_micros(time.cast("timestamp"))
    start = us - F.pmod(us - F.lit(offset(width, align)), F.lit(micros(width)))
    return F.timestamp_micros(start).cast("timestamp_ntz")
