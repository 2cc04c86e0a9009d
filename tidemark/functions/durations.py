"""Durations and instants written as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: Microseconds of each unit.
UNITS = {"u": 1, "us": 1, "µ": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PART = re.compile(r"(\d+)(us|ms|u|µ|s|m|h|d|w)?")


def micros(duration: str | int | timedelta) -> int:
    """Microseconds of ``1h30m``, ``500ms``, ``-2d``; a number without a unit counts seconds, as does an int."""
    if isinstance(duration, timedelta):
        return duration // timedelta(microseconds=1)
    if isinstance(duration, int):
        return duration * UNITS["s"]
    text = duration.strip()
    sign, text = (-1, text[1:]) if text.startswith("-") else (1, text)
    parts = _PART.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {duration!r}")
    return sign * sum(int(n) * UNITS[u or "s"] for n, u in parts)


def instant(value: str | int | datetime) -> datetime:
    """A naive UTC datetime of an RFC 3339 text, a date, nanoseconds since 1970, or a datetime."""
    if isinstance(value, int):
        return datetime(1970, 1, 1) + timedelta(microseconds=value // 1000)
    at = datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else value
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
