"""A query over a measurement, put together step by step and run as one DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import group as g
from tidemark.operators import order as o
from tidemark.operators import scan as s
from tidemark.plans.measurement import Measurement


@dataclass(frozen=True)
class Query:
    """Steps of a query. Unless a time range has an end, points after ``now`` are left out: the moment of the run, or the one given.

    Columns to order by needn't be selected.
    """

    m: Measurement
    columns: tuple = ()
    aggregates: tuple = ()
    every: str | None = None
    by: tuple[str, ...] = ()
    align: str = "monday"
    per_series: bool = False
    field: str | None = None
    descending: bool = False
    n: int = 0
    skip: int = 0
    now: str | int | datetime | None = None
    ends: bool = False
    conditions: tuple[str, ...] = ()

    def _and(self, m: Measurement, condition: str, ends: bool = False) -> Query:
        return replace(self, m=m, conditions=(*self.conditions, condition) if condition else self.conditions, ends=self.ends or ends)

    def time_range(self, start=None, end=None, **how) -> Query:
        low, high = (">" + "=" * how.get("include_start", True), "<" + "=" * how.get("include_end", True))
        text = " AND ".join(f"time {sign} '{at}'" for sign, at in ((low, start), (high, end)) if at is not None)
        return self._and(s.time_range(self.m, start, end, **how), text, end is not None)

    def at(self, now: str | int | datetime) -> Query:
        """The same query as if run at ``now``."""
        return replace(self, now=now)

    def since(self, duration: str, now) -> Query:
        """Points of the time from ``now - duration`` to ``now``."""
        return self.time_range(s.before_now(now, duration), now)

    def tags(self, **values: str) -> Query:
        return self._and(s.tags_all(self.m, values), " AND ".join(f"{k} = '{v}'" for k, v in values.items()))

    def any_tag(self, **values) -> Query:
        some = [f"{k} = '{x}'" for k, v in values.items() for x in (v if isinstance(v, list) else [v])]
        return self._and(s.tags_any(self.m, values), f"({' OR '.join(some)})")

    def where(self, condition: Column | str) -> Query:
        return self._and(s.where(self.m, F.expr(condition) if isinstance(condition, str) else condition), f"({condition})")

    def select(self, *columns: str | Column) -> Query:
        for c in columns:
            if isinstance(c, str):
                self.m.column(c)
        return replace(self, columns=columns)

    def agg(self, *aggregates: tuple) -> Query:
        return replace(self, aggregates=(*self.aggregates, *aggregates))

    def group_by(self, *tags: str, every: str | None = None, align: str = "monday", per_series: bool = False) -> Query:
        return replace(self, by=tags, every=every, align=align, per_series=per_series)

    def order_by(self, field: str, descending: bool = False) -> Query:
        return replace(self, field=field, descending=descending)

    def limit(self, n: int, offset: int = 0) -> Query:
        """Of each series, or of each group's rows by time, ``n`` after ``offset``."""
        return replace(self, n=n, skip=offset)

    def __str__(self) -> str:
        """The query as a statement, to be read; ``run().explain()`` shows its plan."""
        made = [f"{name}({', '.join([field, *map(str, more)])}) AS {alias}" for name, field, alias, *more in self.aggregates]
        keys = [f"time({self.every})"] * bool(self.every) + list(self.m.tags if self.per_series else self.by)
        parts = [f"SELECT {', '.join(made or map(str, self.columns)) or '*'} FROM {self.m.name}", f"WHERE {' AND '.join(self.conditions)}" if self.conditions else "", f"GROUP BY {', '.join(keys)}" if keys else ""]
        parts += [f"ORDER BY {self.field or 'time'}{' DESC' * self.descending}" if self.field else "", f"LIMIT {self.n}" if self.n else "", f"OFFSET {self.skip}" if self.skip else ""]
        return " ".join(p for p in parts if p)

    def run(self) -> DataFrame:
        if not self.ends:
            until = s.time_literal(self.now) if self.now is not None else F.current_timestamp().cast("timestamp_ntz")
            return replace(self, m=s.where(self.m, self.m.column(self.m.time) <= until), ends=True).run()
        if self.aggregates:
            if self.columns:
                raise ValueError("points and aggregates can't be selected together")
            df = g.group(self.m, list(self.aggregates), self.every, self.by, self.align, self.per_series)
            if not (self.n or self.skip or self.field):
                return df
            tags = self.m.tags if self.per_series else self.by
            time = "time" if self.every else None
            made = [c for c in df.columns if c not in tags]
            out = Measurement(df, time or made[0], tuple(tags), tuple(c for c in made if c != time), (), self.m.name)
            return o.limit(out, self.n, self.skip, self.field, self.descending)
        df = o.limit(self.m, self.n, self.skip, self.field, self.descending)
        if self.field and not (self.n or self.skip):
            df = o.order_by(self.m, self.field, self.descending)
        return df.select(*[self.m.column(c) if isinstance(c, str) else c for c in self.columns or (self.m.time, *self.m.tags, *self.m.fields)])
