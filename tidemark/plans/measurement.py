"""A measurement: a table with a time, tags and fields."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """A column whatever its name: dots and blanks belong to it."""
    return F.col("`" + column.replace("`", "``") + "`")


@dataclass(frozen=True)
class Measurement:
    """``df`` seen as points: tags name a series, fields hold its values. ``sequence`` columns order rows of equal time."""

    df: DataFrame
    time: str
    tags: tuple[str, ...]
    fields: tuple[str, ...]
    sequence: tuple[str, ...] = ()
    name: str = "m"
    kinds: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        kinds = dict(self.df.dtypes)
        missing = [c for c in (self.time, *self.tags, *self.fields, *self.sequence) if c not in kinds]
        if missing:
            raise ValueError(f"no columns {missing}")
        object.__setattr__(self, "kinds", kinds)

    def over(self, df: DataFrame) -> Measurement:
        return replace(self, df=df)

    def column(self, name: str) -> Column:
        if name not in (self.time, *self.tags, *self.fields):
            raise ValueError(f"{name!r} is neither a tag nor a field of {self.name}")
        return named(name)

    def order(self) -> list[Column]:
        """Total order of a series' points."""
        return [named(self.time).asc_nulls_first(), *[named(c).asc_nulls_first() for c in self.sequence]]

    def series_key(self) -> Column:
        """``name,tag=value,...`` with tags by name; missing tags left out."""
        parts = [F.when(named(t).isNotNull(), F.concat(F.lit(f"{t}="), named(t).cast("string"))) for t in sorted(self.tags)]
        return F.concat_ws(",", F.lit(self.name), *parts)
