"""Order, limit and offset within each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.measurement import Measurement, named


def _by(m: Measurement, field: str | None, descending: bool) -> list[Column]:
    if field is None:
        return m.order()
    key = m.column(field).desc_nulls_last() if descending else m.column(field).asc_nulls_last()
    return [key, *m.order()]


def order_by(m: Measurement, field: str, descending: bool = False) -> DataFrame:
    """Series by their tags, and each one's points by a field."""
    return m.df.orderBy(*[named(t).asc_nulls_first() for t in sorted(m.tags)], *_by(m, field, descending))


def limit(m: Measurement, n: int = 0, offset: int = 0, field: str | None = None, descending: bool = False) -> DataFrame:
    """Of each series ``n`` points (0: all) after ``offset``, in order of a field or of time. Spark drops rows beyond the limit before the shuffle."""
    if n <= 0 and offset <= 0:
        return m.df
    place = F.row_number().over(Window.partitionBy(*map(named, m.tags)).orderBy(*_by(m, field, descending)))
    if n <= 0:
        return _without_first(m, offset, place, field)
    keep = (F.col("_place") > offset) & (F.col("_place") <= offset + n)
    return m.df.withColumn("_place", place).where(keep).drop("_place")


def _without_first(m: Measurement, offset: int, place: Column, field: str | None) -> DataFrame:
    """All but the first ``offset`` points of each series: those few are found under a limit and taken out again, so that no task numbers a whole series.

    Points of a series that are equal in all that orders them are told apart by number, within their own small group.
    """
    keys = list(dict.fromkeys((*m.tags, *([field] if field else []), m.time, *m.sequence)))
    gone = m.df.withColumn("_place", place).where(F.col("_place") <= offset).groupBy(*[named(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_gone"))
    own = Window.partitionBy(*map(named, keys)).orderBy(F.lit(0))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & named(k).eqNullSafe(F.col(f"_k{i}"))
    rest = m.df.withColumn("_nth", F.row_number().over(own)).join(gone, same, "left").where(F.col("_nth") > F.coalesce("_gone", F.lit(0)))
    return rest.select(*[named(c) for c in m.df.columns])


def top_overall(m: Measurement, field: str, n: int, descending: bool = True) -> DataFrame:
    """The first points of all series together."""
    return m.df.orderBy(*_by(m, field, descending)).limit(n)
