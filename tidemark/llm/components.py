"""Connected components of a graph of any size, by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Edges that one task may join by itself; rounds of contraction come first while there are more, however many.
TAIL = 400_000
#: Rounds after which the vertices' labels are written, so that the plan doesn't grow with the number of rounds.
WRITTEN = 3


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of a task: each vertex and the smallest of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    ids = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["a", "to"])


def components(edges: DataFrame, tail: int = TAIL) -> DataFrame:
    """id, component (the smallest id) for each end of the edges a, b.

    In each round every vertex takes the neighbour, or itself, that comes first in an order drawn for the round; edges then join what their
    ends took. A round leaves a fraction of the vertices, so there are few rounds, whatever the shape of the graph. The last ``tail`` edges,
    a number that doesn't depend on the graph, are joined in one task. Nothing but the number of edges left reaches the driver.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct())
    labels = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id"))
    turn = 0
    while left.count() > tail:
        ends = left.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba")])).alias("e")).select("e.a", "e.b")
        best = ends.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("to"))
        own = F.xxhash64("a", F.lit(turn)) < F.xxhash64("to", F.lit(turn))
        took = cut(best.select("a", F.when(own, F.col("a")).otherwise(F.col("to")).alias("to")))
        # A vertex that a round doesn't know keeps its label.
        labels = labels.join(took, labels["label"] == took["a"], "left").select("id", F.coalesce("to", "label").alias("label"))
        x = left.join(took.select("a", F.col("to").alias("x")), "a").join(took.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = cut(x.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        turn += 1
        if turn % WRITTEN == 0:
            labels = cut(labels)
    last = left.coalesce(1).mapInArrow(_joined, "a long, to long")
    labels = labels.join(last, F.col("label") == F.col("a"), "left").select("id", F.coalesce("to", "label").alias("label"))
    if not turn:  # the labels are the smallest ids already
        return labels.select("id", F.col("label").alias("component"))
    labels = cut(labels)
    smallest = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(smallest, "label").select("id", "component")
