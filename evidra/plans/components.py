"""Connected components by hooking to the least label and pointer jumping.

Every step is a join or an aggregation with map-side combining, so a hub with
many neighbours is summed in parts.  Labels halve their distance to the root
each round; a round's result is written to the shared folder, which keeps
plans short.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_scratch, materialize


#: Edges that one task joins faster than rounds of jobs do.
FEW = 50_000
#: Nodes that a task keeps in Python before it hands on what it has joined.
HELD = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's edges, by union and find; of pieces of them if they have many nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def joined() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])

    for batch in batches:
        if len(parent) > HELD:
            yield joined()
            parent.clear()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    yield joined()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", few: int = 0) -> DataFrame:
    """(node, component) for every node of an edge; component = least node reachable.

    Null ends are ignored, repeated edges and self-loops do no harm, and an
    empty edge list gives an empty result.  Up to ``few`` edges, counted
    first, are joined in one task; the result is the same.
    """
    one = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if few:
        one = materialize(one, "edges")
        if one.count() <= few:
            return one.coalesce(1).mapInArrow(_joined, "node long, component long")
    # each task first joins its own edges: of a clique that shares a block, a star is left
    one = materialize(one.mapInArrow(_joined, "node long, component long").toDF("a", "b"), "stars")
    both = materialize(one.union(one.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        # the old root of a relabelled node learns of the smaller label too
        told = hooked.where("mid < old").groupBy(F.col("old").alias("node")).agg(F.min("mid").alias("told"))
        moved = hooked.join(told, "node", "left").select("node", "old", F.least("mid", F.coalesce("told", "mid")).alias("mid"))
        step = materialize(moved, "moved")
        root = step.select(F.col("node").alias("mid"), F.col("mid").alias("root"))
        fresh = materialize(step.join(root, "mid", "left").select("node", "old", F.coalesce("root", "mid").alias("component")), "labels")
        changed = fresh.where("component <> old").limit(1).count()
        drop_scratch(step)
        drop_scratch(labels)
        labels = fresh.select("node", "component")
        if not changed:
            drop_scratch(both)
            return labels
