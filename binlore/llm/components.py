"""Distributed union-find over an edge table: contract inside partitions, hook onto smaller neighbours, jump pointers.

Every round hooks each node that has a smaller neighbour onto its smallest one and contracts the edges, so the nodes
left at least halve. No task sees a whole component, nothing but counts reaches the driver, and each round's tables
are staged. Hot nodes (a star's centre) stand on the side of a join that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_table, staged, unstage

#: Edges that one partition-local forest takes before it is emitted; bounds a worker's memory.
LOCAL_EDGES = 500_000


class UnionFind:
    """In-memory union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        root = x
        while (up := p.get(root, root)) != root:
            root = up
        while x != root:
            p[x], x = root, p.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, seen = UnionFind(), 0

    def out():
        children = [x for x in forest.parent if forest.find(x) != x]
        return pa.RecordBatch.from_pydict({"a": pa.array([forest.find(x) for x in children], pa.int64()), "b": pa.array(children, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.union(a, b)
        seen += batch.num_rows
        if seen >= LOCAL_EDGES:
            yield out()
            forest, seen = UnionFind(), 0
    yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs) that is not its component's smallest; staged.

    Loops and repeated edges do no harm; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = staged(edges.where("a <> b").mapInArrow(_local_forest, "a long, b long").distinct(), "edges")
    labels = None
    while not now.isEmpty():
        hooks = staged(now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
            jumped = staged(hooks.join(up, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"), F.col("n2").isNotNull().alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            unstage(hooks)
            hooks = jumped
            if not moved:
                break
        up = hooks.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        ends = now.join(up.withColumnsRenamed({"n2": "na", "r2": "ra"}), F.col("a") == F.col("na"), "left").join(up, F.col("b") == F.col("n2"))
        ends = ends.select(F.coalesce("ra", "a").alias("x"), F.col("r2").alias("y")).where("x <> y")
        left = staged(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if labels is None:
            merged = hooks.select("node", "root")
        else:
            moved_up = labels.join(up, F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root"))
            merged = moved_up.unionByName(hooks.select("node", "root"))
        old, labels = labels, staged(merged, "labels")
        unstage(now, hooks, *([old] if old is not None else []))
        now = left
    unstage(now)
    return labels if labels is not None else local_table(spark, [], ["node", "root"])
