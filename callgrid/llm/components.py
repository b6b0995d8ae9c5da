"""Connected components by distributed union-find.

Links are first joined inside tasks: each task keeps a union-find of its own links and hands on a star for each
of its trees, so what it holds is bounded by its links. The trees of all tasks are then merged by joins: in each
round a root hooks onto the least root next to any of its nodes, and nodes jump to the parents of their parents.
Hooking roots, not only nodes, halves the depth at least: a path of n nodes takes about log2(n) rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, split_skew

#: Nodes that a task's union-find holds at once, some 100 MB.
MOST_NODES = 500_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as (root, node) of its own union-find; roots are least nodes. It starts anew after MOST_NODES."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = list(parent)
        for i in range(0, len(nodes), 10_000):
            part = nodes[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([find(x) for x in part], pa.int64()), pa.array(part, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > MOST_NODES:
            yield from stars()
            parent.clear()
    yield from stars()


def components(links: DataFrame) -> DataFrame:
    """node and label (the component's least node) of every node of ``links`` (a, b: long, no nulls).

    A node linked with itself only is its own component; nodes in no link have no row; no links give no rows.
    Labels are written to the shared folder in each round, so nothing is recomputed when an executor is lost.
    Minima are taken before the shuffle, and adaptive execution splits the joins on a hub's label.
    """
    split_skew(links.sparkSession)
    pairs = links.select("a", "b").mapInArrow(_forests, "a long, b long")
    edges = saved(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        high = labels.join(up, "label")  # node, its parent and its parent's parent
        near = edges.join(high.select(F.col("node").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("near"))
        met = saved(high.join(near, high["node"] == near["a"]).select("node", "label", F.least("up", "near").alias("least")), "met")
        hooks = met.groupBy(F.col("label").alias("root")).agg(F.min("least").alias("hook"))
        now = met.join(hooks, met["node"] == hooks["root"], "left")
        now = now.select("node", F.least("least", "hook").alias("next"), "label")
        now = saved(now.select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "labels", [labels, met])
        labels = now
        if not now.where("moved").head(1):
            return now.select("node", "label")
