"""Searches from every node of a graph that a task can hold: betweenness and closeness without a join for each level.

Nodes with the same contacts are one class: they are as far from everything, and on as many shortest paths. Classes are found by
Spark, at any size. If their contacts are at most HELD, all tasks get them as arrays and each searches from a share of the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: Contacts between classes that tasks hold as arrays (32 MB); a graph of more is searched by joins.
HELD = 1_000_000
#: Nodes and contacts that the searches of one batch see at once.
SEEN = 2_000_000
#: Steps over contacts for a task, and rows of results of all tasks, at most, if there are more tasks than cores.
STEPS, ROWS = 500_000_000, 200_000_000


@dataclass
class Classes:
    """The classes of a graph (id, node, size, total and squares of the weights), its nodes (node, id, weight) and the contacts of classes (src, dst: ids, each once)."""

    table: DataFrame
    nodes: DataFrame
    contacts: DataFrame
    steps: int


def classes(e: DataFrame, weight: DataFrame | None = None) -> Classes | None:
    """The classes of the graph ``e`` (src, dst; each contact once) with weights of nodes (node, weight), 1 if none; nothing if they have more than HELD contacts.

    Nodes are of one class if they have as many contacts and two hashes of 64 bits of these are equal.
    """
    ends = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select("dst", "src"))
    mark = ends.groupBy("node").agg(F.count("*").alias("d"), F.bit_xor(F.xxhash64("other")).alias("h1"), F.bit_xor(F.xxhash64("other", F.lit(1))).alias("h2"))
    mark = mark.withColumn("weight", F.lit(1).cast("long")) if weight is None else mark.join(weight.select("node", F.col("weight").cast("long").alias("weight")), "node")
    mark = saved(mark, "marks")
    # sums of squares may pass 2^63
    w = F.col("weight").cast("double")
    table = mark.groupBy("d", "h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("size"), F.sum(w).alias("total"), F.sum(w * w).alias("squares"))
    table = saved(table.withColumn("id", F.monotonically_increasing_id()), "classes")
    at = lambda c: table.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    contacts = saved(e.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), "class-contacts")
    many = contacts.count()
    if many > HELD:
        return None
    nodes = mark.join(table.select("d", "h1", "h2", "id"), ["d", "h1", "h2"]).select("node", "id", "weight")
    return Classes(table.select("id", "size", "total", "squares"), nodes, contacts, 2 * many * table.count())


@dataclass
class Arrays:
    """A graph of classes as arrays; the classes of a component lie together, and those of component c from start[c] on."""

    ids: np.ndarray
    offsets: np.ndarray
    others: np.ndarray
    component: np.ndarray
    start: np.ndarray
    size: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    @property
    def costs(self) -> np.ndarray:
        """What a search from each class may see: the nodes and contacts of its component."""
        contacts = self.offsets[self.start[1:]] - self.offsets[self.start[:-1]]
        return (contacts + np.diff(self.start))[self.component]


def _components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[src], label[dst])
        now = label.copy()
        np.minimum.at(now, label[src], low)
        np.minimum.at(now, label[dst], low)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, label):
            return np.unique(label, return_inverse=True)[1]
        label = now


def arrays(found: Classes) -> Arrays:
    nodes, pairs = found.table.toArrow(), found.contacts.toArrow()
    column = lambda t, c, kind: t[c].to_numpy().astype(kind)
    ids = column(nodes, "id", np.int64)
    order = np.argsort(ids)
    place = lambda x: order[np.searchsorted(ids, x, sorter=order)]
    one, two = place(column(pairs, "src", np.int64)), place(column(pairs, "dst", np.int64))
    component = _components(len(ids), one, two)
    by = np.argsort(component, kind="stable")
    new = np.empty(len(by), np.int64)
    new[by] = np.arange(len(by))
    src, dst = new[np.concatenate([one, two])], new[np.concatenate([two, one])]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
    start = np.concatenate([[0], np.cumsum(np.bincount(component))]).astype(np.int64)
    fact = lambda c: column(nodes, c, np.float64)[by]
    return Arrays(ids[by], offsets, dst[np.argsort(src, kind="stable")].astype(np.int32), component[by], start, fact("size"), fact("total"), fact("squares"))


def _levels(g: Arrays, pivots: np.ndarray):
    """Breadth-first levels from the pivots at once. A place is a pivot's own copy of a node of its component.

    Gives the number of places and for each level its places, their pivots (by number) and nodes, the number of paths to them, and the steps on from them
    to the next level: the number of the place in its level and the place it leads to. Levels below hold these as found.
    """
    comp = g.component[pivots]
    ends = np.cumsum(g.start[comp + 1] - g.start[comp])
    base = ends - g.start[comp + 1]  # of place over node
    many = int(ends[-1])
    seen, paths = np.zeros(many, bool), np.zeros(many)
    at, pivot, node = base + pivots, np.arange(len(pivots)), pivots
    seen[at], paths[at] = True, 1.0
    out = []
    while len(at):
        deg = g.offsets[node + 1] - g.offsets[node]
        of = np.repeat(np.arange(len(at)), deg)
        to = g.others[np.arange(len(of)) + np.repeat(g.offsets[node] - np.cumsum(deg) + deg, deg)]
        to = base[pivot[of]] + to
        fresh = ~seen[to]
        of, to = of[fresh], to[fresh]
        out.append((at, pivot, node, paths[at], of, to))
        # a path goes through any of a class, but starts at one
        gain = (paths[at] * (g.size[node] if len(out) > 1 else 1.0))[of]
        if 8 * len(to) > many:
            found = np.bincount(to, gain, minlength=many)
            at = np.flatnonzero(found)
            paths[at] = found[at]
        else:
            at, which = np.unique(to, return_inverse=True)
            paths[at] = np.bincount(which, gain, minlength=len(at))
        seen[at] = True
        pivot = np.searchsorted(ends, at, side="right")
        node = at - base[pivot]
    return many, out


def _dependencies(g: Arrays, pivots: np.ndarray, into: np.ndarray) -> None:
    """Adds to ``into``, by node, how much of the paths from the pivots goes through one of it."""
    many, levels = _levels(g, pivots)
    worth, nodes, deltas = np.zeros(many), [], []
    for at, pivot, node, paths, of, to in reversed(levels[1:]):
        delta = paths * np.bincount(of, worth[to], minlength=len(at))
        worth[at] = (g.total[node] + g.size[node] * delta) / paths
        nodes.append(node)
        deltas.append(delta * g.total[pivots[pivot]])
    # two of one class meet in all their contacts
    _, pivot, node, _, of, to = levels[0]
    if len(levels) > 1:
        near = levels[1]
        number = np.searchsorted(near[0], to)
        between = np.bincount(of, g.size[near[2][number]], minlength=len(node))
        inside = (g.total[node] ** 2 - g.squares[node]) / np.maximum(between, 1.0)
        nodes.append(near[2][number])
        deltas.append(np.where(g.size[node] > 1, inside, 0.0)[of])
        where = np.concatenate(nodes)
        low = int(where.min())
        sums = np.bincount(where - low, np.concatenate(deltas))
        into[0, low : low + len(sums)] += sums


def _distances(g: Arrays, pivots: np.ndarray, into: np.ndarray) -> None:
    """Sets in ``into``, by pivot, the sum of weighted distances from one of it to all nodes of other classes, and how many these are."""
    _, levels = _levels(g, pivots)
    for i, (_, pivot, node, *_) in enumerate(levels):
        if i:
            into[0, pivots] += i * np.bincount(pivot, g.total[node], minlength=len(pivots))
            into[1, pivots] += np.bincount(pivot, g.size[node], minlength=len(pivots))


def _batches(costs: np.ndarray) -> Iterator[slice]:
    """Runs of classes that see SEEN nodes and contacts together, one at least."""
    ends, low = np.cumsum(costs), 0
    while low < len(costs):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SEEN, side="right")))
        yield slice(low, high)
        low = high


def _searched(found: Classes, search) -> DataFrame:
    """id, value and number: the sums over all tasks of what ``search`` puts in for the pivots of each."""
    spark = found.table.sparkSession
    g = arrays(found)
    costs = g.costs
    steps, cores = int(costs.sum()), spark.sparkContext.defaultParallelism
    tasks = max(1, min(len(costs), -(-steps // STEPS), max(2 * cores, ROWS // max(len(costs), 1))))
    if steps > SEEN:
        tasks = min(len(costs), max(tasks, 2 * cores))
    cuts = np.searchsorted(np.cumsum(costs), np.arange(tasks + 1) * (steps / tasks), side="left")
    cuts[0], cuts[-1] = 0, len(costs)
    shared = spark.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for task in batch.column(0).to_numpy():
                into, low = np.zeros((2, len(own.ids))), int(cuts[task])
                for part in _batches(own.costs[low : cuts[task + 1]]):
                    search(own, np.arange(low + part.start, low + part.stop), into)
                hit = np.flatnonzero(into[0])
                for i in range(0, len(hit), 100_000):
                    some = hit[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (own.ids, *into)], names=["id", "value", "number"])

    rows = spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long, value double, number double")
    return saved(rows.groupBy("id").agg(F.sum("value").alias("value"), F.sum("number").alias("number")), "searched")


def dependencies(found: Classes) -> DataFrame:
    """node and delta: the sum over all ordered pairs of nodes of the product of their weights and the share of their shortest paths that the node is on."""
    return found.nodes.join(_searched(found, _dependencies), "id", "left").select("node", F.coalesce("value", F.lit(0.0)).alias("delta"))


def distances(found: Classes) -> DataFrame:
    """node, far and reached: the sum of distances to all nodes that it reaches, each times the other's weight, and how many these are."""
    far = found.table.select("id", "size", "total").join(_searched(found, _distances), "id", "left").na.fill(0.0)
    # those of its own class are two steps away
    return found.nodes.join(far, "id").select("node", (F.col("value") + 2 * (F.col("total") - F.col("weight"))).alias("far"), (F.col("number") + F.col("size") - 1).cast("long").alias("reached"))
