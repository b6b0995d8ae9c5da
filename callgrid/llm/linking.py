"""Links between items that are alike, from banded sketches, in two rounds; documents and lines use it alike.

1. Each bucket gives a star: an edge from its first member to each other. Edges are verified on the full
   sets, and verified links are joined to components.
2. A bucket whose other members still lie in several components is looked through once more, as two of them
   may be alike while neither is like the first: sketches of members of different components are compared,
   and those that may be alike are verified on the full sets. A link makes two components one there and then,
   so fewer links leave the task than the bucket has members. Members of a large bucket are dealt in chunks:
   those of its largest component meet only the chunks of the others, never each other.

So the edges are as many as the bucket entries, and no link between items of one bucket is lost. Items are heads
(node, keys); what a node's set is made of comes from ``contents`` and is turned into a set inside tasks. Keys hold
the sketches themselves, so no second copy of those is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, split_skew
from .components import components
from .shingles import likeness

#: Members of a bucket that go to one chunk.
CHUNK_ROWS = 4096
#: Members of sets (8 bytes each) that a task keeps while it compares.
MOST_HELD = 4_000_000
#: Edges of one top that are verified together.
EDGES = 2048
#: Bits (8 MB of them) of the broadcast bitmap of bucket keys that have several members.
KEY_BITS = 1 << 26


def prefilter(df: DataFrame, key: Column, wanted: DataFrame, column: str, most_bits: int = 1 << 23) -> DataFrame:
    """The rows of ``df`` whose ``key`` (long) may be among ``wanted[column]``: all that are, and a few others.

    A bitmap of at most ``most_bits`` bits (1 MB) is built by Spark and broadcast as a table of 64-bit words, so
    long rows that a join would drop anyway are not shuffled. With more keys than bits it drops less, never more;
    the table never has more than ``most_bits`` / 64 rows of 16 bytes, whatever the input.
    """
    bits = most_bits
    place = lambda c: F.expr(f"pmod(xxhash64({c}), {bits})")
    words = wanted.select(place(column).alias("__b")).select(F.expr("__b div 64").alias("__word"), F.expr("shiftleft(1L, cast(__b % 64 as int))").alias("__m"))
    bitmap = words.groupBy("__word").agg(F.bit_or("__m").alias("__bits"))
    marked = df.withColumn("__k", key).withColumn("__p", place("__k"))
    hit = marked.withColumn("__word", F.expr("__p div 64")).join(F.broadcast(bitmap), "__word")
    return hit.where("(shiftright(__bits, cast(__p % 64 as int)) & 1) = 1").select(df.columns)


class Items:
    """How contents of nodes are compared: as sorted arrays of hashes, which the contents are already."""

    #: Whether may_be() never drops a pair that is alike, so that it can go before the sets are fetched.
    prunes = False

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows

    def sketches(self, keys: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The keys of rows as matrices: for each, the place of a row in it, and the matrix."""
        flat = keys.combine_chunks().flatten().to_numpy()
        return [(np.arange(len(keys)), flat.reshape(len(keys), self.bands))]

    def may_be(self, sketches: list, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of rows may be alike; ``m`` and ``n`` are the sizes of the sets where ``prunes`` holds.

        Here a pair that is alike is dropped with a probability of about 1e-7, 5.2 standard deviations.
        """
        share, keys = percent / 100, sketches[0][1]
        return likeness(keys[a], keys[b], self.rows) >= share - 5.2 * math.sqrt(share * (1 - share) / (self.bands * self.rows))

    def first_shared(self, sketches: list, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether ``key`` is the first that a pair shares: that bucket deals with it."""
        keys = sketches[0][1]
        return keys[a, (keys[a] == keys[b]).argmax(axis=1)] == key

    def to_set(self, content: bytes) -> Any:
        return np.frombuffer(content, np.uint64)

    def common(self, a: Any, b: Any) -> int:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        at = np.searchsorted(large, small)
        return int((large[np.minimum(at, len(large) - 1)] == small).sum())

    def alike(self, a: Any, b: Any, percent: int) -> bool:
        """Whether ``percent`` of the union of two sets is common."""
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        common = self.common(a, b)
        return 100 * common >= percent * (len(a) + len(b) - common)


def verified(edges: DataFrame, contents: DataFrame, percent: int, items: Items) -> DataFrame:
    """The edges (a, b) whose full sets are alike.

    The content of an ``a`` is sent once for each EDGES of its edges, which go to one part; a hub's edges are dealt to several.
    """
    hubs = edges.groupBy("a").agg(F.ceil(F.count("*") / EDGES).cast("int").alias("parts"))
    dealt = edges.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    ends = dealt.join(contents.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "content")
    tops = hubs.select("a", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")).join(contents.withColumnRenamed("node", "a"), "a")
    both = ends.unionByName(tops.select("a", "part", F.lit(None).cast("long").alias("b"), "content"))
    both = both.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            keep = []
            content = batch.column(3)
            for i, b in enumerate(batch.column(2).to_pylist()):
                own = items.to_set(content[i].as_py())
                top = own if b is None else top
                keep.append(b is not None and items.alike(top, own, percent))
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _merged(label: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The labels after the components of each pair of labels are made one."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    old = np.array(sorted(up), np.int64)
    at = np.minimum(np.searchsorted(old, label), len(old) - 1)
    return np.where(old[at] == label, np.array([top(x) for x in old.tolist()])[at], label)


def _by_group(each: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` of the tables of whole groups: rows whose first three columns are equal, which follow each other; a table may hold several groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(i).to_numpy() for i in range(3)]
            tail = np.logical_and.reduce([x == x[-1] for x in ids])
            cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
            if last is not None and last != tuple(int(x[0]) for x in ids):
                yield each(pa.Table.from_batches(held))
                held = []
            if cut:
                yield each(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
            last = tuple(int(x[-1]) for x in ids)
        if held:
            yield each(pa.Table.from_batches(held))

    return run


def _steps(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group: those that stand d rows apart, for d = 1, 2, ..."""
    group = np.cumsum((np.diff(key, prepend=key[0]) != 0) | (np.diff(low, prepend=low[0]) != 0) | (np.diff(high, prepend=high[0]) != 0))
    left = np.searchsorted(group, group, "right") - np.arange(len(group))  # rows from here to the end of the group
    d, at = 0, np.arange(len(group))
    while len(at := at[left[at] > (d := d + 1)]):
        yield at, at + d


def _inside(percent: int, items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of groups (key, low, high), which follow each other in a task: links that make one component of members of several.

    Rows of all groups at hand are compared at once.
    """

    def links(t: pa.Table) -> pa.RecordBatch:
        key, low, high, node, label, chunk = (t.column(c).to_numpy() for c in ("key", "low", "high", "node", "label", "chunk"))
        keys = items.sketches(t.column("keys"))
        content = t.column("content")
        size = t.column("n").to_numpy() if items.prunes else np.zeros(len(key), np.int64)
        found, sets, held = [], {}, 0
        for i, j in _steps(key, low, high):
            some = (label[i] != label[j]) & ((low[i] == high[i]) | (chunk[i] != chunk[j]))
            i, j = i[some], j[some]
            for s in range(0, len(i), 4096):
                a, b = i[s : s + 4096], j[s : s + 4096]
                near = items.may_be(keys, a, b, size[a], size[b], percent)
                a, b = a[near], b[near]
                mine = items.first_shared(keys, a, b, key[a]) if len(a) else near[:0]
                joined = []
                for x, y in zip(a[mine].tolist(), b[mine].tolist(), strict=True):
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = items.to_set(content[z].as_py())
                            held += len(sets[z])
                    if items.alike(sets[x], sets[y], percent):
                        joined.append((int(label[x]), int(label[y])))
                        found.append((int(node[x]), int(node[y])))
                if joined:
                    label = _merged(label, joined)
                if held > MOST_HELD:
                    sets.clear()
                    held = 0
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_group(links)


def _pruned(edges: DataFrame, heads: DataFrame, percent: int, items: Items) -> DataFrame:
    """The edges (a, b) that may be alike by the keys of their ends."""
    with_b = edges.join(heads.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b")), "b")
    both = with_b.join(heads.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("keys").alias("keys_a")), "a").select("a", "b", "n_a", "n_b", "keys_a", "keys_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, n = (b.column(i).to_numpy() for i in (2, 3))
                at = np.arange(len(m))
                keys = items.sketches(pa.chunked_array([b.column(4), b.column(5)]))
                yield b.select([0, 1]).filter(pa.array(items.may_be(keys, at, at + len(m), m, n, percent)))

    return both.mapInArrow(run, "a long, b long")


def _likely(percent: int, items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of groups (key, low, high), which follow each other in a task: pairs that may be alike, of two components; so many as connect all that such pairs connect."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, low, high, node, label, chunk, n = (t.column(c).to_numpy() for c in ("key", "low", "high", "node", "label", "chunk", "n"))
        keys = items.sketches(t.column("keys"))
        root, found = np.arange(len(node)), []
        for i, j in _steps(key, low, high):
            some = (label[i] != label[j]) & (root[i] != root[j]) & ((low[i] == high[i]) | (chunk[i] != chunk[j]))
            i, j = i[some], j[some]
            joined = []
            for s in range(0, len(i), 4096):
                a, b = i[s : s + 4096], j[s : s + 4096]
                near = items.may_be(keys, a, b, n[a], n[b], percent)
                joined += zip(a[near].tolist(), b[near].tolist(), strict=True)
            if joined:
                found += joined
                root = _merged(root, [(int(root[x]), int(root[y])) for x, y in joined])
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return _by_group(pairs)


def link(heads: DataFrame, contents: Callable[[DataFrame], DataFrame], items: Items, percent: int, once: bool) -> DataFrame:
    """node and label of all nodes that links reach.

    heads: node and keys (one for each band); ``once``: a node has one row, with n, the size of its set, so that edges between sets of
    too unlike sizes drop out before the sets are fetched. contents gives node and content of a table of nodes.
    """
    split_skew(heads.sparkSession)
    sizes = ["n"] if once else []
    entries = heads.select("node", *sizes, F.explode("keys").alias("key"))
    stars = entries.groupBy("key").agg(F.min("node").alias("top"), F.max("node").alias("last"), *[F.min_by("n", "node").alias("top_n") for _ in sizes]).where("top < last").drop("last")
    stars = saved(stars, "stars", random=True)
    shared = prefilter(entries, F.col("key"), stars, "key", KEY_BITS).join(stars, "key")
    shared = saved(shared if once else shared.dropDuplicates(["key", "node"]), "buckets", [stars], random=True)
    return linked(shared, heads, contents, items, percent, once)


def linked(shared: DataFrame, heads: DataFrame, contents: Callable[[DataFrame], DataFrame], items: Items, percent: int, once: bool) -> DataFrame:
    """As link(), from the buckets' members: ``shared`` (a table of ``saved``, which goes) has key, node and top, and n and top_n where heads have n."""
    split_skew(heads.sparkSession)
    edges = shared.where("node <> top")
    if "n" in shared.columns:
        edges = edges.where(f"100 * least(n, top_n) >= {percent} * greatest(n, top_n)")
    edges = edges.select(F.col("top").alias("a"), F.col("node").alias("b")).distinct()
    if items.prunes:
        edges = saved(_pruned(edges, heads, percent, items), "near-edges")
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    else:
        nodes = shared.select("node").distinct()
    content = saved(contents(nodes), "contents")
    small_batches(heads.sparkSession, 1000)
    links = saved(verified(edges, content, percent, items), "links")
    labels = components(links)

    tagged = shared.where("node <> top").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).select("key", "node", "label")
    tagged = saved(tagged, "tagged", [shared])
    mixed = tagged.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
    parts = tagged.join(mixed, "key").groupBy("key", "label").agg(F.count("*").alias("size"))
    parts = parts.groupBy("key").agg(F.sum("size").alias("many"), F.max("size").alias("size"), F.max_by("label", F.struct("size", "label")).alias("main"))
    in_chunks = lambda c: F.ceil(F.col(c) / CHUNK_ROWS)
    parts = parts.withColumn("split", F.col("many") > CHUNK_ROWS).select(
        "key", "main", "split", F.when(F.col("split"), F.ceil((F.col("many") - F.col("size")) / CHUNK_ROWS)).otherwise(1).alias("others"), F.when(F.col("split"), in_chunks("size")).otherwise(0).alias("mains")
    )
    again = tagged.join(parts, "key").withColumn("is_main", F.expr("split AND label = main"))
    again = again.withColumn("chunk", F.expr("cast(IF(is_main, others + pmod(xxhash64(node), mains), pmod(xxhash64(node), others)) as int)"))
    again = again.withColumn("other", F.explode(F.expr("sequence(0, cast(IF(is_main, others, others + mains) as int) - 1)")))
    again = again.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "node", "label", "chunk")
    grouped = lambda rows: rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    sizes = ["n"] if items.prunes else []
    if items.prunes:  # only what may be alike is compared, in clusters: a node's set goes to one, not to each of its buckets
        near = grouped(again.join(heads.select("node", "n", "keys"), "node"))
        cluster = components(saved(near.mapInArrow(_likely(percent, items), "a long, b long").distinct(), "near-pairs")).withColumnRenamed("label", "cluster")
        cluster = cluster.join(cluster.groupBy("cluster").agg(F.count("*").alias("many")), "cluster")
        cluster = saved(cluster.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-nodes")
        content = saved(contents(cluster.select("node")), "contents", [content])
        zero = F.lit(0)
        small = cluster.where(F.col("many") <= CHUNK_ROWS).select(F.col("cluster").alias("key"), zero.alias("low"), zero.alias("high"), "node", "label", zero.alias("chunk"))
        again = small.unionByName(again.join(cluster.where(F.col("many") > CHUNK_ROWS).select("node"), "node", "left_semi"))
    detail = heads.select("node", "keys", *sizes).join(again.select("node").distinct(), "node", "left_semi")
    detail = (detail if once else detail.dropDuplicates(["node"])).join(content, "node")
    groups = grouped(again.join(detail, "node")).select("key", "low", "high", "node", "label", "chunk", "keys", "content", *sizes)
    more = saved(groups.mapInArrow(_inside(percent, items), "a long, b long"), "more-links", [tagged])
    if not more.head(1):
        return labels
    # the components that the new links make one: few, so their labels are joined in
    named = labels.select(F.col("node"), "label")
    ends = more.join(named.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = components(saved(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), "label-links"))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("now"))
    moved = labels.join(joined, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    alone = joined.join(labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("now").alias("label"))
    return saved(moved.union(alone), "labels")
