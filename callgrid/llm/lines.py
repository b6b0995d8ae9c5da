"""Fuzzy line dedup by MinHash over character shingles.

Lines are normalised (trimmed, runs of white space as one space, lower case) and equal ones count once. Each
line has a one-permutation sketch of its shingles; bands of the sketch give candidates, Jaccard similarity
is checked on the full shingle sets, and links are joined to components by the distributed union-find of
this folder. Of each component one line stays: the first by doc_id and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, read, salted_join, saved, small_batches
from .linking import Items, link, prefilter
from .shingles import OnePermutation, _powers, band_keys, blocks, mix

#: Characters of a shingle; percent of the union that must be common; bands and rows: a pair of similarity 0.8
#: shares no band with a probability of 2e-4, one of 0.85 of 7e-6.
SHINGLE, PERCENT, BANDS, ROWS = 8, 80, 16, 4
#: Characters whose shingles are hashed at once: arrays that stay in the cache.
HASHED = 1 << 15


def normalised_lines(text: str | None) -> list[bytes]:
    """The lines of a text in UTF-8: trimmed, runs of the six characters of SPACE as one space, lower case; blank lines are empty."""
    raw = (text or "").lower().encode()
    if b"  " in raw or any(c in raw for c in (b"\t", b"\r", b"\x0b", b"\x0c")):
        return [b" ".join(line.split()) for line in raw.split(b"\n")]
    return [line.strip(b" ") for line in raw.split(b"\n")]


def line_set(content: bytes, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingles of a line (UTF-8); a shorter line is one shingle."""
    points = np.frombuffer(content.decode().encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64)
    many = max(1, len(points) - k + 1)
    up, down = _powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint32(1)) * up[: len(points)], out=total[1:])
    h = mix((total[min(k, len(points)) :] - total[:many]) * down[:many])
    h.sort()  # np.unique() fills a hash table first, which takes longer than all the rest here
    first = np.ones(many, bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def line_sketches(lines: list[bytes], oph: OnePermutation, k: int = SHINGLE) -> np.ndarray:
    """The densified sketch of each line, none of them empty."""
    none = np.uint64((1 << 64) - 1)
    values = [np.zeros((0, oph.bins), np.uint64)]
    for part in blocks([len(x) for x in lines], HASHED):
        texts = [lines[i].decode() for i in part]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        n, starts = len(points), ends - sizes
        up, down = _powers(n + 1)
        total = np.zeros(n + k, np.uint64)
        np.cumsum((points + np.uint32(1)) * up[:n], out=total[1 : n + 1])
        h = mix((total[k:] - total[:n]) * down[:n])
        # a hash from each place on; those that would leave their line count for nothing, and a short line is one
        over = ends[:, None] - np.arange(1, k)
        h[over[over >= starts[:, None]]] = none
        short = sizes < k
        h[starts[short]] = mix((total[ends[short]] - total[starts[short]]) * down[starts[short]])
        slot = np.repeat(np.arange(0, len(sizes) * oph.bins, oph.bins), sizes)
        slot += ((h >> np.uint64(32)) * np.uint64(oph.bins) >> np.uint64(32)).view(np.int64)
        least = np.full(len(sizes) * oph.bins, none)
        np.minimum.at(least, slot, h)
        values.append(least.reshape(-1, oph.bins))
    every = np.concatenate(values)
    return oph.densify(every, every != none)


class LineItems(Items):
    """Contents are lines in UTF-8; their sets hold 64-bit hashes of the shingles."""

    def to_set(self, content: bytes) -> np.ndarray:
        return line_set(content)


def _node(line: bytes) -> int:
    """A line's hash as a signed 64-bit integer."""
    h = xxhash.xxh64_intdigest(line)
    return h - (1 << 64) if h >> 63 else h


def _sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark, nodes (hash of each line, null where blank), fresh (node and keys of lines new to the task's batch)."""
    small_batches(docs.sparkSession, 2000)  # lines that repeat in a batch are sketched once
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = OnePermutation(bands * rows)
        for b in batches:
            nodes, counts, known, texts, new = [], [0], set(), [], []
            for text in b.column(2).to_pylist():
                found = []
                for raw in normalised_lines(text):
                    node = _node(raw) if raw else None
                    found.append(node)
                    if raw and node not in known:
                        known.add(node)
                        texts.append(raw)
                        new.append(node)
                nodes.append(found)
                counts.append(len(new))
            keys = band_keys(line_sketches(texts, oph), bands, rows).view(np.int64)
            fresh = pa.StructArray.from_arrays(
                [pa.array(new, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * bands, pa.int32()), pa.array(keys.ravel()))], names=["node", "keys"]
            )
            columns = [pa.array(nodes, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), fresh)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "mark", "nodes", "fresh"])

    schema = f"doc_id {kind}, mark long, nodes array<long>, fresh array<struct<node: long, keys: array<long>>>"
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, schema)


def _each_line(docs: DataFrame) -> DataFrame:
    """node and content of the lines, each once in a task's batch: read again, as a copy of all lines would be as large as the texts."""
    small_batches(docs.sparkSession, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = {_node(raw): raw for raw in {raw for text in b.column(0).to_pylist() for raw in normalised_lines(text)} if raw}
            yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.int64()), pa.array(list(each.values()), pa.binary())], names=["node", "content"])

    return docs.select("text").mapInArrow(run, "node long, content binary")


def duplicate_lines(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, mark, n_lines), and the places (from 0) of the lines that each loses (doc_id, mark, gone)."""
    base = saved(_sketched(docs, bands, rows), "lines", random=True)
    heads = base.select(F.explode("fresh").alias("f")).select("f.node", "f.keys")

    def contents(nodes: DataFrame) -> DataFrame:
        near = prefilter(_each_line(docs), F.col("node"), nodes, "node")
        # grouped first: a semi join could be pushed below the bitmap, and all lines would be shuffled
        return near.groupBy("node").agg(F.first("content").alias("content")).join(nodes, "node", "left_semi")

    labels = link(heads, contents, LineItems(bands, rows), percent, once=False)
    # only lines that stand in several places, or are like others, can go: the rest needs no further shuffle
    every = base.select(F.explode("nodes").alias("node")).where("node IS NOT NULL")
    often = every.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    wanted = saved(often.union(labels.select("node")), "shared-lines")
    placed = base.select("doc_id", "mark", F.posexplode("nodes").alias("at", "node")).where("node IS NOT NULL")
    named = prefilter(placed, F.col("node"), wanted, "node").join(labels, "node", "left").select(
        "doc_id", "mark", "at", F.coalesce("label", "node").alias("label"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "at").alias("where")
    )
    named = saved(named, "named-lines", [wanted])
    first = named.groupBy("label").agg(F.min("where").alias("first"), F.count("*").alias("many")).where("many > 1")
    lost = salted_join(named, saved(first, "first-lines"), "label", "many").where("where > first")
    gone = saved(lost.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone")), "lost-lines")
    return base.select("doc_id", "mark", F.size(F.filter("nodes", lambda x: x.isNotNull())).cast("long").alias("n_lines")), gone


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (lines with a word), n_removed, removed (their places among all lines of the text, from 0, ascending).

    Null and empty texts have no lines. The first line of each component by doc_id (nulls last), text and
    place stays; all others go, also within a document. Rows that repeat both doc_id and text are one
    document and have equal results. An empty table gives no rows; other columns are ignored.
    """
    base, gone = duplicate_lines(docs)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.sort_array("gone").alias("gone"))
    both = base.join(gone, base["doc_id"].eqNullSafe(gone["__id"]) & (base["mark"] == gone["__mark"]), "left")
    removed = F.coalesce("gone", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """The documents with one line kept of each component; blank lines and all columns stay, and no document goes."""
    _, gone = duplicate_lines(docs)
    small_batches(docs.sparkSession)
    met = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["mark"])
    both = docs.join(gone, met, "left").select(*[docs[c] for c in docs.columns], gone["gone"].alias(free_name(docs, "gone")))
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, lost in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if lost:
                    drop = set(lost)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == place else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(run, docs.schema)


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))
