"""Substring dedup over a compacted de Bruijn graph of words.

1. Seeds: each window of 50 words is filed under the least hash of its 16-word runs, so equal windows have one
   seed wherever they are. Seeds that occur in one document only drop out at once; what is left of a document
   are stretches whose windows may be repeated.
2. Graph: the 16-word runs of the stretches are edges between the 15-word runs in them. Spark compares the edges
   into and out of all occurrences of a node. It is a junction if they are unlike on a side, or if a stretch
   begins or ends there; all other nodes lie inside paths that do not branch.
3. Compaction: joins of the steps with the junctions give each stretch its cuts. Between two cuts lies one
   path, the same in whatever document it occurs, so windows that start on one path and end on one path form a
   range, and a repeat of any length is a row for each such range.
4. Verification: the words of each range are read at their source coordinates and compared by their SHA-256.

What is found is laid over the sources, and the covered words are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, salted_join, saved, small_batches, split_skew
from .linking import KEY_BITS, prefilter
from .shingles import mix, run_hashes, word_hashes, word_spans

#: Words of a window, and of an edge; seeds are edges too.
WINDOW, EDGE = 50, 16


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def seeds(words: np.ndarray, window: int, edge: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seed, first window and number of windows of each run of windows with one seed."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    least = _least(run_hashes(words, edge), window - edge + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return least[start].view(np.int64), start, np.diff(np.append(start, len(least)))


def _lists(counts: list[int], columns: list[np.ndarray], names: list[str]) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names))


def _walked(docs: DataFrame, window: int, edge: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, sha (kept_sha256 of all words) and seeds of each document."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, counts, parts = [], [], [], []
            for text in b.column(2).to_pylist():
                split = (text or "").encode().split()
                joined = b" ".join(split)
                found = seeds(word_hashes(joined), window, edge)
                n.append(len(split))
                sha.append(hashlib.sha256(joined).hexdigest())
                counts.append(len(found[0]))
                parts.append(found)
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), _lists(counts, columns, ["seed", "start", "count"])],
                names=["doc_id", "mark", "n_words", "sha", "seeds"],
            )

    schema = f"doc_id {kind}, mark long, n_words long, sha string, seeds array<struct<seed: long, start: long, count: long>>"
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, schema)


def stretches(where: list[dict]) -> list[tuple[int, int]]:
    """First window and end (exclusive) of each maximal run of windows in ``where`` (start, count)."""
    out: list[list[int]] = []
    for start, count in sorted((w["start"], w["count"]) for w in where):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + count)
        else:
            out.append([start, start + count])
    return [(a, b) for a, b in out]


def _steps(texts: DataFrame, window: int, edge: int, placed: bool) -> DataFrame:
    """Of each node of the stretches of ``texts`` (row, text, where): node, and row and at (word) if ``placed``, else both its edges as one hash, 0 at an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, more, owner = [], [], []
            for row, text, where in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = word_hashes((text or "").encode())
                edges, nodes = run_hashes(words, edge), run_hashes(words, edge - 1).view(np.int64)
                for first, end in stretches(where):
                    at = np.arange(first, end - 1 + window - (edge - 1) + 1)
                    node.append(nodes[at])
                    if placed:
                        owner.append(np.full(len(at), row))
                        more.append(at)
                    else:
                        both = np.zeros(len(at), np.uint64)
                        both[1:-1] = mix(edges[at[1:-1] - 1]) * np.uint64(3) + edges[at[1:-1]] | np.uint64(1)
                        more.append(both.view(np.int64))
            if node:
                columns = [np.concatenate(node), *([np.concatenate(owner)] if placed else []), np.concatenate(more)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "row", "at"] if placed else ["node", "edges"])

    return texts.select("row", "text", "where").mapInArrow(run, "node long, row long, at long" if placed else "node long, edges long")


def ranges(first: int, end: int, cuts: np.ndarray, window: int, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows of the ranges of a stretch that start on one path and end on one path.

    A window's last edge begins window - edge words after its first, so ranges change at the cuts and that much before them.
    """
    at = np.unique(np.concatenate([[first, end], cuts, cuts - (window - edge)]))
    at = at[(at >= first) & (at <= end)]
    return at[:-1], np.diff(at)


def _verified(texts: DataFrame, window: int, edge: int) -> DataFrame:
    """digest of the words, doc_id, mark, start and count of each range of ``texts`` (doc_id, mark, text, where, cuts)."""
    kind = dict(texts.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, digest, start, count = [], [], [], []
            for i, (text, where, cuts) in enumerate(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                joined = b" ".join((text or "").encode().split())
                _, starts, ends = word_spans(joined)
                cuts = np.array(cuts, np.int64)
                for first, end in stretches(where):
                    for s, n in zip(*(x.tolist() for x in ranges(first, end, cuts, window, edge)), strict=True):
                        owner.append(i)
                        digest.append(hashlib.sha256(joined[starts[s] : ends[s + n + window - 2]]).digest())
                        start.append(s)
                        count.append(n)
            own = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), b.column(0).take(own), b.column(1).take(own), pa.array(start, pa.int64()), pa.array(count, pa.int64())],
                names=["digest", "doc_id", "mark", "start", "count"],
            )

    return texts.select("doc_id", "mark", "text", "where", "cuts").mapInArrow(run, f"digest binary, doc_id {kind}, mark long, start long, count long")


def _covered(n: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["s"]] += 1
        edge[s["e"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def repeated_spans(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, mark, n_words, sha) and the repeats of those that have any (doc_id, mark, spans: words [s, e))."""
    split_skew(docs.sparkSession)
    base = saved(_walked(docs, window, edge).withColumn("row", F.monotonically_increasing_id()), "seeds", random=True)
    each = base.where("doc_id IS NOT NULL").select("row", "doc_id", "mark", F.explode("seeds").alias("p"))
    met = each.groupBy(F.col("p.seed").alias("seed")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("seed")
    held = each.select("row", "doc_id", "mark", "p.*").join(met, "seed").groupBy("row", "doc_id", "mark").agg(F.collect_list(F.struct("start", "count")).alias("where"))
    held = saved(held, "stretches")
    key = F.xxhash64("doc_id", "mark")
    texts = prefilter(_marked(docs), key, held.select(key.alias("k")), "k").dropDuplicates(["doc_id", "mark"])
    small_batches(docs.sparkSession, 200)
    texts = saved(held.join(texts, ["doc_id", "mark"]).select("row", "doc_id", "mark", "text", "where"), "stretch-texts", [held])

    # a node inside a path always has the same two edges; the steps are made twice, as a table of them would be larger than the texts
    degrees = _steps(texts, window, edge, placed=False).groupBy("node").agg(F.min("edges").alias("least"), F.max("edges").alias("most"))
    junctions = saved(degrees.where("least < most OR least = 0").select("node"), "junctions", random=True)
    steps = prefilter(_steps(texts, window, edge, placed=True), F.col("node"), junctions, "node", KEY_BITS)
    cuts = saved(steps.join(junctions, "node").groupBy("row").agg(F.collect_list("at").alias("cuts")), "cuts", [junctions])
    found = saved(_verified(texts.join(cuts, "row"), window, edge), "ranges", [texts, cuts])

    first = found.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("many")).where("first < last").drop("last")
    again = salted_join(found, saved(first, "range-firsts"), "digest", "many").where("doc_id > first")
    spans = again.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("count") + (window - 1)).alias("e"))).alias("spans"))
    return base.drop("seeds", "row"), saved(spans, "repeats", [found])


def _cut(docs: DataFrame, spans: DataFrame, keep_text: bool) -> DataFrame:
    """doc_id, mark, number of words gone and what is left (the text or its digest), one row for each doc_id and text."""
    kind = dict(docs.dtypes)["doc_id"]
    texts = prefilter(_marked(docs), F.xxhash64("doc_id", "mark"), spans.select(F.xxhash64("doc_id", "mark").alias("k")), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, out = [], []
            for text, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                split = (text or "").encode().split()
                drop = _covered(len(split), found)
                left = b" ".join([w for w, d in zip(split, drop.tolist(), strict=True) if not d])
                gone.append(int(drop.sum()))
                out.append(left.decode() if keep_text else hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "mark", "gone", "left"])

    return texts.join(spans, ["doc_id", "mark"]).select("doc_id", "mark", "text", "spans").mapInArrow(run, f"doc_id {kind}, mark long, gone long, left string").dropDuplicates(["doc_id", "mark"])


def removed(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document.

    Words covered by a window of ``window`` words that also starts in a document of smaller doc_id go; all
    windows are judged on the input. Null, empty and blank texts have no words; shorter texts than a window
    lose none; rows with a null doc_id neither lose words nor count as earlier documents; rows that repeat a
    doc_id are not earlier than each other; an empty table gives no rows; other columns are ignored.
    """
    base, spans = repeated_spans(docs, window, edge)
    cut = _cut(docs, spans, keep_text=False)
    return base.join(cut, ["doc_id", "mark"], "left").select(
        "doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left", "sha").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """The documents with repeated words removed; a text that loses words has its others joined by one space. All rows and columns stay, also where names clash."""
    _, spans = repeated_spans(docs, window, edge)
    cut = _cut(docs, spans, keep_text=True).withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark").withColumnRenamed("left", "__left").drop("gone")
    joined = docs.join(cut, docs["doc_id"].eqNullSafe(cut["__id"]) & (F.xxhash64(docs["text"]) == cut["__mark"]), "left")
    return joined.select(*[F.coalesce(cut["__left"], docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents"))
