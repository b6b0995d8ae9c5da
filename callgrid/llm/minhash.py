"""Near-duplicate documents by MinHash.

One-permutation sketches with optimal densification are cut into bands; documents that agree in a band share
a bucket, and documents with equal shingle sets count once. ``linking`` takes the buckets from there: star-
shaped candidate edges, verified on the full sets, then what the stars leave open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, salted_join, saved, small_batches
from .linking import Items, link, prefilter
from .shingles import OnePermutation, band_keys, shingle_set, word_hashes

#: Words of a shingle; bands and rows. A pair of similarity 0.85 shares no band with a probability of 2e-8, one of 0.8 of 3e-6.
WORDS, BANDS, ROWS = 5, 24, 4


def sketches(docs: DataFrame, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, class1 and class2 (equal for equal sets), keys (one for each band).

    Documents without words have no shingles and null keys.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = OnePermutation(bands * rows)
        for b in batches:
            sizes, first, second, values, full = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(word_hashes((text or "").encode().lower()), n)
                sizes.append(len(s))
                first.append(int(s.sum(dtype=np.uint64)))
                second.append(int(np.bitwise_xor.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F) ^ s >> np.uint64(29))) if len(s) else 0)
                v, f = oph.sketch(s) if len(s) else (np.zeros(oph.bins, np.uint64), np.ones(oph.bins, bool))
                values.append(v)
                full.append(f)
            dense = oph.densify(np.array(values), np.array(full))
            keys = band_keys(dense, bands, rows)
            none = np.array(sizes) == 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)), lists,
                ],
                names=["doc_id", "n_shingles", "class1", "class2", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, class1 long, class2 long, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int = WORDS) -> DataFrame:
    """node and content (sorted 64-bit hashes) of the ``wanted`` (node, doc_id, class1)."""
    text = docs.select(F.col("doc_id").alias("__id"), "text")
    chosen = text.join(wanted, text["__id"].eqNullSafe(wanted["doc_id"])).select("node", "class1", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, found = [], []
            for node, c, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = shingle_set(word_hashes((text or "").encode().lower()), n)
                if int(s.sum(dtype=np.uint64).view(np.int64)) == c:  # of rows with one doc_id, those of this class
                    nodes.append(node)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "content"])

    return chosen.mapInArrow(run, "node long, content binary").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document.

    Two documents are linked if ``percent`` of the union of their sets of ``n``-word shingles is common (words
    after lower-casing A-Z; a shorter text is one shingle). component_id is the least doc_id that links reach;
    kept: doc_id is component_id. Texts that are null, empty or blank have no shingles, no link and
    themselves as component. Rows that repeat a doc_id stay, each with the component of its own text; a null doc_id
    is never a component_id unless the component has no other, and then kept is false; an empty table gives no
    rows; other columns are ignored.
    """
    base = saved(sketches(docs, n, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketches")
    own = F.when(F.col("n_shingles") > 0, F.struct("class1", "class2", "n_shingles", F.lit(0).cast("long").alias("row"))).otherwise(F.struct("class1", "class2", "n_shingles", "row"))
    narrow = base.select("row", "doc_id", "n_shingles", own.alias("class"))
    classes = saved(narrow.groupBy("class").agg(F.min("row").alias("node"), F.count("*").alias("many")), "classes")
    member = saved(salted_join(narrow, classes, "class", "many").drop("class", "many"), "members", [classes])
    heads = base.join(member.where("row = node").select("row"), "row", "left_semi").where("n_shingles > 0")
    heads = heads.select(F.col("row").alias("node"), "doc_id", "class1", "class2", F.col("n_shingles").alias("n"), "keys")

    def contents(nodes: DataFrame) -> DataFrame:
        wanted = heads.select("node", "doc_id", "class1").join(nodes, "node", "left_semi")
        near = prefilter(docs.select("doc_id", "text"), F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("k")), "k")
        small_batches(docs.sparkSession, 100)
        return full_sets(near, wanted, n)

    labels = link(heads, contents, Items(bands, rows), percent, once=True)
    placed = saved(member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed")
    first = saved(placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many")), "component-firsts")
    return salted_join(placed, first, "label", "many").select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents that are kept, with all columns: one doc_id of each group of near-duplicates. A null doc_id stays only as the sole member of its group."""
    found = near_duplicates(docs, percent)
    keep = found.where(F.col("kept") | F.col("component_id").isNull()).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["__id"]), "left_semi")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
