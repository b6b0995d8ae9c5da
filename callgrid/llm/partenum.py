"""N-gram Jaccard join by PartEnum signatures: exact, no link is missed.

Two sets whose similarity is ``percent`` or more differ in few members for their size. The domain of members (64-bit
hashes) is cut into parts, so many that some part of two such sets differs in one member at most; a part is cut into
three again, and each two of the three make a signature: one that holds the differing member is left out by one of them.
So two similar sets share a signature. Sizes go by bands, each with its number of parts; a set signs for its own band and
for those that its larger partners can be in.

Parts with few members would make signatures that all sets share, so they do not count: a set vouches for its links if
enough of its parts hold FULL members, and it signs only as many parts as that takes. A part whose members all lie in
one of the three is signed by its members less one each, not by the other two, which are empty. Sets that can't vouch (small ones mostly) sign
all their parts and, for links among themselves, single members: those of a prefix in the order of the hashes.

Candidates are a star for each signature. Before sets are fetched, bits of parity drop pairs: each differing member changes one bit at most,
so two sets differ in at least as many members as bits. What stars leave open is compared inside signatures, see ``linking``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, salted_join, saved, small_batches
from .linking import Items, linked, prefilter
from .shingles import mix, shingle_set, word_hashes

WORDS, PERCENT = 5, 80
#: Members of a part that make it count; members of a part on average at a band's top size; how much a band is wider than the last.
FULL, AVERAGE, WIDTH = 3, 8, 1.5
#: 64-bit words of a set's parity bits, by its size: up to so many members, so many words; sets beyond have the last number.
PARITY = [(400, 8), (3200, 64), (25_600, 512)]
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Band:
    """Sets of up to ``top`` members, from ``low`` on, with their links of ``percent``."""

    def __init__(self, number: int, low: int, top: int, percent: int):
        self.number, self.low, self.top = number, low, top
        sizes = np.arange(low, top + 1)
        #: two sets of a link differ in at most so many members, by the size of the smaller
        self.apart = sizes * (100 - percent) // percent
        #: parts that must hold FULL members, as more than two differing members in each would be too many
        self.need = self.apart // 2 + 1
        self.parts = max(int(self.need[-1]), ceil(top / AVERAGE))
        self.edges = np.array([(i << 64) // self.parts for i in range(self.parts)], np.uint64)
        mean = sizes / self.parts
        full = 1 - np.exp(-mean) * (1 + mean + mean * mean / 2)
        # so many parts that the needed ones are full with a probability of about 0.98; never fewer for a larger set
        signed = (self.need + 2 * np.sqrt(self.need * np.maximum(1 - full, 0)) + 1) / np.maximum(full, 1e-9)
        self.signed = np.maximum.accumulate(np.minimum(np.ceil(signed), self.parts).astype(np.int64))
        salts = np.arange(self.parts * 3, dtype=np.uint64).reshape(-1, 3) + (np.uint64(number + 1) << np.uint64(40))
        self.salts = mix(salts * _GOLDEN)


@lru_cache(None)
def band(number: int, percent: int) -> Band:
    low, top = 1, 4
    for _ in range(number):
        low, top = top + 1, int(top * WIDTH)
    return Band(number, max(1, low * percent // 100), top, percent)


def bands_of(n: int, percent: int) -> list[Band]:
    """The bands for whose links a set of ``n`` members signs: its own and those of its larger partners."""
    most, number, out, below = n * 100 // percent, 0, [], 0
    while below < most:
        b = band(number, percent)
        if b.top >= n:
            out.append(b)
        below, number = b.top, number + 1
    return out


def thirds(members: np.ndarray) -> np.ndarray:
    return ((members & np.uint64(0xFFFFFFFF)) * np.uint64(3) >> np.uint64(32)).astype(np.int64)


def signatures(members: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set (sorted distinct 64-bit hashes)."""
    n = len(members)
    if n * (100 - percent) // percent == 0:  # only an equal set could be linked, which is the same node
        return np.zeros(0, np.uint64)
    third = thirds(members)
    inside = third[:, None] == np.arange(3)
    counts = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(inside, axis=0)])
    sums = np.concatenate([np.zeros((1, 3), np.uint64), np.cumsum(np.where(inside, members[:, None], np.uint64(0)), axis=0, dtype=np.uint64)])
    out, weak = [], False
    for b in bands_of(n, percent):
        at = np.append(np.searchsorted(members, b.edges), n)
        held, total = np.diff(counts[at], axis=0), np.diff(sums[at], axis=0)
        many, signed = held.sum(axis=1), int(b.signed[n - b.low])
        if (many[:signed] >= FULL).sum() < b.need[n - b.low]:
            weak, signed = True, b.parts
        held, total, many = held[:signed], total[:signed], many[:signed]
        others = many[:, None] - held
        good = (many >= 2)[:, None] & (others > 0)
        out.append(mix((total.sum(axis=1, dtype=np.uint64)[:, None] - total ^ b.salts[:signed])[good]))
        # all members in one third: less one each
        for i, v in zip(*np.nonzero((many >= 2)[:, None] & (others == 0)), strict=True):
            own = members[at[i] : at[i + 1]]
            out.append(mix(np.append(total[i, v] - own, total[i, v]) ^ ~b.salts[i, v]))
    if weak:
        out.append(mix(members[: n - -(-percent * n // 100) + 1] ^ _GOLDEN))
    return np.concatenate(out)


def parity(members: np.ndarray) -> np.ndarray:
    """Words of bits, each whether an odd number of members falls on it. Those of a larger set fold to those of a smaller."""
    bits = 64 * next((words for most, words in PARITY if len(members) <= most), PARITY[-1][1])
    places = np.bincount((mix(members) >> np.uint64(49)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(places.astype(np.uint8)).view(np.int64)


class SetItems(Items):
    """Contents are sorted arrays of hashes, sketches are bits of parity: pairs that these drop are surely not alike."""

    prunes = True

    def __init__(self):
        super().__init__(PARITY[0][1], 1)

    def sketches(self, keys: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each number of words, from few to many, the rows that have as many or more, folded to it; a place of -1 for the others."""
        lists = keys.combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        many, out = np.diff(ends), []
        for _, words in PARITY:
            matrix, place, rows = [], np.full(len(many), -1), 0
            for own in np.unique(many[many >= words]):
                some = np.flatnonzero(many == own)
                every = flat[ends[some][:, None] + np.arange(own)].reshape(len(some), own // words, words)
                matrix.append(np.bitwise_xor.reduce(every, axis=1))
                place[some] = np.arange(rows, rows + len(some))
                rows += len(some)
            out.append((place, np.concatenate(matrix) if matrix else np.zeros((0, words), np.int64)))
        return out

    def may_be(self, sketches: list, a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
        near = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
        for place, matrix in sketches:
            at = np.flatnonzero(near & (place[a] >= 0) & (place[b] >= 0))
            differ = np.bitwise_count((matrix[place[a[at]]] ^ matrix[place[b[at]]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near[at] = (100 + percent) * differ <= (100 - percent) * (m[at] + n[at])
        return near

    def first_shared(self, sketches: list, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.ones(len(key), bool)


def _set(text: str | None, words: int) -> np.ndarray:
    return shingle_set(word_hashes((text or "").encode().lower()), words)


def _node(members: np.ndarray) -> int:
    """A set's id: 64 bits of all its members. Two sets of N have one id with a probability of about N * N / 2 ** 65."""
    h = int(mix(members.sum(dtype=np.uint64, keepdims=True) ^ mix(np.array([len(members)], np.uint64)))[0])
    return h - (1 << 64) if h >> 63 else h


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (id of the set, null if it is empty) and keys (its parity)."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_set(text, words) for text in b.column(1).to_pylist()]
            bits = [parity(s) for s in sets]
            ends = np.cumsum([0] + [len(x) for x in bits])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *bits]))),
                ],
                names=["doc_id", "n_shingles", "node", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, keys array<long>")


def signed(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """key and node of all signatures of all documents; equal texts give equal rows."""
    small_batches(docs.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 50):
                nodes, keys = [], [np.zeros(0, np.uint64)]
                for text in set(b.column(0).slice(part, 50).to_pylist()):
                    s = _set(text, words)
                    found = signatures(s, percent)
                    if len(found):
                        nodes.append(_node(s))
                        keys.append(found)
                columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(nodes, np.int64), [len(k) for k in keys[1:]])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "node"])

    return docs.select("text").mapInArrow(run, "key long, node long")


def shared_signatures(entries: DataFrame) -> DataFrame:
    """key, node, top: the entries whose key several nodes have, top the least of these.

    Entries meet in one exchange and are read in order, so a task holds one row of a key, however many there are. A set
    has some hundred signatures, each in another task, so one that all sets share has a hundredth of all entries.
    """
    small_batches(entries.sparkSession, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the key at hand: the key, its top, and whether the top has been handed on
        for b in batches:
            if not b.num_rows:
                continue
            key, node = (b.column(i).to_numpy() for i in range(2))
            passed = last is not None and last[2]
            if last is not None:  # the top stands in front of its key's other rows
                key, node = np.append(last[0], key), np.append(last[1], node)
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node = key[fresh], node[fresh]
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            many = np.diff(np.append(starts, len(key)))
            keep = np.repeat(many > 1, many)
            keep[0] &= not passed
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, node, np.repeat(node[starts], many))], names=["key", "node", "top"])
            last = key[starts[-1]], node[starts[-1]], bool(many[-1] > 1) or (passed and len(starts) == 1)

    one = entries.repartition("key").sortWithinPartitions("key", "node")
    return one.mapInArrow(run, "key long, node long, top long")


def similar_sets(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of each document.

    Two documents are linked if ``percent`` of the union of their sets of ``words``-word shingles is common (words after lower-casing
    A-Z; a shorter text is one shingle). component_id is the least doc_id that links reach. Texts that are null, empty or blank have no
    shingles, no link and themselves as component. Rows that repeat a doc_id stay, each with the component of its own text; a null doc_id
    is a component_id only if the component has no other; an empty table gives no rows; other columns are ignored.
    """
    base = saved(described(docs, words), "sets")
    nodes = base.where("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    heads = saved(nodes, "set-nodes")
    shared = saved(shared_signatures(signed(docs, percent, words)), "shared-signatures", random=True)

    def contents(wanted: DataFrame) -> DataFrame:
        near = prefilter(base.where("node IS NOT NULL").select("doc_id", "node"), F.col("node"), wanted, "node")
        ids = near.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("none"))
        ids = saved(ids.select(F.explode(F.expr("IF(none, array(doc_id, NULL), array(doc_id))")).alias("doc_id")).distinct(), "wanted-documents")
        few = prefilter(docs.select("doc_id", "text"), F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("k")), "k")
        small_batches(docs.sparkSession, 100)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = [s for s in (_set(text, words) for text in b.column(0).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "content"])

        found = few.select("text").mapInArrow(run, "node long, content binary")
        return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])

    labels = linked(shared, heads, contents, SetItems(), percent, once=True)
    placed = base.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    # an empty set is alone: its row is its own component
    lone = placed.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    placed = saved(placed.where("node IS NOT NULL").select("doc_id", "n_shingles", F.coalesce("label", "node").alias("label")), "placed")
    first = saved(placed.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many")), "component-firsts")
    return salted_join(placed, first, "label", "many").select("doc_id", "n_shingles", "component_id").unionByName(lone)


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under links of 80 percent."""
    return similar_sets(read(spark, sf_dir, "documents"))
