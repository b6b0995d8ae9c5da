"""Byte-level BPE by segment trees.

A piece of text is a row of symbols. The leaf over position i of the row's segment tree holds the rank of the pair
that starts there, with the position in its low bits, so the root is the leftmost pair of least rank. A
merge rewrites one symbol and updates three leaves (the merged pair's, its right half's and its left
neighbour's), each in as many steps as the tree is high. The trees of all pieces of like length stand in
one array and take their steps together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches

NO_PAIR = np.int64(1) << 62
#: Cells (pieces times tree leaves) that are worked on at once.
CELLS = 1 << 19
#: Entries kept in a task's cache of encoded strings, and the longest string kept.
CACHE, LONGEST = 500_000, 48


class Merges:
    """Pairs of symbol ids with their rank and the id they merge to."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, size: int):
        key = left.astype(np.int64) * size + right
        order = np.argsort(key, kind="stable")
        self.size, self.rank, self.merged = size, rank[order].astype(np.int64), merged[order].astype(np.int64)
        bits = max(4, int(len(key) * 2 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        #: An open hash table: where a pair's entry is, found by a few probes.
        self.key = np.full(1 << bits, -1, np.int64)
        self.entry = np.zeros(1 << bits, np.int64)
        left_over, at = np.arange(len(key)), self._slot(key[order])
        while len(left_over):
            free = self.key[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            chosen = left_over[free][first]
            self.key[slots], self.entry[slots] = key[order][chosen], chosen
            keep = ~np.isin(left_over, chosen)
            left_over, at = left_over[keep], (at[keep] + 1) & self.mask
        del left_over

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def entries(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of each pair, or -1. Symbols under 0 stand for the ends of a piece."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left * self.size + right)
        at = self._slot(key)
        out = np.where(self.key[at] == key, self.entry[at], -1)
        more = np.flatnonzero((self.key[at] != key) & (self.key[at] >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            seen = self.key[at[more]]
            hit = seen == key[more]
            out[more[hit]] = self.entry[at[more[hit]]]
            more = more[~hit & (seen >= 0)]
        return out

    def encode(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids after all merges of pieces that lie end to end in ``symbols``, and how many each piece has."""
        starts = np.cumsum(sizes) - sizes
        counts = np.minimum(sizes, 1)
        leaves = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = [(single := np.flatnonzero(sizes == 1), symbols[starts[single]])]
        for width in np.unique(leaves[sizes > 1]):
            chosen = np.flatnonzero((leaves == width) & (sizes > 1))
            step = max(1, CELLS // int(width))
            for k in range(0, len(chosen), step):
                part = chosen[k : k + step]
                ids, counts[part] = self._rows(symbols, starts[part], sizes[part], int(width))
                made.append((part, ids))
        out = np.empty(int(counts.sum()), np.int64)
        ends = np.cumsum(counts)
        for part, ids in made:
            n = counts[part]
            out[np.repeat(ends[part] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _rows(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(sizes)
        place = np.arange(width)
        filled = place < sizes[:, None]
        # two columns more than positions: the end marks right and left of a piece
        ids = np.full((n, width + 2), -1, np.int64)
        ids[:, :width][filled] = symbols[(starts[:, None] + place)[filled]]
        after = np.tile(np.arange(1, width + 3), (n, 1))
        after[np.arange(n), sizes - 1] = width
        before = np.tile(np.arange(-1, width + 1), (n, 1))
        before[:, 0] = width + 1
        tree = np.full((n, 2 * width), NO_PAIR, np.int64)
        follow = np.where(place + 1 < sizes[:, None], ids[:, 1 : width + 1], -1)
        found = self.entries(ids[:, :width].ravel(), follow.ravel())
        tree[:, width:] = np.where(found >= 0, self.rank[found] * width + np.tile(place, n), NO_PAIR).reshape(n, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        flat_tree, flat_ids, flat_after, flat_before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        live = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(live):
            base, row = live * 2 * width, live * (width + 2)
            at = flat_tree[base + 1] % width
            gone = flat_after[row + at]
            new = self.merged[self.entries(flat_ids[row + at], flat_ids[row + gone])]
            right, left = flat_after[row + gone], flat_before[row + at]
            flat_ids[row + at], flat_ids[row + gone] = new, -1
            flat_after[row + at], flat_before[row + right] = right, at
            pair = self.entries(np.concatenate([new, flat_ids[row + left]]), np.concatenate([flat_ids[row + right], new]))
            rank = np.where(pair >= 0, self.rank[pair] * width + np.concatenate([at, left]), NO_PAIR)
            node = width + np.concatenate([gone, at, np.where(left < width, left, gone)])
            bases = np.concatenate([base, base, base])
            flat_tree[bases + node] = np.concatenate([np.full(len(live), NO_PAIR), rank[: len(live)], np.where(left < width, rank[len(live) :], NO_PAIR)])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                child = bases + 2 * node
                flat_tree[bases + node] = np.minimum(flat_tree[child], flat_tree[child + 1])
            live = live[flat_tree[base + 1] < NO_PAIR]
        mask = filled & (ids[:, :width] >= 0)
        return ids[:, :width][mask], mask.sum(axis=1)


def spans(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each piece's ids as little-endian unsigned 32-bit integers."""
    raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
    return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class Cache(dict):
    """String -> bytes, bounded: a full cache takes no more, and is emptied when it no longer serves."""

    def __init__(self, most: int = CACHE):
        super().__init__()
        self.most = most

    @contextmanager
    def holding(self, fresh: dict[str, bytes], asked: int) -> Iterator[Cache]:
        """The cache with ``fresh`` added; afterwards only what there is room for stays."""
        room = len(self) < self.most
        self.update(fresh)
        yield self
        if not room and len(fresh) > 0.3 * asked:
            self.clear()
            return
        for key in fresh:
            if not room or len(key) > LONGEST:
                self.pop(key, None)


#: A run of white space with what follows it up to the next: pieces of the pattern never go over these bounds.
CHUNK = regex.compile(r"\p{White_Space}*+\P{White_Space}++|\p{White_Space}++")
ASCII_CHUNK = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
PUNCTUATION = frozenset(".,;:!?")


class ByteBpe:
    """Encodes and decodes by a file of ranks; ``pattern`` cuts texts into the pieces in which bytes merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, np.int64).T
        self.merges = Merges(left, right, rank, rank, size)
        self.cache = Cache()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        raw = [p.encode() for p in pieces]
        whole = [self.ranks.get(r) for r in raw]
        todo = [r for r, w in zip(raw, whole, strict=True) if w is None]
        sizes = np.fromiter(map(len, todo), np.int64, len(todo))
        made = iter(spans(*self.merges.encode(self.byte[np.frombuffer(b"".join(todo), np.uint8)], sizes)))
        return [next(made) if w is None else w.to_bytes(4, "little") for w in whole]

    def cut(self, chunk: str) -> list[str]:
        """The pieces of a chunk; the commonest shapes need no pattern."""
        if chunk.isascii():
            word = chunk[1:] if chunk[:1] == " " else chunk
            if word.isalpha():
                return [chunk]
            if word[-1:] in PUNCTUATION and word[:-1].isalpha():
                return [chunk[:-1], word[-1]]
        return self.pattern.findall(chunk)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split = [(ASCII_CHUNK if t.isascii() else CHUNK).findall(t) for t in texts]
        new = list(set().union(*split).difference(self.cache))
        cut = [self.cut(c) for c in new]
        pieces = list(set().union(*cut))
        ids = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        fresh = {c: ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts]) for c, parts in zip(new, cut, strict=True)}
        with self.cache.holding(fresh, sum(map(len, split))) as known:
            find = known.__getitem__
            return [b"".join(map(find, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) to doc_id and the text's own column.

    Null counts as the empty text, which has no ids; other columns are ignored, repeated rows stay. A run of
    any length without white space is encoded whole. ``path`` is a vocabulary file that each executor has.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``bytes``, the concatenated tokens of ``ids``; null ids count as none."""
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or b"") for i in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty and has no ids; texts may be of any length; repeated rows give a row each; an empty
    table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for b in batches:
            ids = bpe.encode_batch([t or "" for t in b.column(1).to_pylist()])
            cols = [[len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
