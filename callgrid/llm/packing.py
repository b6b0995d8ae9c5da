"""Packing documents into windows of tokens by minimum bin slack.

A document's ids are cut into whole windows and one remainder. How many remainders there are of each
length is all that the plan needs: at most one count for each length, whatever the corpus. For the longest
remaining length, a subset-sum over a bitset finds the multiset of remaining lengths that fills the window
closest to its capacity; it is backtracked to counts and used as often as the stock allows. Spark then
numbers the pieces of each length and looks their places up in the plan.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PUNCTUATION, Cache
from .common import read, saved, small_batches
from .shingles import blocks, word_spans

WINDOW, END = 4096, 2
#: The pre-tokenizer of the vocabulary file (a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts without any other characters than these may be cut at white space (here: the bytes 9 to 13 and 32) and lower-cased by str.lower()
#: before they reach the tokenizer, as no normalisation crosses white space there; all others, and those that may hold
#: a special token's string, go to it whole.
ODD = re.compile("[^\t-\r\x20-\x7e\xa1-įı-ɏ‐-‧€]")
#: Words, and pieces of words, whose ids a task keeps; bytes of text that it works on at once.
MOST_WORDS, MOST_PARTS, AT_ONCE = 900_000, 250_000, 1 << 19


class WordTable:
    """Hash of a word -> its ids, in flat arrays: an open hash table over the ends of each word's run of ids."""

    def __init__(self, most: int = MOST_WORDS):
        self.most, self.mask = most, (1 << (2 * most - 1).bit_length()) - 1
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.mask + 1, np.uint64)
        self.word = np.full(self.mask + 1, -1, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        while len(open_):
            word = self.word[at]
            hit = (word >= 0) & (self.key[at] == hashes[open_])
            out[open_[hit]] = word[hit]
            more = ~hit & (word >= 0)
            open_, at = open_[more], (at[more] + 1) & self.mask
        return out

    def room(self, n: int) -> bool:
        return len(self.ends) - 1 + n <= self.most

    def add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        """New words, their ids as 16-bit integers."""
        number = np.arange(len(hashes), dtype=np.int32) + np.int32(len(self.ends) - 1)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 2)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.uint16)])
        at, open_ = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(hashes))
        while len(open_):
            free = np.flatnonzero(self.word[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            chosen = open_[free[first]]
            self.key[slots], self.word[slots] = hashes[chosen], number[chosen]
            left = np.ones(len(open_), bool)
            left[free[first]] = False
            open_, at = open_[left], (at[left] + 1) & self.mask


class WordTokenizer:
    """Ids of texts by a ``tokenizers`` file; the words of plain texts are tokenized once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.rest, self.parts = WordTable(), WordTable(MOST_WORDS // 4), Cache(MOST_PARTS)

    def whole(self, texts: list[str], kind: str) -> list[bytes]:
        return [array(kind, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def cut(word: str) -> list[str]:
        """The tokenizer's pieces of a word of a plain text; the commonest shapes need no pattern."""
        word = word.lower()
        if word.isalpha():
            return [word]
        if word[-1] in PUNCTUATION and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return PIECES.findall(word)

    def learn(self, words: list[str], asked: int) -> list[bytes]:
        """The ids of each word, as 16-bit integers; ``asked``: of how many words these are the unknown ones."""
        cut = [self.cut(w) for w in words]
        parts = self.parts
        new = [p for p in set().union(*cut) if p not in parts]  # set.difference() would walk the whole cache
        with self.parts.holding(dict(zip(new, self.whole(new, "H"), strict=True)) if new else {}, asked) as known:
            return [known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in cut]

    def plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of plain texts. Words go to a table that keeps the first that it met; once it is full, to a smaller one that is emptied now and then."""
        joined = b"\n".join(texts)
        h, starts, ends = word_spans(joined)
        main = self.words.find(h)
        odd = np.flatnonzero(main < 0)
        other = self.rest.find(h[odd])
        new, first = np.unique(h[odd[other < 0]], return_index=True)
        table, where = self.words, odd[other < 0][first]
        if not self.words.room(len(new)):
            table = self.rest
            if not table.room(len(new)):
                table.clear()
                new, first = np.unique(h[odd], return_index=True)
                where = odd[first]
                if not table.room(len(new)):
                    table = self.rest = WordTable(2 * len(new))
        if len(new):
            table.add(new, self.learn([joined[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], len(h)))
            main[odd] = self.words.find(h[odd])
            odd = odd[main[odd] < 0]
            other = self.rest.find(h[odd])
        low, high = self.words.ends[main], self.words.ends[main + 1]
        low[odd], high[odd] = self.rest.ends[other] + len(self.words.ids), self.rest.ends[other + 1] + len(self.words.ids)
        counts = high - low
        ids = np.concatenate([self.words.ids, self.rest.ids])[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))]
        edges = np.cumsum([len(t) + 1 for t in texts])
        last = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, edges)].tolist()
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *last[:-1]], last, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        easy = [ODD.search(t) is None and "<|" not in t for t in texts]
        raw = [t.encode() for t, e in zip(texts, easy, strict=True) if e]
        fast = iter([x for part in blocks([len(t) for t in raw], AT_ONCE) for x in self.plain(raw[part.start : part.stop])])
        odd = iter(self.whole([t for t, e in zip(texts, easy, strict=True) if not e], "I"))
        return [next(fast) if e else next(odd) for e in easy]


_LOADED: dict[str, WordTokenizer] = {}


def loaded(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker, whose tables serve all its tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: whole windows, then the remainder."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(tokenizer.encode([t or "" for t in b.column(1).to_pylist()])):
                ids += end.to_bytes(4, "little")
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for c, v in zip(rows, (i, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def fullest(stock: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Counts by length, from ``stock`` (length, count), whose sum comes closest to ``room`` from below."""
    bits, goal, steps = 1, 1 << room, []
    mask = (1 << room + 1) - 1
    for length, count in stock:
        if length > room:
            continue
        left, many = min(count, room // length), 1
        while left:
            take = min(many, left)
            steps.append((length, take, bits))
            bits |= bits << length * take & mask
            left, many = left - take, many * 2
        if bits & goal:
            break
    at, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: (length, from_rank, to_rank, in_each, first_sequence, first_offset).

    The pieces of a length whose ranks lie in [from_rank, to_rank) go ``in_each`` to a sequence, from
    ``first_sequence`` and, in each, ``first_offset`` on. Its size depends on the window, not on the counts.
    """
    left, given, out, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    lengths = sorted(left, reverse=True)
    while lengths:
        top = lengths[0]
        used = fullest([(x, left[x] - (x == top)) for x in lengths if left[x] > (x == top)], window - top)
        used[top] = used.get(top, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            out.append((x, given[x], given[x] + n * times, n, sequence, offset))
            given[x] += n * times
            left[x] -= n * times
            offset += n * x
        sequence += times
        lengths = [x for x in lengths if left[x]]
    return out


def place(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...), a table that reads the same each time.

    Pieces of one length are numbered in as many groups as their count asks for, so a length that a third
    of the pieces share is spread over tasks. What reaches the driver are counts by length (at most
    ``window``) and by length and group (at most window + 1024).
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    target = max(200, sum(counts.values()) // 1024)
    groups = spark.createDataFrame([(x, 1 + n // target) for x, n in counts.items()], "length long, groups long")
    cut = cut.join(F.broadcast(groups), "length").withColumn("group", F.expr("pmod(xxhash64(doc_id, start), groups)")).drop("groups")
    first, seen = [], {}
    for r in sorted(cut.groupBy("length", "group").agg(F.count("*").alias("n")).collect()):
        first.append((r["length"], r["group"], seen.get(r["length"], 0)))
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    firsts = spark.createDataFrame(first, "length long, group long, first long")
    where = spark.createDataFrame(plan(counts, window), "length long, from_rank long, to_rank long, in_each long, first_sequence long, first_offset long")
    at = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "start")) - 1
    ranked = cut.withColumn("at", at).join(F.broadcast(firsts), ["length", "group"]).withColumn("rank", F.col("first") + F.col("at")).drop("at", "first", "group")
    hit = (ranked["length"] == where["length"]) & (ranked["rank"] >= where["from_rank"]) & (ranked["rank"] < where["to_rank"])
    return ranked.join(F.broadcast(where), hit).select(
        "doc_id", "start", ranked["length"], "ids_crc32", "doc_tokens",
        F.expr("first_sequence + (rank - from_rank) div in_each").alias("sequence_id"),
        (F.col("first_offset") + F.expr("(rank - from_rank) % in_each") * ranked["length"]).alias("offset"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty and has one id, the end mark, as the empty text has; an empty table gives no
    rows; repeated rows are packed each; other columns are ignored. Longer documents than the window fill
    whole windows of their own; all windows are full but those that the last remainders could not fill.
    """
    return place(saved(pieces(docs, path, window), "pieces"), window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
