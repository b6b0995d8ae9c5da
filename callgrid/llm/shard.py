"""Sharding by histogram sort [native].

Rows are ordered by a key (hash of the text, doc_id, a row number), so copies of a text are neighbours.
Splitters between shards are found by counting: each round sums the exact bytes below candidate key
boundaries (key prefixes) over all partitions and refines only the prefixes in which a splitter still
lies, until every splitter is within tolerance. Then one exchange deals the rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, saved

#: Hex digits by which a round refines a boundary: a round returns at most 4096 sums per open splitter.
STEP = 3
#: Characters of a key: 16 hex digits each of text hash, doc_id and row number.
KEY = 48


def _hex16(c: Column) -> Column:
    return F.lpad(F.hex(c), 16, "0")


def splitters(keyed: DataFrame, targets: int, tolerance: float) -> tuple[list[str], int]:
    """Boundaries that cut the summed ``size`` of ``keyed`` (key, size) into ``targets`` near equal parts.

    A boundary is a key prefix: keys from it on lie right of it. Each boundary is within ``tolerance``
    (a share of a part) of its exact place, or as near as whole rows allow. The sums that reach the
    driver number at most (targets - 1) * 4096 a round, whatever the input.
    """
    total, found = None, {}
    open_: dict[str, list[int]] = {"": list(range(1, targets))}
    base = {"": 0}
    length = 0
    while open_ and length < KEY:
        prefix, length = length, length + STEP
        part = keyed if not prefix else keyed.where(F.substring("key", 1, prefix).isin(list(open_)))
        sums = sorted((r[0], r[1]) for r in part.groupBy(F.substring("key", 1, length).alias("p")).agg(F.sum("size").alias("s")).collect())
        if total is None:
            total = sum(s for _, s in sums)
        if not total:
            break
        inside: dict[str, list[tuple[str, int]]] = {}
        for p, s in sums:
            inside.setdefault(p[:prefix], []).append((p, s))
        still: dict[str, list[int]] = {}
        below: dict[str, int] = {}
        for top, js in open_.items():
            names = [p for p, _ in inside[top]]
            starts, at = [], base[top]
            for _, s in inside[top]:
                starts.append(at)
                at += s
            for j in js:
                want = total * j / targets
                i = max(0, bisect_right(starts, want) - 1)
                low, high = starts[i], starts[i + 1] if i + 1 < len(starts) else at
                if want - low <= tolerance * total / targets or length >= KEY and want - low <= high - want:
                    found[j] = names[i]
                elif high - want <= tolerance * total / targets or length >= KEY:
                    found[j] = names[i + 1] if i + 1 < len(names) else names[i] + "~"
                else:
                    still.setdefault(names[i], []).append(j)
                    below[names[i]] = low
        open_, base = still, below
    return [found[j] for j in sorted(found)], total or 0


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.001, rows_a_part: int = 250_000) -> DataFrame:
    """Deal documents to ``shards`` shards whose bytes are near equal (law ``bytes``).

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (always null under this law).
    Null text has size 8 and crc 0; null or repeated doc_ids and repeated rows are rows like others, told
    apart by a row number; an empty table gives no rows; other columns are ignored. Each shard is dealt in
    one or more key ranges ("parts"), so slots are numbered in parallel: a slot is its row's number within
    the part plus the rows of the shard's earlier parts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = saved(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.concat(
                _hex16(F.xxhash64(text)),
                F.coalesce(_hex16(F.col("doc_id").cast("long")), F.lit("Z" * 16)),
                _hex16(F.monotonically_increasing_id()),
            ).alias("key"),
        ),
        "shard-keys",
    )
    parts = min(16, max(1, -(-keyed.count() // (shards * rows_a_part))))
    coarse, _ = splitters(keyed.select("key", "size"), shards, tolerance)
    fine = splitters(keyed.select("key", "size"), shards * parts, 0.25)[0] if parts > 1 else []
    cuts = sorted({*coarse, *fine})
    below = lambda marks: F.size(F.filter(F.array(*map(F.lit, marks)), lambda s: s <= F.col("key"))) if marks else F.lit(0)
    placed = keyed.select("doc_id", "size", "text_crc32", "key", below(coarse).cast("int").alias("shard"), below(cuts).alias("part"))
    counts = {(r["shard"], r["part"]): r["n"] for r in placed.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()}
    first, seen = [0] * (len(cuts) + 1), {}
    for (s, p), n in sorted(counts.items()):
        first[p] = seen.get(s, 0)
        seen[s] = first[p] + n
    at = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    offset = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("part") + 1)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (at + offset).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
