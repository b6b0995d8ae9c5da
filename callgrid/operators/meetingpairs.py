"""How many two subjects ever met, without a row for each meeting: pairs are bits, and the rows travel instead of the pairs.

Subjects fall into groups. Each two groups are a task, which gets the rows of both in order of place and time, walks the window over them
and sets a bit for each two subjects that meet. So what is written grows with the rows times the groups, not with the meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved

#: Subjects of a group (a task's bits take 113 MB), least number of groups, and meetings that a task looks at at once.
GROUP, GROUPS, AT_ONCE = 30_000, 4, 1_000_000


def distinct_pairs(rows: DataFrame, keys: list[str], micros: int) -> DataFrame:
    """One row, pairs: how many two subjects have rows with equal ``keys`` and times (``us``, microseconds) at most ``micros`` apart; ``rows`` has keys, subject and us, none null."""
    subjects = saved(rows.select("subject").distinct(), "subjects")
    groups = max(GROUPS, -(-subjects.count() // GROUP))
    grouped = subjects.withColumn("g", F.pmod(F.xxhash64("subject"), F.lit(groups)).cast("int"))
    slots = saved(grouped.withColumn("slot", F.row_number().over(Window.partitionBy("g").orderBy("subject")) - 1), "slots")
    width = (slots.agg(F.max("slot")).first()[0] or 0) + 1
    places = saved(rows.select(*keys).distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    filed = rows.join(places, keys).join(slots, "subject").select("place", "us", "g", "slot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"))
    filed = filed.select((F.least("g", "h") * groups + F.greatest("g", "h")).alias("task"), "place", "us", "g", "slot")
    filed = filed.repartition(min(2000, groups * (groups + 1) // 2), "task").sortWithinPartitions("task", "place", "us")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bits, kept = None, None, None
        found = 0
        for batch in batches:
            columns = np.stack([c.to_numpy() for c in batch.columns]).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(columns[0])) + 1), columns.shape[1]]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                part = columns[:, low:high]
                if part[0, 0] != task:
                    found += 0 if bits is None else int(np.bitwise_count(bits).sum(dtype=np.int64))
                    task, bits, kept = part[0, 0], np.zeros((width * width + 7) // 8, np.uint8), part[1:, :0]
                kept = _meet(kept, part[1:], micros, width, bits, task // groups != task % groups)
        found += 0 if bits is None else int(np.bitwise_count(bits).sum(dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["pairs"])

    return filed.mapInArrow(run, "pairs long").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def _meet(kept: np.ndarray, new: np.ndarray, micros: int, width: int, bits: np.ndarray, mixed: bool) -> np.ndarray:
    """Sets the bits of those that meet among rows (place, us, group, slot) in order, of ``kept`` with ``new`` and within ``new``, ``mixed`` ones only between the groups; gives the rows that later ones may meet."""
    rows = np.concatenate([kept, new], axis=1)
    place, us, group, slot = rows
    # gaps beyond the window may be any, so that times go on from place to place
    gap = np.where(np.diff(place) == 0, np.minimum(np.diff(us), micros + 1), micros + 1)
    at = np.concatenate([[0], np.cumsum(gap)])
    low = np.maximum(np.arange(len(at)) + 1, kept.shape[1])
    high = np.searchsorted(at, at + micros, side="right")
    many = np.maximum(high - low, 0)
    ends, first = np.cumsum(many), 0
    while first < len(at):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
        n = many[first:last]
        one = np.repeat(np.arange(first, last), n)
        two = np.arange(len(one)) + np.repeat(low[first:last] - np.cumsum(n) + n, n)
        x, y = slot[one], slot[two]
        if mixed:
            other = group[one] != group[two]
            turned = group[one] > group[two]
            x, y = np.where(turned, y, x), np.where(turned, x, y)
        else:
            x, y, other = np.minimum(x, y), np.maximum(x, y), x != y
        bit = (x * width + y)[other]
        for k in range(8):
            bits[bit[(bit & 7) == k] >> 3] |= np.uint8(1 << k)
        first = last
    return rows[:, at >= at[-1] - micros]
