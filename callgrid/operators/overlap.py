"""The pairs of owners that share most members, without the square of a member that many own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import top_per
from ..sources.scratch import saved

#: Members with at most LIGHT owners, and the LARGEST owners, give the first pairs; they only set a bound for the search.
LIGHT, LARGEST = 32, 64


def shared_members(pairs: DataFrame, sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b, da, db, shared: the members that both have, looked up from the smaller of the two sets."""
    p = pairs.join(sizes.select(F.col("s").alias("a"), F.col("d").alias("da")), "a").join(sizes.select(F.col("s").alias("b"), F.col("d").alias("db")), "b")
    first = F.col("da") <= F.col("db")
    p = p.withColumns({"s": F.when(first, F.col("a")).otherwise(F.col("b")), "far": F.when(first, F.col("b")).otherwise(F.col("a"))})
    hits = p.join(sets, "s").join(sets.select(F.col("s").alias("far"), "c"), ["far", "c"])
    return hits.groupBy("a", "b", "da", "db").agg(F.count("*").alias("shared"))


def _paired(rows: DataFrame) -> DataFrame:
    """a < b for each two owners of a member (s, c)."""
    return rows.select(F.col("s").alias("a"), "c").join(rows.select(F.col("s").alias("b"), "c"), "c").where("a < b").select("a", "b")


def first_of_like(sets: DataFrame, n: int, barred: DataFrame | None = None) -> DataFrame:
    """The rows of the first n + 1 owners of each set: the ``n`` best pairs are among these.

    If one of a pair is not, n owners before it with the same set, without the other, give better pairs. Owners are also
    told apart by those that they are barred with, so that this holds for what is not barred. A set is known by its size and two hashes of 64 bits.
    """
    known = lambda df, key, c, k: df.groupBy(key).agg(F.count("*").alias(f"n{k}"), F.bit_xor(F.xxhash64(c)).alias(f"x{k}"), F.bit_xor(F.xxhash64(c, F.lit(1))).alias(f"y{k}"))
    owners, keys = known(sets, "s", "c", 1), ["n1", "x1", "y1"]
    if barred is not None:
        ends = barred.where("a <> b").select(F.col("a").alias("s"), F.col("b").alias("c"))
        owners = owners.join(known(ends.union(ends.select(F.col("c").alias("s"), F.col("s").alias("c"))).distinct(), "s", "c", 2), "s", "left")
        keys += ["n2", "x2", "y2"]
    return sets.join(top_per(owners, keys, [F.col("s")], n + 1).select("s"), "s", "left_semi")


def top_overlaps(sets: DataFrame, n: int, least: int = 2, barred: DataFrame | None = None) -> DataFrame:
    """The ``n`` pairs (a < b) of owners with most members in common, at least ``least``, then by Jaccard similarity, a, b.

    ``sets`` has distinct rows (s, c): owner and member; pairs of ``barred`` (a, b) do not count. Exact. Some pairs
    counted first give a bound t: the n-th best pair shares at least t members. Two sets with t members in common
    meet among their members without the t - 1 commonest of each, so only those are paired: owners with fewer than t
    members that anyone else has drop out, and the members that most own are the first to go. Of owners of one set
    the first n + 1 are enough, so a set that many have is no square either.
    """
    free = (lambda p: p.join(barred, ["a", "b"], "left_anti")) if barred is not None else (lambda p: p)
    sets = saved(first_of_like(sets, n, barred), "overlap-first")
    sets = saved(sets.join(sets.groupBy("c").agg(F.count("*").alias("f")), "c"), "overlap-sets")
    sizes = saved(sets.groupBy("s").agg(F.count("*").alias("d"), F.count_if(F.col("f") > 1).alias("d2")), "overlap-sizes")
    common = sets.where("f > 1")
    light = free(_paired(common.where(F.col("f") <= LIGHT)).groupBy("a", "b").agg(F.count("*").alias("x"))).orderBy(F.desc("x"), "a", "b").limit(n).select("a", "b")
    largest = common.join(sizes.where("d2 > 1").orderBy(F.desc("d2"), "s").limit(LARGEST).select("s"), "s", "left_semi")
    known = shared_members(light.union(free(_paired(largest).distinct())).distinct(), common.select("s", "c"), sizes)
    found = [r["shared"] for r in known.orderBy(F.desc("shared")).limit(n).select("shared").collect()]
    bound = max(least, found[-1]) if len(found) == n else least

    left = common.join(sizes.where(F.col("d2") >= bound).select("s"), "s", "left_semi")
    if bound > 1:
        left = left.join(top_per(left, ["s"], [F.desc("f"), F.desc("c")], bound - 1).select("s", "c"), ["s", "c"], "left_anti")
    pairs = saved(free(_paired(left).distinct()), "overlap-pairs")
    out = shared_members(pairs, common.select("s", "c"), sizes).where(F.col("shared") >= bound)
    out = out.select("a", "b", "shared", F.round(F.col("shared") / (F.col("da") + F.col("db") - F.col("shared")), 6).alias("jaccard"))
    return out.orderBy(F.desc("shared"), F.desc("jaccard"), "a", "b").limit(n)


def sharing_twice(sets: DataFrame, few: int = 32) -> DataFrame:
    """s: at least one owner of each two that share two members or more; of ``sets`` with distinct rows (s, c).

    An owner of up to ``few`` members is filed under each two of them, so the square is that of its own set; only
    owners of more members meet all owners of theirs.
    """
    sizes = sets.groupBy("s").agg(F.count("*").alias("d")).where("d > 1")
    sized = saved(sets.join(sizes, "s"), "sharing")
    small = sized.where(F.col("d") <= few)
    twos = small.select("s", F.col("c").alias("c1")).join(small.select("s", F.col("c").alias("c2")), "s").where("c1 < c2")
    one = twos.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("s").alias("s")).where("n > 1").select("s")
    big = sized.where(F.col("d") > few).select(F.col("s").alias("a"), "c").join(sized.select(F.col("s").alias("b"), "c"), "c").where("a <> b")
    return one.union(big.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a")).distinct()
