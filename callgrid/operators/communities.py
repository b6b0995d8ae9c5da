"""Communities by modularity: nodes move to the neighbour community that gains most, then communities become nodes, level by level.

All moves of a round are made at once, so each is taken only if it gains even after those that rank before it at its old and
its new community. Gains are whole numbers (modularity times 2 m * m), so the result does not depend on the order of rows, and
modularity rises in each round; the loops end when no move gains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved


def _whole(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _proposals(edges: DataFrame, place: DataFrame, total: int) -> DataFrame:
    """node, label, to, k (the node's degree) and gain: the best move of each node that gains anything.

    edges: src, dst, weight in both directions, loops once with twice their weight. place: node, label, k. total: 2 m, the sum of all weights.
    """
    of = place.groupBy("label").agg(F.sum("k").alias("all"))
    near = edges.where("src <> dst").join(place.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("weight").alias("w"))
    each = near.join(of, "label").select(F.col("src").alias("node"), F.col("label").alias("to"), "w", F.col("all").alias("all_to"))
    mine = each.join(place, "node")
    stay = mine.where("to = label").select("node", F.col("w").alias("w_own"))
    mine = mine.where("to <> label").join(stay, "node", "left").join(of.select("label", F.col("all").alias("all_own")), "label")
    gain = 2 * (_whole(F.lit(total)) * (F.col("w") - F.coalesce("w_own", F.lit(0)))) / 2 - _whole(F.col("k")) * (F.col("all_to") - F.col("all_own") + F.col("k"))
    mine = mine.withColumn("gain", gain.cast("decimal(38,0)")).where("gain > 0")
    best = mine.groupBy("node", "label", "k").agg(F.min_by(F.struct("to", "gain"), F.struct(-F.col("gain"), F.col("to"))).alias("b"))
    return best.select("node", "label", "k", "b.to", "b.gain")


def _taken(moves: DataFrame, number: int) -> DataFrame:
    """The moves of a round: a community either gives or takes, by a hash that changes with the round, and a move counts what ranks before it at both."""
    gives = lambda c: F.pmod(F.xxhash64(F.lit(number), F.col(c)), F.lit(2)) == 0
    first = [F.desc("gain"), F.asc("node")]
    before = lambda c: F.sum("k").over(Window.partitionBy(c).orderBy(*first).rowsBetween(Window.unboundedPreceding, -1))
    some = moves.where(gives("label") & ~gives("to"))
    some = some.withColumn("crowd", F.coalesce(before("label"), F.lit(0)) + F.coalesce(before("to"), F.lit(0)))
    return some.where(F.col("gain") > _whole(F.col("k")) * 2 * F.col("crowd"))


def _alone(moves: DataFrame) -> DataFrame:
    """The moves that are the best of both their communities: they touch no community twice."""
    rank = F.struct(-F.col("gain"), F.col("node"))
    ends = moves.select(F.col("label").alias("c"), "node", rank.alias("r")).union(moves.select("to", "node", rank)).groupBy("c").agg(F.min_by("node", "r").alias("best"))
    at = lambda c, name: ends.select(F.col("c").alias(c), F.col("best").alias(name))
    return moves.join(at("label", "b1"), "label").join(at("to", "b2"), "to").where("b1 = node AND b2 = node")


def _moved(edges: DataFrame, nodes: DataFrame, total: int) -> tuple[DataFrame, bool]:
    """node and label after all moves that gain, and whether there was one."""
    place, number, some = saved(nodes.select("node", F.col("node").alias("label"), "k"), "places"), 0, False
    while True:
        moves = saved(_proposals(edges, place, total), "moves")
        if not moves.head(1):
            return place.select("node", "label"), some
        taken = saved(_taken(moves, number).select("node", F.col("to").alias("new")), "taken")
        if not taken.head(1):
            taken = saved(_alone(moves).select("node", F.col("to").alias("new")), "taken")
        place = saved(place.join(taken, "node", "left").select("node", F.coalesce("new", "label").alias("label"), "k"), "places")
        number, some = number + 1, True


def communities(e: DataFrame) -> DataFrame:
    """node and label, the least node of its community, of the undirected edges ``e`` (src, dst, weight, whole numbers).

    Nodes of one edge go with their neighbour from the start, where they are best in any partition.
    """
    from .graph import both_ways

    edges = saved(both_ways(e).withColumn("weight", F.col("weight").cast("long")), "community-edges")
    total = edges.agg(F.sum("weight")).first()[0]
    if total is None:
        return e.select(F.col("src").alias("node"), F.col("src").alias("label"))
    whole = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("near"))
    leaf = whole.where("n = 1").select(F.col("src").alias("node"), "near")
    # two leaves that have only each other: the lesser takes both in
    hold = leaf.join(leaf.select(F.col("node").alias("near"), F.lit(True).alias("both")), "near", "left")
    label = whole.select(F.col("src").alias("node")).join(hold, "node", "left").select("node", F.when(F.col("near").isNull(), F.col("node")).when(F.col("both"), F.least("node", "near")).otherwise(F.col("near")).alias("label"))
    label = saved(label, "communities")
    while True:
        one = edges.join(label.select(F.col("node").alias("src"), F.col("label").alias("s")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("d")), "dst")
        small = saved(one.groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight")), "contracted")
        nodes = saved(small.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "contracted-nodes")
        found, some = _moved(small, nodes, total)
        if not some:
            break
        label = saved(label.join(found.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label")), "communities")
    least = label.groupBy("label").agg(F.min("node").alias("least"))
    return label.join(least, "label").select("node", F.col("least").alias("label"))
