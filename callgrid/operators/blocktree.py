"""Betweenness and closeness by blocks: searches stay inside the biconnected parts of a graph.

A graph whose classes of like nodes (``searches``) need few steps is searched as a whole, which takes no rounds of jobs.

A graph falls into blocks that meet in cut points, as a tree. Every path from one block to another passes the cut points between
them, so a block needs of the rest only how many nodes hang on each of its own. Those numbers come from a breadth-first
forest, whose subtrees they are. A block of two nodes, as all edges of hanging trees are, needs no search at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import graph, searches

#: Steps over contacts for which a graph is searched as a whole.
WHOLE = 20_000_000_000


def block_members(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: the members of all blocks, and each node's place in the forest.

    Members: block, node, top (the node of the block next to the root), is_top, weight (nodes of the component that reach the
    block through this one, itself among them), far (the sum of their distances from it; null for a top), total (nodes of the component),
    many (members of the block), below (the sum of distances from the top to all that hang on it by this block). Places: node, root,
    level, size and sum (nodes and levels of the subtree).
    """
    tree = saved(graph.blocks(e), "block-tree")
    roots = tree.select("root").distinct().select(F.col("root").alias("node"), "root", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("block"))
    every = saved(tree.select("node", "root", "level", "parent", "block").unionByName(roots), "forest")
    size = _subtrees(every)
    own = saved(every.join(size, "node"), "subtrees")
    totals = own.where("level = 0").select("root", F.col("size").alias("total"))
    # what hangs on a node by each block below it
    hung = own.where("level > 0").groupBy(F.col("parent").alias("node"), "block", F.col("level").alias("child_level")).agg(F.sum("size").alias("by_size"), F.sum("sum").alias("by_sum"))
    hung = saved(hung.select("node", "block", "by_size", (F.col("by_sum") - (F.col("child_level") - 1) * F.col("by_size")).alias("by_far")), "hung")
    # a block's top is the parent that no edge of the block leads up from
    ends = own.where("level > 0").select("block", "node", "parent", "level", "root")
    tops = ends.groupBy("block").agg(F.min_by("parent", "level").alias("top"), F.first("root").alias("root"), (F.countDistinct("node") + 1).alias("many"))
    whole = hung.groupBy("node").agg(F.sum("by_size").alias("all_size"), F.sum("by_far").alias("all_far"))
    inner = ends.select("block", "node").join(whole, "node", "left").join(hung, ["node", "block"], "left").na.fill(0, ["all_size", "all_far", "by_size", "by_far"])
    inner = inner.select("block", "node", (1 + F.col("all_size") - F.col("by_size")).alias("weight"), (F.col("all_far") - F.col("by_far")).alias("far"))
    tops = tops.join(totals, "root").join(hung.select(F.col("node").alias("top"), "block", "by_size", "by_far"), ["top", "block"])
    facts = tops.select("block", "top", "total", "many", F.col("by_far").alias("below"))
    top = tops.select("block", F.col("top").alias("node"), (F.col("total") - F.col("by_size")).alias("weight"), F.lit(None).cast("long").alias("far"))
    members = inner.unionByName(top).join(facts, "block").withColumn("is_top", F.col("node") == F.col("top"))
    return saved(members, "block-members"), own


def _subtrees(every: DataFrame) -> DataFrame:
    """node, size and sum (of levels) of each node's subtree, from the deepest level up; a level is written once."""
    deepest = every.agg(F.max("level")).first()[0]
    out = below = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = every.where(F.col("level") == level).select("node", "parent", F.lit(1).cast("long").alias("size"), F.col("level").cast("long").alias("sum"))
        if below is not None:
            more = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"), F.sum("sum").alias("more_sum"))
            here = here.join(more, "node", "left").select("node", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), (F.col("sum") + F.coalesce("more_sum", F.lit(0))).alias("sum"))
        below = saved(here, "subtree-level")
        out = below.select("node", "size", "sum") if out is None else out.union(below.select("node", "size", "sum"))
    return every.sparkSession.createDataFrame([], "node string, size long, sum long") if out is None else saved(out, "subtree-sizes")


def _key(block: str, node: str) -> Column:
    return F.concat_ws("|", block, node)


def _searched(e: DataFrame, members: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges inside blocks of more than two nodes, between members (as in ``members``, with key), and those members."""
    large = members.where("many > 2").withColumn("key", _key("block", "node"))
    at = lambda c: own.select(F.col("node").alias(c), F.col("level").alias(f"l{c}"), F.col("block").alias(f"b{c}"))
    both = e.join(at("src"), "src").join(at("dst"), "dst")
    # an edge lies in the block of the tree edge above its deeper end
    inside = both.select("src", "dst", F.when(F.col("lsrc") >= F.col("ldst"), F.col("bsrc")).otherwise(F.col("bdst")).alias("block"))
    inside = inside.join(large.select("block").distinct(), "block", "left_semi")
    return saved(inside.select(_key("block", "src").alias("src"), _key("block", "dst").alias("dst"), F.lit(1).alias("weight")), "block-edges"), saved(large, "searched")


def _none(e: DataFrame, schema: str) -> DataFrame:
    return e.sparkSession.createDataFrame([], schema)


def _whole(e: DataFrame) -> searches.Classes | None:
    found = searches.classes(e)
    return found if found is not None and found.steps <= WHOLE else None


def betweenness(e: DataFrame) -> DataFrame:
    """node and betweenness of all nodes, exact, over (n - 1)(n - 2) as ordered pairs.

    In a block each pair of members counts as often as pairs of nodes reach it through them; a cut point also lies between all that
    hang on it by different blocks.
    """
    e = saved(e, "contacts")
    n = graph.nodes(e).count()
    scaled = lambda delta: F.round(delta / max((n - 1) * (n - 2), 1), 6).alias("betweenness")
    whole = _whole(e)
    if whole is not None:
        return searches.dependencies(whole).select("node", scaled(F.col("delta")))
    members, own = block_members(e)
    edges, large = _searched(e, members, own)
    weight = large.select(F.col("key").alias("node"), "weight")
    held = searches.classes(edges, weight)
    inside = searches.dependencies(held) if held is not None else None
    for part in graph.batches(weight.select("node")) if held is None else ():
        more = graph.dependencies(edges, part, weight)
        inside = saved(more if inside is None else inside.union(more).groupBy("node").agg(F.sum("delta").alias("delta")), "dependencies")
    inside = _none(e, "node string, delta double") if inside is None else inside
    inside = inside.join(large.select(F.col("key").alias("node"), F.col("node").alias("own")), "node").groupBy(F.col("own").alias("node")).agg(F.sum("delta").alias("delta"))
    by = (F.col("total") - F.col("weight")).cast("double")
    cut = members.groupBy("node").agg((F.sum(by) * F.sum(by) - F.sum(by * by)).alias("cut"))
    both = graph.nodes(e).select("node").join(cut, "node", "left").join(inside, "node", "left").na.fill(0.0)
    return both.select("node", scaled(F.col("delta") + F.col("cut")))


def closeness(e: DataFrame) -> DataFrame:
    """node and closeness of all nodes, exact: reached nodes over the sum of distances, scaled by the share of the graph that a node reaches.

    A node's sum of distances is that of its block's top and what changes from there, so sums run down the tree of blocks.
    """
    e = saved(e, "contacts")
    n = graph.nodes(e).count()
    by_share = lambda reached, far: F.round(reached / far * reached / max(n - 1, 1), 6).alias("closeness")
    whole = _whole(e)
    if whole is not None:
        return searches.distances(whole).select("node", by_share(F.col("reached"), F.col("far")))
    members, own = block_members(e)
    edges, large = _searched(e, members, own)
    weight = large.select(F.col("key").alias("node"), "weight")
    held = searches.classes(edges, weight)
    inside = searches.distances(held).select(F.col("node").alias("pivot"), F.col("far").cast("long").alias("inside")) if held is not None else None
    for part in graph.batches(weight.select("node")) if held is None else ():
        far = graph.distances(edges, part).join(weight, "node").groupBy("pivot").agg(F.sum(F.col("level") * F.col("weight")).alias("inside"))
        inside = saved(far if inside is None else inside.union(far), "weighted-distances")
    inside = _none(e, "pivot string, inside long") if inside is None else inside
    fars = members.groupBy("block").agg(F.sum(F.coalesce("far", F.lit(0))).alias("fars"))
    step = members.where("NOT is_top").withColumn("pivot", _key("block", "node")).join(inside, "pivot", "left").join(fars, "block")
    # a block of two: the top's weight, one step away
    near = F.when(F.col("many") == 2, F.col("total") - F.col("weight")).otherwise(F.col("inside"))
    step = saved(step.select("node", "top", (near + F.col("fars") - F.col("below")).alias("step")), "steps")
    base = own.where("level = 0").select("node", F.lit(None).cast("string").alias("top"), F.col("sum").alias("step"))
    at = saved(base.unionByName(step.select("node", "top", "step")), "sums")
    while at.where("top IS NOT NULL").head(1):  # each jumps to the top of its top: as many rounds as the logarithm of the depth
        up = at.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("step").alias("more"))
        at = saved(at.join(up, "top", "left").select("node", F.col("next").alias("top"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step")), "sums")
    reached = own.select("node", "root").join(own.where("level = 0").select("root", (F.col("size") - 1).alias("reached")), "root")
    both = at.join(reached, "node").where("step > 0")
    return both.select("node", by_share(F.col("reached"), F.col("step")))
