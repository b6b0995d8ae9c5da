"""Call graphs: edges, degrees, ranks, centralities, triangles, components. Iterative measures join and aggregate edge tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import epoch
from ..sources.scratch import place, saved
from . import blocktree
from .communities import communities  # noqa: F401
from .overlap import sharing_twice


def edges(cdr: DataFrame) -> DataFrame:
    """Undirected contacts src < dst with the number of calls; calls to oneself and to nobody drop out."""
    ok = cdr.where("a_party_number IS NOT NULL AND b_party_number IS NOT NULL AND a_party_number <> b_party_number")
    return ok.groupBy(F.least("a_party_number", "b_party_number").alias("src"), F.greatest("a_party_number", "b_party_number").alias("dst")).agg(F.count("*").alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "weight").union(e.select("dst", "src", "weight"))


def nodes(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def heaviest(e: DataFrame, limit: int) -> DataFrame:
    return e.orderBy(F.desc("weight"), "src", "dst").limit(limit)


def degree_centrality(e: DataFrame) -> DataFrame:
    d = nodes(e)
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))


#: Rounds of ranks in one plan; each keeps those before it, so the round at which to stop is found afterwards.
RANK_STEP = 5


def pagerank(e: DataFrame, rounds: int = 100, alpha: float = 0.85, weighted: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """Power iteration until the ranks of a round differ from the last by less than ``tolerance`` in sum, or after ``rounds``; undirected edges leave no node without a way out."""
    b = both_ways(e).withColumn("w", F.col("weight").cast("double") if weighted else F.lit(1.0))
    total = b.groupBy("src").agg(F.sum("w").alias("t"))
    node = total.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("p"), F.lit(True).alias("own"))
    # a row of each node to itself carries its ranks so far
    share = saved(b.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"), F.lit(False).alias("own")).union(node), "shares")
    n = max(share.where("own").count(), 1)
    rank = share.where("own").select(F.col("src").alias("node"), F.array(F.lit(1.0 / n)).alias("ranks"))
    for start in range(0, rounds, RANK_STEP):
        steps = min(RANK_STEP, rounds - start)
        for _ in range(steps):
            gain = share.join(rank, share["src"] == rank["node"]).groupBy("dst").agg(F.sum(F.col("p") * F.element_at("ranks", -1)).alias("g"), F.max(F.when(F.col("own"), F.col("ranks"))).alias("ranks"))
            rank = gain.select(F.col("dst").alias("node"), F.array_append("ranks", F.lit((1 - alpha) / n) + alpha * F.col("g")).alias("ranks"))
        rank = saved(rank, "ranks")
        moved = rank.agg(*[F.sum(F.abs(F.col("ranks")[k + 1] - F.col("ranks")[k])) for k in range(steps)]).first()
        done = next((k + 1 for k, m in enumerate(moved) if (m or 0) < tolerance), None)
        if done:
            return rank.select("node", F.col("ranks")[done].alias("rank"))
        rank = rank.select("node", F.array(F.element_at("ranks", -1)).alias("ranks"))
    return rank.select("node", F.col("ranks")[0].alias("rank"))


def distances(e: DataFrame, pivots: DataFrame) -> DataFrame:
    """Breadth-first levels from pivots (node): pivot, node, level, paths (number of shortest ones).

    Each level is written once, to a folder of its own: what lies one step from a level is in it, in the one before or in the next.
    """
    spark, b = e.sparkSession, saved(both_ways(e).select("src", "dst"), "bfs-edges")
    path, schema = place(e, "bfs"), "pivot string, node string, paths double"
    before, front = None, pivots.select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("paths"))
    for level in count():
        front.write.parquet(f"{path}/level={level}")
        front = spark.read.schema(schema).parquet(f"{path}/level={level}")
        if not front.head(1):
            break
        near = front.join(b, front["node"] == b["src"]).groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        seen = front if before is None else front.union(before)
        before, front = front, near.join(seen.select("pivot", "node"), ["pivot", "node"], "left_anti").select("pivot", "node", "paths")
    return spark.read.schema(f"{schema}, level int").parquet(path)


def pivots(e: DataFrame, k: int = 50) -> DataFrame:
    return nodes(e).orderBy(F.xxhash64("node"), "node").limit(k).select("node")


#: Pivots whose levels are held at once.
BATCH = 500


def batches(pivots: DataFrame) -> Iterator[DataFrame]:
    """BATCH pivots at a time, about; none of no pivots."""
    kept = saved(pivots, "pivots")
    parts = math.ceil(kept.count() / BATCH)
    for i in range(parts):
        yield kept.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == i)


def closeness(e: DataFrame, from_: DataFrame | None = None) -> DataFrame:
    """Reached nodes over the sum of distances, scaled by the share of the graph that a node reaches: of all nodes, by blocks, or of the pivots."""
    if from_ is None:
        return blocktree.closeness(e)
    n = nodes(e).count()
    d = None
    for part in batches(from_):
        more = distances(e, part).groupBy("pivot").agg((F.count("*") - 1).alias("reached"), F.sum("level").alias("total"))
        d = saved(more if d is None else d.union(more), "closeness")
    return d.where("total > 0").select(F.col("pivot").alias("node"), F.round(F.col("reached") / F.col("total") * F.col("reached") / max(n - 1, 1), 6).alias("closeness"))


def dependencies(e: DataFrame, from_: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """node and delta, the sum of Brandes' dependencies of the pivots on it; with ``weight`` (node, weight) a pair counts the product of its weights.

    From the deepest level up; a level needs only the one below, and is written once.
    """
    spark, b = e.sparkSession, saved(both_ways(e).select("src", "dst"), "bfs-edges")
    seen = distances(e, from_)
    path, schema = place(e, "dependencies"), "pivot string, node string, paths double, value double, delta double"
    below = None
    for level in range(seen.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = seen.where(F.col("level") == level).select("pivot", "node", "paths")
        here = here.withColumn("weight", F.lit(1.0)) if weight is None else here.join(weight, "node")
        if below is None:
            here = here.withColumn("delta", F.lit(0.0))
        else:
            up = below.join(b, below["node"] == b["src"]).select("pivot", F.col("dst").alias("node"), (F.col("value") / F.col("paths")).alias("v")).groupBy("pivot", "node").agg(F.sum("v").alias("v"))
            here = here.join(up, ["pivot", "node"], "left").withColumn("delta", F.col("paths") * F.coalesce("v", F.lit(0.0)))
        here.select("pivot", "node", "paths", (F.col("weight") + F.col("delta")).alias("value"), "delta").write.parquet(f"{path}/level={level}")
        below = spark.read.schema(schema).parquet(f"{path}/level={level}")
    if below is None:
        return spark.createDataFrame([], "node string, delta double")
    found = spark.read.schema(schema).parquet(path)
    if weight is not None:
        found = found.join(weight.select(F.col("node").alias("pivot"), "weight"), "pivot").withColumn("delta", F.col("delta") * F.col("weight"))
    return found.groupBy("node").agg(F.sum("delta").alias("delta"))


def betweenness(e: DataFrame, from_: DataFrame | None = None) -> DataFrame:
    """Brandes' sums, exact for all nodes, by blocks; or from the pivots, scaled to all nodes."""
    if from_ is None:
        return blocktree.betweenness(e)
    k, n = from_.count(), nodes(e).count()
    total = None
    for part in batches(from_):
        more = dependencies(e, part)
        total = saved(more if total is None else total.union(more).groupBy("node").agg(F.sum("delta").alias("delta")), "dependencies")
    scale = (n / max(k, 1)) / max((n - 1) * (n - 2), 1)
    return total.select("node", F.round(F.col("delta") * scale, 6).alias("betweenness"))


def brokers(e: DataFrame, from_: DataFrame | None = None, n: int = 8) -> DataFrame:
    return betweenness(e, from_).where("betweenness > 0").join(nodes(e).select("node", "degree"), "node").orderBy(F.desc("betweenness"), "node").limit(n)


def components(e: DataFrame) -> DataFrame:
    """node and label, the least node of its component: labels spread over edges and jump along labels."""
    b = saved(both_ways(e).select("src", "dst"), "component-edges")
    label = saved(b.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("label")), "labels")
    while True:
        near = b.join(label, b["dst"] == label["node"]).groupBy("src").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["src"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("label").alias("up"))
        now = saved(step.join(up, "mid").select("node", F.least("mid", "up").alias("label"), (F.least("mid", "up") < F.col("old")).alias("moved")), "labels")
        label = now.select("node", "label")
        if not now.where("moved").head(1):
            return label


def modularity(e: DataFrame, label: DataFrame) -> DataFrame:
    b = both_ways(e)
    two_m = F.sum("weight")
    s = b.join(label.select(F.col("node").alias("src"), F.col("label").alias("l1")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("l2")), "dst")
    inside = s.groupBy("l1").agg(F.sum(F.when(F.col("l1") == F.col("l2"), F.col("weight")).otherwise(0)).alias("i"), F.sum("weight").alias("d"))
    return inside.crossJoin(F.broadcast(b.agg(two_m.alias("m2")))).agg(F.count("*").alias("communities"), F.round(F.sum(F.col("i") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), 2)), 6).alias("modularity"))


def _spanning_forest(e: DataFrame) -> DataFrame:
    """node, parent, level and root of the nodes below the root of a breadth-first tree of each component; a parent is the least node one level up."""
    roots = components(e).select(F.col("label").alias("node")).distinct()
    level = distances(e, roots).select("node", "level", F.col("pivot").alias("root"))
    b = both_ways(e).select("src", "dst").join(level.withColumnRenamed("node", "src"), "src").join(level.select(F.col("node").alias("dst"), F.col("level").alias("above")), "dst")
    return saved(b.where("above = level - 1").groupBy(F.col("src").alias("node"), "level", "root").agg(F.min("dst").alias("parent")), "tree")


def _meeting_levels(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """s, d and depth, the level of the deepest common ancestor, of pairs of nodes: both climb until they meet."""
    at = lambda n, c: tree.select(F.col("node").alias(n), F.col("level").alias(f"l{c}"), F.col("parent").alias(f"p{c}"))
    cur = pairs.select("s", "d", F.col("s").alias("u"), F.col("d").alias("w"))
    met = None
    while True:
        both = cur.join(at("u", "u"), "u", "left").join(at("w", "w"), "w", "left").na.fill(0, ["lu", "lw"])
        both = saved(both, "climb")
        done = both.where("u = w").select("s", "d", F.col("lu").alias("depth"))
        met = done if met is None else met.union(done)
        rest = both.where("u <> w")
        if not rest.head(1):
            return met
        cur = rest.select("s", "d", F.when(F.col("lu") >= F.col("lw"), F.col("pu")).otherwise(F.col("u")).alias("u"), F.when(F.col("lw") >= F.col("lu"), F.col("pw")).otherwise(F.col("w")).alias("w"))


def blocks(e: DataFrame) -> DataFrame:
    """node, parent and block of each tree edge of a breadth-first forest: edges of one block lie on common cycles.

    After Tarjan and Vishkin, by joins: an edge off the tree joins the tree edges above its two ends, and a tree
    edge joins the one above it if an edge off the tree leads from below it to beyond its upper node, which the
    levels where such edges meet tell. The rounds are as many as the forest has levels; no component is gathered.
    """
    tree = _spanning_forest(e)
    own = tree.select(F.least("node", "parent").alias("s"), F.greatest("node", "parent").alias("d"))
    off = saved(e.select(F.col("src").alias("s"), F.col("dst").alias("d")).join(own, ["s", "d"], "left_anti"), "off-tree")
    met = saved(_meeting_levels(off, tree), "meetings")
    first = met.select(F.explode(F.array("s", "d")).alias("node"), "depth").groupBy("node").agg(F.min("depth").alias("low"))
    first = saved(tree.join(first, "node").select("node", "parent", "level", "low"), "lows")
    low = below = None
    for level in range(tree.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = first.where(F.col("level") == level).select("node", "low")
        here = (here if below is None else here.union(below)).groupBy("node").agg(F.min("low").alias("low"))
        here = saved(here.join(tree, "node").select("node", "parent", "level", "low"), "lows")
        below = here.select(F.col("parent").alias("node"), "low")
        low = here if low is None else low.union(here)
    links = off.select(F.col("s").alias("src"), F.col("d").alias("dst"))
    if low is not None:
        links = links.union(low.where("level > 1 AND low < level - 1").select("node", "parent"))
    label = components(saved(links.withColumn("weight", F.lit(1)), "block-links"))
    return saved(tree.join(label, "node", "left").select("node", "parent", F.coalesce("label", "node").alias("block"), "level", "root"), "blocks")


def cut_points(e: DataFrame) -> DataFrame:
    """Bridges (src, dst) and articulation points (src, null): blocks of one edge, and nodes where blocks meet."""
    b = blocks(e)
    alone = b.groupBy("block").agg(F.count("*").alias("n")).where("n = 1").select("block")
    bridge = b.join(alone, "block", "left_semi").select(F.lit("bridge").alias("kind"), F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst"))
    ends = b.select("node", "block").union(b.select("parent", "block")).groupBy("node").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x < y")
    return bridge.union(ends.select(F.lit("cut_point"), "node", F.lit(None).cast("string")))


def top_cut_points(e: DataFrame, n: int = 8) -> DataFrame:
    return cut_points(e).where("kind = 'cut_point'").select(F.col("src").alias("node")).join(nodes(e).select("node", "degree"), "node").orderBy(F.desc("degree"), "node").limit(n)


def one_way_ties(cdr: DataFrame, least: int = 3, n: int = 12) -> DataFrame:
    d = cdr.where("a_party_number <> b_party_number").groupBy(F.col("a_party_number").alias("a"), F.col("b_party_number").alias("b")).agg(F.count("*").alias("n"))
    back = d.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return d.where(F.col("n") >= least).join(back, ["a", "b"], "left_anti").orderBy(F.desc("n"), "a", "b").limit(n)


def relays(cdr: DataFrame, seconds: int = 900, n: int = 30) -> DataFrame:
    """A calls B, then B calls C within 15 minutes: the first of each A, B, C."""
    r = cdr.where("a_party_number <> b_party_number").select("id", "a_party_number", "b_party_number", epoch("start_time").alias("t"))
    bucket = F.floor(F.col("t") / seconds).cast("long")
    one = r.select(F.col("a_party_number").alias("a"), F.col("b_party_number").alias("b"), F.col("t").alias("t1"), F.col("id").alias("id1"), F.explode(F.array(bucket, bucket + 1)).alias("k"))
    two = r.select(F.col("a_party_number").alias("b"), F.col("b_party_number").alias("c"), F.col("t").alias("t2"), F.col("id").alias("id2"), bucket.alias("k"))
    hit = one.join(two, ["b", "k"]).where((F.col("t2") > F.col("t1")) & (F.col("t2") - F.col("t1") <= seconds) & (F.col("c") != F.col("a")))
    first = hit.groupBy("a", "b", "c").agg(F.min(F.struct("t1", "t2", "id1", "id2")).alias("m"))
    return first.select("a", "b", "c", "m.t1", "m.t2").orderBy("t1", "t2", "a", "b", "c").limit(n).select("a", "b", "c", F.round((F.col("t2") - F.col("t1")) / 60, 3).alias("minutes"))


def link_prediction(e: DataFrame, n: int = 10, hub: int = 200) -> DataFrame:
    """Pairs without an edge that share a contact of at most 200 contacts, scored over all they share."""
    b = saved(both_ways(e).select("src", "dst"), "wedge-edges")
    deg = b.groupBy(F.col("src").alias("mid")).agg(F.count("*").alias("deg"))
    small = b.withColumnRenamed("src", "mid").withColumnRenamed("dst", "x").join(deg.where(F.col("deg") <= hub), "mid")
    cand = small.select("mid", F.col("x").alias("a")).join(small.select("mid", F.col("x").alias("b")), "mid").where("a < b").select("a", "b").distinct()
    cand = cand.join(b.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    common = cand.join(b.select(F.col("src").alias("a"), F.col("dst").alias("mid")), "a").join(b.select(F.col("src").alias("b"), F.col("dst").alias("mid")), ["b", "mid"]).join(deg, "mid")
    g = common.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum(1 / F.log("deg")).alias("aa"), F.sum(1 / F.col("deg")).alias("ra"))
    g = g.join(deg.select(F.col("mid").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("mid").alias("b"), F.col("deg").alias("db")), "b")
    out = g.select("a", "b", "common", F.round("aa", 6).alias("adamic_adar"), F.round("ra", 6).alias("resource"), F.round(F.col("common") / (F.col("da") + F.col("db") - F.col("common")), 6).alias("jaccard"))
    return out.orderBy(F.desc("adamic_adar"), "a", "b").limit(n)


def summary(e: DataFrame) -> DataFrame:
    n = nodes(e).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 3).alias("avg_degree"))
    m = e.agg(F.count("*").alias("edges"), F.max("weight").alias("strongest"))
    return n.crossJoin(F.broadcast(m)).withColumn("density", F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6))


def triangles(e: DataFrame) -> DataFrame:
    """a < b < c, all three in contact, with their calls. Edges are oriented by degree, so a hub starts no wedge."""
    d = nodes(e).select("node", "degree")
    s = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = saved(s.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v"), "weight"), "oriented")
    wedge = o.select("u", F.col("v").alias("x"), F.col("weight").alias("w1")).join(o.select("u", F.col("v").alias("y"), F.col("weight").alias("w2")), "u").where("x < y")
    close = o.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), F.col("weight").alias("w3"))
    t = wedge.join(close, ["x", "y"]).withColumn("s", F.array_sort(F.array("u", "x", "y")))
    return t.select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), F.col("s")[2].alias("c"), (F.col("w1") + F.col("w2") + F.col("w3")).alias("calls"))


def clustering(e: DataFrame) -> DataFrame:
    t = triangles(e).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    d = nodes(e).join(t, "node", "left").na.fill(0, ["t"])
    return d.select("node", "degree", F.when(F.col("degree") > 1, F.round(2 * F.col("t") / (F.col("degree") * (F.col("degree") - 1)), 6)).otherwise(0.0).alias("clustering"))


def triads(e: DataFrame) -> DataFrame:
    """Over each edge and third node: closed if in contact with both ends, open if with one."""
    d = nodes(e).select("node", "degree")
    ends = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    base = ends.agg(F.sum(F.col("a") + F.col("b") - 2).alias("touch"), F.count("*").alias("m"))
    closed = triangles(e).agg((3 * F.count("*")).alias("closed"))
    n = d.agg(F.count("*").alias("n"))
    x = base.crossJoin(F.broadcast(closed)).crossJoin(F.broadcast(n))
    return x.select("closed", (F.col("touch") - 2 * F.col("closed")).alias("open"), (F.col("m") * (F.col("n") - 2)).alias("total"))


def core_numbers(e: DataFrame) -> DataFrame:
    """k-core by peeling: of each k the nodes that go before all have k + 1 contacts left; a k that takes no node is passed over."""
    left = saved(both_ways(e).select("src", "dst"), "core")
    out, k = None, 0
    while True:
        least = left.groupBy("src").agg(F.count("*").alias("d")).agg(F.min("d")).first()[0]
        if least is None:
            return out
        k = max(k, least)
        low = saved(left.groupBy("src").agg(F.count("*").alias("d")).where(F.col("d") <= k).select("src"), "peel")
        rest = left.join(low, "src", "left_anti")
        kept = saved(rest.join(low.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"), "core")
        # nodes whose contacts all went have core k as well
        bare = rest.select("src").distinct().join(kept.select("src").distinct(), "src", "left_anti")
        named = low.union(bare).select(F.col("src").alias("node"), F.lit(k).cast("long").alias("core"))
        out = saved(named if out is None else out.union(named), "cores")
        left = kept


def roles(e: DataFrame, from_: DataFrame | None = None) -> DataFrame:
    d, b = degree_centrality(e), betweenness(e, from_)
    x = d.join(b, "node", "left").na.fill(0.0, ["betweenness"])
    role = F.when((F.col("centrality") > 0.5) & (F.col("betweenness") > 0.4), "kingpin").when(F.col("betweenness") > 0.5, "broker").when(F.col("centrality") > 0.6, "hub").otherwise("member")
    return x.withColumn("role", role)


def structural_roles(e: DataFrame, from_: DataFrame | None = None) -> DataFrame:
    d, b, k = degree_centrality(e), betweenness(e, from_), core_numbers(e)
    top = b.agg(F.max("betweenness").alias("top"))
    x = d.join(b, "node", "left").join(k, "node", "left").na.fill(0).crossJoin(F.broadcast(top)).withColumn("b", F.col("betweenness") / F.when(F.col("top") > 0, F.col("top")).otherwise(1))
    role = F.when((F.col("centrality") > 0.4) & (F.col("b") > 0.3), "broker").when(F.col("centrality") > 0.5, "hub").when(F.col("core") >= 3, "core").when(F.col("centrality") < 0.05, "peripheral").otherwise("regular")
    return x.select("node", "centrality", "betweenness", "core", role.alias("role"))


def reciprocity(cdr: DataFrame) -> DataFrame:
    d = cdr.where("a_party_number <> b_party_number").select(F.col("a_party_number").alias("a"), F.col("b_party_number").alias("b")).distinct()
    back = d.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).alias("x"))
    return d.join(back, ["a", "b"], "left").agg(F.count("*").alias("directed"), F.count("x").alias("returned"), F.round(F.count("x") / F.count("*"), 6).alias("reciprocity"))


def resolve_entities(cdr: DataFrame) -> DataFrame:
    """Numbers that share handsets, in chains: entity is the least number; high if two share more than one."""
    pairs = cdr.where("msisdn IS NOT NULL AND imei IS NOT NULL").select("msisdn", "imei").distinct()
    links = pairs.select(F.concat(F.lit("n"), "msisdn").alias("src"), F.concat(F.lit("~"), "imei").alias("dst"), F.lit(1).alias("weight"))
    label = components(links).where("node LIKE 'n%'").select(F.substring("node", 2, 100).alias("msisdn"), F.substring("label", 2, 100).alias("entity"))
    groups = label.groupBy("entity").agg(F.count("*").alias("numbers"), F.array_join(F.sort_array(F.collect_set("msisdn")), ",").alias("members")).where("numbers > 1")
    twice = sharing_twice(pairs.select(F.col("msisdn").alias("s"), F.col("imei").alias("c")))
    strong = label.join(twice.withColumnRenamed("s", "msisdn"), "msisdn", "left_semi").select("entity", F.lit(True).alias("twice")).distinct()
    return groups.join(strong, "entity", "left").select("entity", "numbers", "members", F.when(F.col("twice"), "high").otherwise("medium").alias("confidence"))
