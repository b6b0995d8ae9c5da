"""Cut points, components, cores and centralities on small graphs, against plain loops."""

import random

from callgrid.operators import graph as g


def frame(spark, pairs):
    rows = sorted({(min(a, b), max(a, b)) for a, b in pairs if a != b})
    return spark.createDataFrame([(a, b, 1) for a, b in rows], "src string, dst string, weight long")


def parts(nodes, pairs):
    """How many components the nodes have."""
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    return len(set(label.values()))


def cuts(pairs):
    """Bridges and articulation points by taking each away."""
    pairs = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    nodes = {x for p in pairs for x in p}
    whole = parts(nodes, pairs)
    bridges = {p for p in pairs if parts(nodes, pairs - {p}) > whole}
    points = {n for n in nodes if parts(nodes - {n}, {p for p in pairs if n not in p}) > whole}
    return bridges, points


def test_cut_points(spark):
    """Cycles that share a node, a bridge between cycles, a path, a clique, and random graphs, all in one table of components."""
    r = random.Random(3)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "f")]
    pairs += [(f"p{i}", f"p{i + 1}") for i in range(5)] + [(f"k{i}", f"k{j}") for i in range(5) for j in range(i)]
    for n in range(4):
        pairs += [(f"r{n}_{r.randrange(14)}", f"r{n}_{r.randrange(14)}") for _ in range(17)]
    got = g.cut_points(frame(spark, pairs)).collect()
    bridges, points = cuts(pairs)
    assert {(x["src"], x["dst"]) for x in got if x["kind"] == "bridge"} == bridges
    assert {x["src"] for x in got if x["kind"] == "cut_point"} == points
    assert ("c" in points, "a" in points, ("e", "f") in bridges) == (True, False, True)


def test_no_contacts(spark):
    assert g.cut_points(frame(spark, [])).count() == 0


def test_long_path_and_clique(spark):
    """Levels and cores have no end but the graph's: a path of 14 nodes, and cores of 24."""
    path = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(13)]
    far = g.distances(frame(spark, path), spark.createDataFrame([("n00",)], "node string")).collect()
    assert {x["node"]: x["level"] for x in far} == {f"n{i:02d}": i for i in range(14)}
    clique = [(f"c{i:02d}", f"c{j:02d}") for i in range(25) for j in range(i)] + [("c00", "tail")]
    core = {x["node"]: x["core"] for x in g.core_numbers(frame(spark, clique)).collect()}
    assert core == {f"c{i:02d}": 24 for i in range(25)} | {"tail": 1}


def brute_paths(pairs):
    """Betweenness (ordered pairs) and closeness of all nodes by searches from each."""
    near = {}
    for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]}:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    n, between, close = len(near), dict.fromkeys(near, 0.0), {}
    for s in near:
        level, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0.0
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                between[w] += delta[w]
        reached = len(order) - 1
        close[s] = reached / sum(level.values()) * reached / max(n - 1, 1)
    return {v: round(x / max((n - 1) * (n - 2), 1), 6) for v, x in between.items()}, {v: round(x, 6) for v, x in close.items()}


def shapes():
    """Cycles that share nodes, hanging trees, a chain of cliques, a star, a lone edge and random graphs, in several components."""
    r = random.Random(11)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("f", "g"), ("g", "h"), ("h", "f"), ("x", "y")]
    pairs += [("h", f"leaf{i}") for i in range(4)] + [("leaf0", "twig"), ("twig", "tip")] + [("hub", f"s{i}") for i in range(6)]
    for k in range(3):
        pairs += [(f"q{k}{i}", f"q{k}{j}") for i in range(4) for j in range(i)] + [(f"q{k}3", f"q{k + 1}0")] * (k < 2)
    for n in range(3):
        pairs += [(f"r{n}_{r.randrange(12)}", f"r{n}_{r.randrange(12)}") for _ in range(14)]
    return [p for p in pairs if p[0] != p[1]]


def test_centralities_by_blocks(spark):
    pairs = shapes()
    e = frame(spark, pairs)
    between, close = brute_paths(pairs)
    got = {x["node"]: x["betweenness"] for x in g.betweenness(e).collect()}
    assert got.keys() == between.keys() and all(abs(got[v] - between[v]) < 2e-6 for v in got)
    got = {x["node"]: x["closeness"] for x in g.closeness(e).collect()}
    assert got.keys() == close.keys() and all(abs(got[v] - close[v]) < 2e-6 for v in got)
    # the searches by blocks, and those from every node: rows that they write
    members, own = g.blocktree.block_members(e)
    inner, large = g.blocktree._searched(e, members, own)
    by_blocks = g.distances(inner, large.select(g.F.col("key").alias("node"))).count()
    assert by_blocks * 2 < g.distances(e, g.nodes(e).select("node")).count()


def test_centralities_from_pivots_and_of_nothing(spark):
    pairs = shapes()
    e = frame(spark, pairs)
    between, close = brute_paths(pairs)
    got = {x["node"]: x["betweenness"] for x in g.betweenness(e, g.nodes(e).select("node")).collect()}
    assert all(abs(got.get(v, 0) - between[v]) < 2e-6 for v in between)
    none = frame(spark, [])
    assert g.betweenness(none).count() == 0 and g.closeness(none).count() == 0 and g.communities(none).count() == 0
    lone = frame(spark, [("a", "b")])
    assert sorted((x["node"], x["closeness"]) for x in g.closeness(lone).collect()) == [("a", 1.0), ("b", 1.0)]


def test_pagerank_stops_by_tolerance(spark):
    """A path of 41 nodes needs more rounds than a fixed few."""
    pairs = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    n, rank, rounds = len(near), dict.fromkeys(near, 1 / len(near)), 0
    while rounds < 100:
        new = {v: 0.15 / n + 0.85 * sum(rank[u] / len(near[u]) for u in near[v]) for v in near}
        moved, rank, rounds = sum(abs(new[v] - rank[v]) for v in near), new, rounds + 1
        if moved < 1e-6:
            break
    assert 60 < rounds < 100
    got = {x["node"]: x["rank"] for x in g.pagerank(frame(spark, pairs)).collect()}
    assert got.keys() == rank.keys() and all(abs(got[v] - rank[v]) < 1e-12 for v in rank)
    few = {x["node"]: x["rank"] for x in g.pagerank(frame(spark, pairs), rounds=7).collect()}
    assert abs(sum(few.values()) - 1) < 1e-9 and max(abs(few[v] - rank[v]) for v in rank) > 1e-6


def quality(rows, label):
    two_m = 2 * sum(w for *_, w in rows)
    inside, degree = {}, {}
    for a, b, w in rows:
        inside[label[a]] = inside.get(label[a], 0) + 2 * w * (label[a] == label[b])
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
    return sum(inside.get(c, 0) / two_m - (d / two_m) ** 2 for c, d in degree.items())


def greedy(rows):
    """Merges the two communities that gain most, as long as any do."""
    label = {x: x for a, b, _ in rows for x in (a, b)}
    best = quality(rows, label)
    while True:
        links = {(label[a], label[b]) for a, b, _ in rows if label[a] != label[b]}
        tries = [(quality(rows, {v: a if c == b else c for v, c in label.items()}), a, b) for a, b in sorted(links)]
        if not tries or max(tries)[0] <= best + 1e-12:
            return best
        best, a, b = max(tries)
        label = {v: a if c == b else c for v, c in label.items()}


def test_communities(spark):
    """Modularity is at least that of greedy merging, on shapes with weights, and the result is the same whatever the partitions."""
    r = random.Random(2)
    clubs = [(f"m{k}_{i}", f"m{k}_{j}", r.randint(1, 5)) for k in range(3) for i in range(6) for j in range(i) if r.random() < 0.8] + [(f"m{k}_0", f"m{(k + 1) % 3}_1", 1) for k in range(3)]
    plain = sorted({(min(p), max(p)) for p in shapes()})
    for rows in ([(*sorted((a, b)), w) for a, b, w in clubs], [(a, b, 1) for a, b in plain]):
        e = spark.createDataFrame(rows, "src string, dst string, weight long")
        label = {x["node"]: x["label"] for x in g.communities(e).collect()}
        assert label.keys() == {x for a, b, _ in rows for x in (a, b)}
        assert all(min(v for v in label if label[v] == c) == c for c in label.values())
        assert quality(rows, label) >= greedy(rows) - 1e-9
        if rows[0][0].startswith("m"):
            assert label == {x["node"]: x["label"] for x in g.communities(e.repartition(3)).collect()}


def test_centralities_by_each_way(spark, monkeypatch):
    """Whole graphs in arrays, blocks in arrays and blocks by joins agree with plain searches; so does a graph of many like nodes."""
    r = random.Random(4)
    like = shapes() + [(f"l{i}", f"t{(i + k) % 7}") for i in range(40) for k in range(3)] + [(f"t{i}", f"t{i + 1}") for i in range(0, 6, 2)] + [(f"z{i}", f"z{r.randrange(30)}") for i in range(30)]
    e, (between, close) = frame(spark, like), brute_paths(like)
    for whole, held in ((10**9, 10**6), (0, 10**6), (0, 0)):
        monkeypatch.setattr(g.blocktree, "WHOLE", whole)
        monkeypatch.setattr(g.blocktree.searches, "HELD", held)
        monkeypatch.setattr(g.blocktree.searches, "SEEN", 50)  # many batches
        got = {x["node"]: x["betweenness"] for x in g.betweenness(e).collect()}
        assert got.keys() == between.keys() and all(abs(got[v] - between[v]) < 2e-6 for v in got)
        got = {x["node"]: x["closeness"] for x in g.closeness(e).collect()}
        assert got.keys() == close.keys() and all(abs(got[v] - close[v]) < 2e-6 for v in got)


def test_centralities_need_few_jobs(spark, monkeypatch):
    """A graph of 3,000 callers of 100 numbers is searched in arrays: no level is a table, and like callers are one class."""
    monkeypatch.setattr(g, "distances", None)
    pairs = [(f"c{i}", f"n{(i + k) % 100}") for i in range(3000) for k in range(8)]
    found = g.blocktree.searches.classes(frame(spark, pairs))
    assert (found.table.count(), found.contacts.count()) == (200, 800)
    top = {x["node"]: x["betweenness"] for x in g.brokers(frame(spark, pairs)).collect()}
    assert len(top) == 8 and all(k.startswith("n") for k in top)
