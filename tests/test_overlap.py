"""Top pairs by shared members against plain loops, hubs among them."""

import random
from itertools import combinations

import pytest

from callgrid.operators import overlap
from callgrid.operators.graph import resolve_entities


def plain(rows, n, least=2, barred=()):
    sets = {}
    for s, c in rows:
        sets.setdefault(s, set()).add(c)
    out = []
    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k >= least and (a, b) not in barred:
            out.append((a, b, k, round(k / len(sets[a] | sets[b]), 6)))
    return sorted(out, key=lambda r: (-r[2], -r[3], r[0], r[1]))[:n]


@pytest.mark.parametrize("seed", range(3))
def test_top_overlaps(spark, seed):
    """Random sets with members of very unlike frequency and ties; with and without barred pairs; more wanted than there are."""
    r = random.Random(seed)
    rows = sorted({(f"s{r.randrange(60)}", f"c{int(r.random() ** 3 * 80)}") for _ in range(500)})
    sets = spark.createDataFrame(rows, "s string, c string")
    barred = {(a, b) for a, b, *_ in plain(rows, 7)}
    for n in (5, 20, 5000):
        assert [tuple(x) for x in overlap.top_overlaps(sets, n).collect()] == plain(rows, n)
    no = spark.createDataFrame(sorted(barred), "a string, b string")
    assert [tuple(x) for x in overlap.top_overlaps(sets, 10, barred=no).collect()] == plain(rows, 10, barred=barred)


def test_no_pairs(spark):
    assert overlap.top_overlaps(spark.createDataFrame([], "s string, c string"), 20).count() == 0
    assert overlap.top_overlaps(spark.createDataFrame([("a", "x"), ("b", "x")], "s string, c string"), 20).count() == 0


def test_a_hub(spark):
    """100,000 callers of one contact are not paired: 5 * 10^9 pairs would not end."""
    hub = spark.range(100_000).selectExpr("concat('s', id) as s", "explode(array('hub', concat('own', id), concat('next', id % 50000))) as c")
    few = spark.createDataFrame([(s, c) for s in ("p", "q", "r") for c in ("hub", "x", "y", "z")], "s string, c string")
    got = [tuple(r) for r in overlap.top_overlaps(hub.union(few), 3).collect()]
    assert got == [("p", "q", 4, 1.0), ("p", "r", 4, 1.0), ("q", "r", 4, 1.0)]
    assert [r["shared"] for r in overlap.top_overlaps(hub, 20).collect()] == [2] * 20


@pytest.mark.parametrize("few", [1, 2, 32])
def test_sharing_twice(spark, few):
    r = random.Random(few)
    rows = sorted({(f"s{r.randrange(40)}", f"c{r.randrange(60)}") for _ in range(90)})
    got = {x["s"] for x in overlap.sharing_twice(spark.createDataFrame(rows, "s string, c string"), few).collect()}
    pairs = [(a, b) for a, b, *_ in plain(rows, 10_000)]
    assert all(a in got or b in got for a, b in pairs) and got <= {x for p in pairs for x in p} and pairs


def test_entities_of_a_shared_handset(spark):
    """A test handset of 20,000 numbers is one entity without pairing them; high by two numbers that share another."""
    hub = spark.range(20_000).selectExpr("concat('n', id) as msisdn", "'tester' as imei")
    more = spark.createDataFrame([("n1", "x"), ("n2", "x"), ("k1", "y"), ("k2", "y"), ("alone", "z")], "msisdn string, imei string")
    got = sorted((r["entity"], r["numbers"], r["confidence"]) for r in resolve_entities(hub.union(more)).collect())
    assert got == [("k1", 2, "medium"), ("n0", 20_000, "high")]


def test_many_owners_of_one_set(spark):
    """30,000 owners of five sets are not paired, 450 million pairs: n + 1 of each set are enough, also where pairs are barred."""
    hub = spark.range(30_000).selectExpr("concat('s', lpad(id, 5, '0')) as s", "explode(transform(sequence(0, 7), k -> concat('c', (id + k) % 5 + 10 * (k div 5)))) as c").distinct()
    assert overlap.first_of_like(hub, 20).select("s").distinct().count() == 5 * 21
    got = [tuple(r) for r in overlap.top_overlaps(hub, 4).collect()]
    assert got == [("s00000", f"s{i:05d}", 8, 1.0) for i in (5, 10, 15, 20)]
    # the first owner is barred with the next two of its set, and one of them with a third
    barred = spark.createDataFrame([("s00000", "s00005"), ("s00000", "s00010"), ("s00005", "s00015"), ("s00000", "s00000")], "a string, b string")
    got = [tuple(r) for r in overlap.top_overlaps(hub, 3, barred=barred).collect()]
    assert got == [("s00000", f"s{i:05d}", 8, 1.0) for i in (15, 20, 25)]


@pytest.mark.parametrize("seed", range(2))
def test_like_owners_with_barred_pairs(spark, seed):
    """Few sets, each of many owners, who are members of sets themselves: against plain loops."""
    r = random.Random(seed)
    kinds = [r.sample(range(12), r.randint(2, 5)) for _ in range(4)]
    rows = sorted({(f"{i:02d}", f"{c:02d}") for i in range(40) for c in kinds[i % 4] if c != i})
    sets = spark.createDataFrame(rows, "s string, c string")
    barred = {tuple(sorted(x)) for x in rows} | {(f"{r.randrange(20):02d}", f"{r.randrange(20, 40):02d}") for _ in range(60)}
    no = spark.createDataFrame(sorted(barred), "a string, b string")
    for n in (1, 3, 8):
        assert [tuple(x) for x in overlap.top_overlaps(sets, n, barred=no).collect()] == plain(rows, n, barred=barred)
        assert [tuple(x) for x in overlap.top_overlaps(sets, n).collect()] == plain(rows, n)
