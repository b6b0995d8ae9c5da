"""The n-gram join against all pairs, its signatures against pairs at the threshold, and hot groups."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from callgrid.llm import linking, partenum


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=80):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links += a != b
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return Counter(out), links


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = Counter(tuple(r) for r in partenum.similar_sets(df).select("doc_id", "n_shingles", "component_id").collect())
    want, links = brute(rows)
    assert got == want
    return links


def test_odd_rows(spark, docs, none):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.similar_sets(docs).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])[0]
    assert partenum.similar_sets(none).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 85, 93])
def test_signatures_of_pairs_at_the_threshold(percent):
    rng = np.random.default_rng(percent)
    met, items = 0, partenum.SetItems()
    for trial in range(1500):
        n = int(rng.integers(1, 50 if trial % 2 else 700))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(trial % 3 * 4))  # also crowded in a part of the domain
        apart = int(rng.integers(0, n * (100 - percent) // percent + 1))
        gone = int(rng.integers(0, min(apart, len(a) - 1) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, apart - gone, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        both = items.sketches(pa.chunked_array([pa.array([partenum.parity(x).tolist()]) for x in (a, b)]))
        alike = 100 * common >= percent * (len(a) + len(b) - common)
        assert not alike or items.may_be(both, np.array([0]), np.array([1]), np.array([len(a)]), np.array([len(b)]), percent)[0]
        if len(a) + len(b) > 2 * common and 100 * common >= percent * (len(a) + len(b) - common):
            met += 1
            assert len(np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)))
    assert met > 300


def near(rng, words, share):
    """A text with some words replaced, so that its similarity is somewhat above or below the threshold."""
    out = list(words)
    for _ in range(max(1, int(share * len(words)))):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return " ".join(out)


def test_near_copies_of_all_sizes(spark):
    rng, rows = random.Random(3), []
    for size in (4, 5, 6, 8, 9, 12, 15, 20, 30, 45, 70, 120, 300, 900):
        words = [f"w{rng.random()}" for _ in range(size)]
        rows += [(len(rows) + i, near(rng, words, rng.choice([0.005, 0.015, 0.025, 0.04]))) for i in range(7)]
        rows += [(len(rows), " ".join(words[: int(size * 0.85)])), (len(rows) + 1, " ".join(words) + " and more")]
    assert check(spark, rows) > 40


def test_hot_groups_and_passages(spark, monkeypatch):
    """Near copies of one text, texts that share most of a passage, chains through members that are not alike, copies; in small chunks and batches."""
    monkeypatch.setattr(linking, "CHUNK_ROWS", 4)
    monkeypatch.setattr(linking, "EDGES", 3)
    rng, rows = random.Random(4), []
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows += [(i, near(rng, base, 0.01)) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"t{i}-{k}" for k in range(14 + i % 6)])) for i in range(40)]
    rows += [(200 + i, " ".join(passage + [f"u{j}" for j in range(i, i + 16)])) for i in range(30)]
    rows += [(300 + i, rows[5][1]) for i in range(20)]
    rows += [(400 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 90))) for i in range(25)]
    assert check(spark, rows, 5) > 300


def test_shared_signatures_over_batches(spark, monkeypatch):
    monkeypatch.setattr(partenum, "small_batches", lambda s, n=0: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    rng = random.Random(5)
    rows = [(rng.randrange(12), rng.randrange(30)) for _ in range(150)] + [(77, i) for i in range(10)] + [(88, 1)] * 9
    got = partenum.shared_signatures(spark.createDataFrame(rows, "key long, node long")).collect()
    nodes = {}
    for k, n in rows:
        nodes.setdefault(k, set()).add(n)
    want = {(k, n, min(s)) for k, s in nodes.items() if len(s) > 1 for n in s}
    assert {tuple(r) for r in got} == want


def test_parity_prunes():
    rng = np.random.default_rng(1)
    items = partenum.SetItems()
    for sizes in ([200, 200], [390, 420], [1000, 1100], [3000, 3500], [9000, 9000]):
        a, b = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes)
        near = np.concatenate([a[: len(a) * 91 // 100], rng.integers(0, 2**64, len(a) // 12, dtype=np.uint64)])
        keys = items.sketches(pa.chunked_array([pa.array([partenum.parity(x).tolist()]) for x in (a, b, np.unique(near))]))
        size, at = np.array([len(a), len(b), len(near)]), np.array([0, 0, 1])
        to = np.array([1, 2, 2])
        assert items.may_be(keys, at, to, size[at], size[to], 80).tolist() == [False, True, False], sizes
