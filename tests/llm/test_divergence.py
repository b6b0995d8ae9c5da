"""Source divergence against plain loops, over more sources than a tile holds and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callgrid.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        groups = defaultdict(Counter)
        for _, s, terms in mine:
            groups[s].update(t for t in terms if df[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        shares = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s, p in shares.items():
            pairs = sorted(((-sum(abs(p[t] - o[t]) for t in kept), x.encode()) for x, o in shares.items() if x != s))
            out += [(lang, s, "pair", x.decode(), -v, i) for i, (v, x) in enumerate(pairs, 1)]
            over = sorted((q[t] - p[t], t.encode()) for t in kept if groups[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, "term", x.decode(), -v, i) for i, (v, x) in enumerate(over, 1)]
    return Counter(out)


def corpus(n, sources, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["École", "ΣΑΣ", "日本語", "don't", "x-ray", "A1b2C3"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25))), rng.choice(["en", "fr", None]), rng.choice(sources)) for i in range(n)]
    return [*rows, (None, None, None, None), (1, "", "en", "only"), (2, "ONE one One", "it", "s"), (3, "a b", "xx", "s1"), (4, "a b", "xx", "s2"), (5, "wa " * 500_000, "en", "long"), rows[0], rows[0], (6, "\x00\x7f12 34", "en", "none")]


@pytest.mark.parametrize("tile", [2, 3, 512])
def test_divergence(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 40)
    rows = corpus(300, ["s0", "s0", "s0", "s1", "s2", "Ä", None, "zz"], tile)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("a", F.lit("x")).repartition(4)
    got = Counter(tuple(r) for r in divergence.divergence(df, 5, 7).collect())
    assert got == brute(rows, 5, 7)


def test_divergence_flushes_and_empties(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_HELD", 50)
    monkeypatch.setattr(divergence, "BLOCK", 16)
    rows = corpus(60, ["a", "b"], 9)[:-4]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    assert Counter(tuple(r) for r in divergence.divergence(df, 3, 50).collect()) == brute(rows, 3, 50)
    # no term is kept: all distances are 0, ties go by name
    few = divergence.divergence(df, 1000).collect()
    assert few and all(r["value"] == 0 and r["part"] == "pair" for r in few)
    assert divergence.divergence(df.limit(0)).collect() == []
