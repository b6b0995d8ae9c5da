"""How far the sources of a language lie apart in their terms, and which terms set a source apart.

Tasks count the terms of their documents by group (language and source) before anything is shuffled. A language keeps
the terms of enough documents; each group has a smoothed share of each kept term, in billionths. The distance of two
groups is the sum over all kept terms of the difference of their shares, by rows as Gustavson multiplies matrices: the
counts lie by term, and each group of a term scatters its difference into its dense row of sums, one for each peer. No
pair of postings becomes a row. What a group or peer lacks has the share of a count of 0, which is one number for each
group: those differences are put in beforehand, as if all counts were 0, and each posting corrects them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, saved, small_batches

#: What a term is in UTF-8: letters and every byte of a character beyond 7F; only A-Z change case, all other bytes part terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LEAST_DOCS, SMOOTH, BILLION, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Counts that a task keeps before it hands them on; bytes of a text that are searched at once.
MOST_HELD, BLOCK = 1_000_000, 1 << 20
#: Sources in a tile of the accumulator (an array of TILE * TILE longs), postings in a block of terms (at least: as many as the
#: tile has sums), groups of a term that scatter at once.
TILE, BLOCK_POSTINGS, ROWS = 512, 1 << 15, 64


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, block by block; a block ends where no term goes on."""
    text, at = text.translate(TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count and docs (documents of the group with the term), summed inside tasks; a group's rows with a null term hold its documents."""
    small_batches(docs.sparkSession, 2000)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = {}
        within: dict[tuple[str, str], Counter] = {}
        seen: Counter = Counter()
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for group, every in counts.items():
                some, names = within[group], list(every)
                for i in range(0, len(names), 50_000):
                    part = names[i : i + 50_000]
                    yield batch(group, [x.decode() for x in part], [every[x] for x in part], [some[x] for x in part])
            for group, n in seen.items():
                yield batch(group, [None], [0], [n])

        def batch(group: tuple[str, str], names: list, every: list[int], some: list[int]) -> pa.RecordBatch:
            columns = [pa.array([g] * len(names), pa.string()) for g in group] + [pa.array(names, pa.string()), pa.array(every, pa.int64()), pa.array(some, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

        for b in batches:
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                group = (lang, source)
                seen[group] += 1
                every, some = counts.setdefault(group, Counter()), within.setdefault(group, Counter())
                held -= len(every)
                mine: set[bytes] = set()
                for found in text_terms(text):
                    every.update(found)
                    mine.update(found)
                some.update(mine)
                held += len(every)
                if held > MOST_HELD:
                    yield from rows()
                    counts, within, seen, held = {}, {}, Counter(), 0
        yield from rows()

    return own.mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(BILLION * (count + SMOOTH) / (total + SMOOTH * kept)), in whole numbers of any size."""
    top = (count + SMOOTH).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.when(kept > 0, _div(top, (total + SMOOTH * kept).cast("decimal(20,0)")) + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _scattered(postings: DataFrame) -> DataFrame:
    """lang, low, high, a, peers: for each tile of the accumulator and each group ``a`` of its rows, the correction of each of its peers, by place.

    postings: lang, block (of terms), low and high (tiles of rows and columns), term, a (place of the group), p, zero (p of a count of
    0). The postings of a term stand together, so a term is two short arrays, and a task holds one tile.
    """

    def tile(t: pa.Table, lang: str, low: int, high: int) -> pa.RecordBatch:
        start, a, p, zero = (t.column(c).to_numpy() for c in ("start", "a", "p", "zero"))
        cuts = np.append(np.flatnonzero(start), len(start))
        total = np.zeros((TILE, TILE), np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows, columns = np.flatnonzero(a[i:j] // TILE == low) + i, np.flatnonzero(a[i:j] // TILE == high) + i
            peers, q, base = a[columns] - high * TILE, p[columns], zero[columns]
            for k in range(0, len(rows), ROWS):  # each group of the term scatters into its row of sums
                r = rows[k : k + ROWS, None]
                total[a[r] - low * TILE, peers] += np.abs(p[r] - q) - np.abs(p[r] - base) - np.abs(zero[r] - q) + np.abs(zero[r] - base)
        used = np.unique(a[a // TILE == low])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array([high] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(total[used - low * TILE].tolist(), pa.list_(pa.int64()))],
            names=["lang", "high", "a", "peers"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            t = pa.Table.from_batches([b])
            keys = list(zip(*(t.column(c).to_pylist() for c in ("lang", "block", "low", "high")), strict=True))
            term = t.column("term").to_pylist()
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and keys[i] != last[0]:
                    yield tile(pa.concat_tables(held), last[0][0], *last[0][2:])
                    held, last = [], None
                start = [term[x] != (term[x - 1] if x > i else last[1] if last else None) for x in range(i, j)]
                held.append(t.slice(i, j - i).select(["a", "p", "zero"]).append_column("start", pa.array(start)))
                last = (keys[i], term[j - 1])
        if last is not None:
            yield tile(pa.concat_tables(held), last[0][0], *last[0][2:])

    return postings.mapInArrow(run, "lang string, high int, a int, peers array<long>")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source lies from the others of its language, and its foremost terms.

    Null texts, languages and sources are ''. Part ``pair``: item is each other source of the language, value the sum
    over all kept terms of the difference of shares (0 if none is kept), all ranks. Part ``term``: item is each kept term of the
    group whose share is above the language's, value the difference, ranks up to ``top``. Ties go by item in UTF-8. Every row is a
    document, repeated ones too. An empty table gives no rows; other columns are ignored.
    """
    counted = saved(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "group-terms")
    terms = counted.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("count").alias("all"), F.sum("docs").alias("docs"), F.count("*").alias("groups")).where(F.col("docs") >= least_docs).drop("docs")
    kept = saved(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("all_total"), F.sum("groups").alias("postings"))
    held = terms.drop("docs").join(kept.select("lang", "term", "all"), ["lang", "term"])
    totals = held.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counted.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    # places of the sources of a language: a window over its groups, which the result holds squared
    groups = groups.withColumn("a", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = saved(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "term-groups")
    rows = held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("total"), F.col("kept"))).withColumn("q", share(F.col("all"), F.col("all_total"), F.col("kept")))
    rows = saved(rows.select("lang", "source", "term", "a", "p", "zero", "q", "postings"), "postings")

    over = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    # each posting goes to the tiles of its row and of its column; with up to TILE sources that is one
    tiles = F.floor(F.col("sources") / TILE).cast("int")
    many = groups.groupBy("lang").agg(F.max("a").alias("sources"))
    own = F.floor(F.col("a") / TILE).cast("int")
    placed = rows.join(many, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("postings") / F.greatest(F.lit(BLOCK_POSTINGS), F.pow(F.least("sources", F.lit(TILE)), 2)))))
    each = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), tiles), lambda x: F.array(F.struct(own.alias("low"), x.alias("high")), F.struct(x.alias("low"), own.alias("high"))))))
    placed = placed.select("lang", "block", "term", "a", "p", "zero", F.explode(each).alias("at")).select("lang", "block", "at.low", "at.high", "term", "a", "p", "zero")
    placed = placed.repartition("lang", "block", "low", "high").sortWithinPartitions("lang", "block", "low", "high", "term", "a")
    corrections = _scattered(placed).select("lang", "a", "high", F.posexplode("peers").alias("at", "v")).where("v <> 0")
    corrections = corrections.groupBy("lang", "a", (F.col("high") * TILE + F.col("at")).alias("b")).agg(F.sum("v").alias("both"))

    # with one side's counts all 0: what a group's terms add to each of its peers, which differ in one number only
    alone = _alone(rows, groups)
    pairs = groups.select("lang", "source", "a", "zero", "kept").join(groups.select("lang", F.col("source").alias("item"), F.col("a").alias("b"), F.col("zero").alias("zero_b")), "lang").where("a <> b")
    pairs = pairs.join(corrections, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left")
    pairs = pairs.join(alone.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("one").alias("other")), ["lang", "a", "b"], "left")
    value = F.col("kept") * F.abs(F.coalesce(F.col("zero") - F.col("zero_b"), F.lit(0))) + sum(F.coalesce(c, F.lit(0)) for c in ("both", "one", "other"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(over.withColumn("value", F.col("value").cast("long")))


def _alone(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, one: the sum over the terms of group a of |p - zero of b| - |zero of a - zero of b|, the baseline of what only a has.

    As p >= zero of a, a term adds p - zero of a, less twice what of it lies below zero of b: a step for each peer whose zero
    is greater. So a's terms are cut at the zeros of its peers, and running sums give all peers at once.
    """
    peers = groups.select("lang", F.col("a").alias("b"), F.col("zero").alias("at"))
    # (number, sum) of a's terms by the first zero that is not less than p; a term above all zeros stands behind the last
    zeros = peers.select("lang", "at").distinct().groupBy("lang").agg(F.sort_array(F.collect_set("at")).alias("zeros"))
    place = F.expr("aggregate(zeros, 0, (n, z) -> n + IF(z < p, 1, 0))")
    cut = rows.join(zeros, "lang").groupBy("lang", "a", place.alias("k")).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.first("zero").alias("zero"))
    cut = cut.groupBy("lang", "a").agg(F.first("zero").alias("zero"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", "s")))).alias("cuts"))
    both = cut.join(peers.join(zeros, "lang").withColumn("k", F.expr("array_position(zeros, at) - 1")).drop("zeros"), "lang").where("a <> b")
    under = F.expr("aggregate(map_entries(cuts), struct(0L AS n, 0L AS s), (x, e) -> IF(e.key <= k, struct(x.n + e.value.n AS n, x.s + e.value.s AS s), x))")
    both = both.withColumn("u", under)
    # terms with p <= at: at - p; the others: p - at
    one = (F.col("s") - F.col("u.s") - F.col("at") * (F.col("n") - F.col("u.n"))) + (F.col("at") * F.col("u.n") - F.col("u.s")) - F.col("n") * F.abs(F.col("zero") - F.col("at"))
    return both.select("lang", "a", "b", one.alias("one"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and foremost terms of all sources of ``documents``."""
    return divergence(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5)) // (n.n + 5 * l.v) AS p,
 1 + (CAST(1000000000 AS HUGEINT) * (k.c + 5)) // (l.n + 5 * l.v) AS q
 FROM n JOIN k ON n.lang = k.lang JOIN l ON l.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS INTEGER) AS rank
FROM p WHERE c > 0 AND p > q QUALIFY rank <= 50
"""
