"""Quality rules by cross-document line frequency [native].

Lines are normalised and hashed, and for each host (the ``source`` column) the documents that have a line
are counted. A line in more documents than the limit is removed from all of them but the first, and a
document that this leaves with too few words is rejected, as are those that fail the plain rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, read, saved, split_skew

#: The plain rules: fewest words, and the greatest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT_WINDOW = 20, 30, 8
#: A line is boilerplate in over LINE_DOCS documents of a host.
LINE_DOCS = 20
#: A document is depleted with fewer words left than LEAST_WORDS or than this share of its words.
LEAST_LEFT = 0.1


def squeezed(line: Column) -> Column:
    """A line without white space at its ends and with one space between words; empty if it is blank."""
    return F.trim(F.regexp_replace(line, SPACE_CLASS + "+", " "))


def line_hash(bare: Column) -> Column:
    """The hash of a squeezed line in lower case."""
    return F.xxhash64(F.lower(bare))


def n_words(bare: Column) -> Column:
    """How many words a squeezed text has."""
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def _next(h: Column, by: int) -> Column:
    """A hash for each two values of ``h`` that stand ``by`` places apart."""
    n = F.size(h) - by
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


#: Words that repeated windows cover, from the array ``__h`` of window hashes: windows are sorted with their places, those
#: equal to a neighbour are put back in order, and each adds the words that the one before has not covered.
_REPEATED = f"""
transform(array(array_sort(transform(__h, (x, i) -> named_struct('h', x, 'i', i)))), s ->
 transform(array(array_sort(transform(filter(s, (e, k) -> (k > 0 and s[k - 1].h = e.h) or (k < size(s) - 1 and s[k + 1].h = e.h)), e -> e.i))), p ->
  aggregate(p, named_struct('last', -{REPEAT_WINDOW}, 'n', 0), (a, q) -> named_struct('last', q, 'n', a.n + least({REPEAT_WINDOW}, q - a.last)), a -> a.n)
 )[0])[0]
"""


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``line_words``: hash and number of words of each line that has any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("__l", F.split(text, "\n", -1))
    out = out.withColumn("__q", F.transform("__l", squeezed)).withColumn("__j", F.array_join(F.filter("__q", lambda q: q != ""), " "))
    out = out.withColumn("n_words", n_words(F.col("__j")).cast("long"))
    # windows of 8 words from pairs of pairs of pairs
    hashes = F.transform(F.split("__j", " ", -1), lambda w: F.xxhash64(w))
    out = out.withColumn("__h", F.when(F.col("n_words") >= REPEAT_WINDOW, hashes))
    for step in (1, 2, 4):
        out = out.withColumn("__h", _next(F.col("__h"), step))
    out = out.withColumn("__d", F.filter(F.zip_with("__l", "__q", lambda x, q: F.when(q != "", x)), lambda x: x.isNotNull()))
    per_line = F.transform(F.filter("__q", lambda q: q != ""), lambda q: F.struct(line_hash(q).alias("h"), n_words(q).alias("n")))
    repeated = F.when(F.col("__h").isNull() | (F.size(F.array_distinct("__h")) == F.size("__h")), F.lit(0)).otherwise(F.expr(_REPEATED))
    return out.select(
        *docs.columns,
        "n_words",
        (F.length("__j") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long").alias("word_chars"),
        (F.length("__j") - F.length(F.regexp_replace("__j", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("__d") - F.size(F.array_distinct("__d"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        per_line.alias("line_words"),
    )


def _judged(docs: DataFrame, line_docs: int, least_left: float) -> DataFrame:
    """The columns of verdicts(), and host, mark (a hash of the text) and gone, the hashes of the lines that the row loses (null for none)."""
    split_skew(docs.sparkSession)
    narrow = docs.select("doc_id", "text", F.col("source").alias("host"), F.xxhash64("text").alias("mark"))
    base = saved(measures(narrow).drop("text").withColumn("row", F.monotonically_increasing_id()), "quality")
    each = base.select("host", "doc_id", F.explode(F.array_distinct(F.transform("line_words", lambda x: x["h"]))).alias("h"))
    # documents, not rows: the rows of most lines are few and all have one doc_id, so only lines with more are counted
    many = each.groupBy("host", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > line_docs)
    many = saved(many.select(F.col("host").alias("host_"), F.col("h").alias("h_"), "first"), "frequent-lines")
    same = (each["h"] == many["h_"]) & each["host"].eqNullSafe(many["host_"])
    common = each.join(many, same).groupBy("host_", "h_", "first", "doc_id").count().groupBy("host_", "h_", "first").agg(F.count("doc_id").alias("n")).where(F.col("n") > line_docs)
    held = base.select("row", "host", "doc_id", F.explode("line_words").alias("x")).select("row", "host", "doc_id", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    common = saved(common.drop("n"), "common-lines", [many])
    met = (held["h"] == common["h_"]) & held["host"].eqNullSafe(common["host_"]) & ~held["doc_id"].eqNullSafe(common["first"])
    lost = held.join(common, met).groupBy("row").agg(F.sum("n").alias("lost"), F.collect_set("h").alias("gone"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = base.drop("line_words").join(lost, "row", "left").withColumn("n_left", left).withColumn("base_failed", failed)
    depleted = F.col("lost").isNotNull() & ((F.col("n_left") < LEAST_WORDS) | (F.col("n_left") < least_left * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def verdicts(docs: DataFrame, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left and row, an id of the row.

    Null and empty texts have no words and fail the plain rules; a null host is a host like others; of rows
    that repeat a doc_id each is judged, but they are one document where documents with a line are counted (null
    ones are none); an empty table gives no rows; other columns are ignored. The first document of a host
    (smallest doc_id) keeps a line that the others lose. Counts are summed before they
    are shuffled, so a line or host with a third of all rows is no hot key; the lines are then joined with
    the lines above the limit by an ordinary join, which adaptive execution splits.
    """
    return _judged(docs, line_docs, least_left).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left", "row"
    )


def keep_good(docs: DataFrame, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The documents that pass, their texts without the lines above the limit; blank lines and all other columns stay.

    Each row is judged for itself, also where doc_ids are null or repeated. A row is found again by doc_id, host and
    the hash of its text, which settle both its verdict and what it loses; so texts are shuffled once.
    """
    judged = _judged(docs, line_docs, least_left).where("kept")
    judged = judged.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone"))
    keep = saved(judged.dropDuplicates(["__id", "__host", "__mark"]), "verdicts")
    met = docs["doc_id"].eqNullSafe(keep["__id"]) & docs["source"].eqNullSafe(keep["__host"]) & (F.xxhash64(docs["text"]) == keep["__mark"])
    stays = F.filter(F.split(docs["text"], "\n", -1), lambda x: (squeezed(x) == "") | ~F.array_contains(keep["__gone"], line_hash(squeezed(x))))
    text = F.when(keep["__gone"].isNull(), docs["text"]).otherwise(F.array_join(stays, "\n"))
    return docs.join(keep, met).select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(read(spark, sf_dir, "documents")).drop("row")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
 list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, host, regexp_replace(lower(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM (SELECT doc_id, host, unnest(ls) AS x FROM w)),
common AS (SELECT host, x, min(doc_id) AS first_doc FROM ln GROUP BY host, x HAVING count(DISTINCT doc_id) > 20),
lost AS (SELECT ln.doc_id, sum(len(string_split(ln.x, ' '))) AS lost FROM ln JOIN common USING (host, x) WHERE ln.doc_id <> first_doc GROUP BY ln.doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, lost.lost AS lost
 FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(n_words - coalesce(lost, 0) AS BIGINT) AS n_left FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (lost IS NOT NULL AND (n_left < 20 OR n_left < 0.1 * n_words)) AS kept, n_left FROM f
"""
