"""Personal data by bootstrapped contextual extraction [native].

Plain patterns give seed entities. The words to the left of the seeds are lexical patterns; Spark scores
patterns and the identifiers that they introduce against each other, as a bipartite graph, for a few rounds:
a pattern is as good as the identifiers it introduces, an identifier as good as its patterns. Patterns of high
confidence then mark identifiers that no plain pattern finds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved

KINDS = ["email", "ip", "card", "phone"]
#: The plain patterns, written so that a run of characters is walked once: they start where such a run does (or where the last match
#: ended) and do not give back. The matches are those of the simple forms.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: a run of these characters with at least MIN_DIGITS digits.
IDENTIFIER = r"(?<![A-Za-z0-9._@+/-])(?=[A-Za-z._@+/-]*+[0-9])[A-Za-z0-9._@+/-]++"
MIN_DIGITS = 4
#: A pattern is the last LEFT words before an identifier, with the characters between; LEFT_CHARS are looked at.
LEFT, LEFT_CHARS = 2, 60
#: Rounds of scoring; a trusted pattern introduces at least SUPPORT different seeds and has at least CONFIDENCE; an
#: identifier is accepted with at least ACCEPT.
ROUNDS, SUPPORT, CONFIDENCE, ACCEPT = 3, 5, 0.8, 0.8
#: Matches of one text that are walked at once.
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, empty: Column, step: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """The last state (at, out) of a walk over ``items`` from (``start``, ``empty``), where ``step`` appends to the array ``out``.

    An append copies the array, so the walk goes block by block: n items cost about n * (BLOCK + n / BLOCK) copies, not n * n.
    """

    def walk(z: Column) -> Column:
        one = lambda at, b: F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), F.struct(at.alias("at"), empty.alias("out")), step)
        return F.aggregate(
            F.sequence(F.lit(0), F.greatest((F.size(z) - 1) / BLOCK, F.lit(0)).cast("int")),
            F.struct(F.lit(start).alias("at"), empty.alias("out")),
            lambda acc, b: _let(one(acc["at"], b), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out"))),
        )

    return _let(items, walk)


def apart(others: Column, taken: Column) -> Column:
    """The ``others`` (start, end, value, left) that overlap none of ``taken`` (start, end): one walk up and one down."""
    kind = "struct<start: int, own: boolean, end: int, value: string, left: string>"
    none = F.expr(f"cast(array() as array<{kind}>)")
    row = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), (x["value"] if own else F.lit(None).cast("string")).alias("value"), (x["left"] if own else F.lit(None).cast("string")).alias("left"))
    every = F.array_sort(F.concat(F.transform(taken, lambda x: row(x, False)), F.transform(others, lambda x: row(x, True))))
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    # up: at is the greatest end of what is taken so far; down: at is the start of the last one taken
    up = lambda acc, x: F.when(~x["own"], state(F.greatest(acc["at"], x["end"]), F.concat(acc["out"], F.array(x)))).otherwise(F.when(x["start"] < acc["at"], acc).otherwise(state(acc["at"], F.concat(acc["out"], F.array(x)))))
    down = lambda acc, x: F.when(~x["own"], state(x["start"], acc["out"])).otherwise(F.when(acc["at"] < x["end"], acc).otherwise(state(acc["at"], F.concat(acc["out"], F.array(x)))))
    left = folded(F.reverse(folded(every, none, up)["out"]), none, down, (1 << 31) - 1)["out"]
    left = F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left")))
    return F.when((F.size(others) == 0) | (F.size(taken) == 0), others).otherwise(left)


def found(text: Column, pattern: str, guard: Column) -> Column:
    """start, end (code points, end exclusive), value and left (what stands before, up to the last match) of each match."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, value: string, left: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["h"])
        left = F.when(F.length(x["p"]) > LEFT_CHARS, F.substring(x["p"], -LEFT_CHARS, LEFT_CHARS)).otherwise(x["p"])
        match = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("value"), left.alias("left"))
        return F.when(x["h"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(match)).alias("out")))

    walked = folded(F.arrays_zip(pieces.alias("p"), hits.alias("h")), empty, step)["out"]
    return F.when(guard & F.coalesce(text.rlike(pattern), F.lit(False)), walked).otherwise(empty)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.transform(each, lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def _long(c: Column, low: int, high: int) -> Column:
    n = F.length(_digits(c))
    return (n >= low) & (n <= high)


def with_base(docs: DataFrame) -> DataFrame:
    """Adds an array of start, end, value and left for each kind (b_email, b_ip, b_card, b_phone) and the possible identifiers (others)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    octets = lambda v: F.forall(F.split(v, r"\."), lambda o: (F.length(F.ltrim(o, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(o, F.lit("0")), 3, "0") <= "255"))
    raw = docs.withColumns(
        {
            "b_email": found(text, EMAIL, F.contains(text, F.lit("@"))),
            "b_ip": found(text, IP, digit),
            "b_card": found(text, CARD, digit),
            "b_phone": found(text, PHONE, F.contains(text, F.lit("+"))),
            "others": found(text, IDENTIFIER, digit),
        }
    )
    return raw.withColumns(
        {
            "b_ip": F.filter("b_ip", lambda x: octets(x["value"])),
            "b_card": F.filter("b_card", lambda x: F.when(_long(x["value"], 13, 19), _luhn(_digits(x["value"]))).otherwise(False)),
            "b_phone": F.filter("b_phone", lambda x: _long(x["value"], 9, 15)),
            "others": F.filter("others", lambda x: F.length(_digits(x["value"])) >= MIN_DIGITS),
        }
    )


def _context(left: Column) -> Column:
    """The last words before an identifier, lower case, digits as 0; null if there are fewer."""
    tail = F.regexp_extract(F.lower(left), rf"(?:^|\s)((?:\S+\s+){{{LEFT - 1}}}\S+\s*)$", 1)
    shape = F.regexp_replace(F.regexp_replace(tail, r"[0-9]+", "0"), r"\s+", " ")
    return F.when(shape != "", shape)


def _shape(value: Column) -> Column:
    """How an identifier looks: runs of digits and letters as 0 and a."""
    return F.regexp_replace(F.regexp_replace(value, r"[0-9]+", "0"), r"[A-Za-z]+", "a")


def _of_kind(kind: str, *fields: str) -> Column:
    """The plain matches of a kind as structs of ``fields``, of which ``kind`` is the kind itself."""
    return F.transform(f"b_{kind}", lambda x: F.struct(*[F.lit(kind).alias(f) if f == "kind" else x[f].alias(f) for f in fields]))


def spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, mark (hash of the text), the arrays of plain matches (b_email, b_ip, b_card, b_phone) and ``more``: start and end with kind of what the patterns discover.

    Null texts count as empty; rows that repeat a doc_id stay; an empty table gives no rows; other columns are ignored.
    """
    base = saved(with_base(docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))).drop("text").withColumn("row", F.monotonically_increasing_id()), "entities")
    seeds = base.select("row", F.explode(F.concat(*[_of_kind(k, "kind", "start", "end", "value", "left") for k in KINDS])).alias("x"))
    seeds = seeds.select("row", "x.*")
    taken = F.concat(*[F.transform(f"b_{k}", lambda x: F.struct(x["start"], x["end"])) for k in KINDS])
    free = base.withColumn("taken", taken).select("row", F.explode(apart(F.col("others"), F.col("taken"))).alias("x"))
    free = free.select("row", F.lit(None).cast("string").alias("kind"), "x.*")
    met = saved(seeds.union(free).select("row", "kind", "start", "end", "value", _context(F.col("left")).alias("pattern")).where("pattern IS NOT NULL"), "contexts")

    # the graph: pattern - identifier, each pair once, whatever the number of copies of a text
    graph = met.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    by_kind = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    # the kind of most seeds; of equal ones the first of KINDS
    kind = F.greatest(*[F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])["kind"]
    trusted = graph.groupBy("pattern").agg(F.count("kind").alias("seeds"), *by_kind).where(F.col("seeds") >= SUPPORT).select("pattern", kind.alias("kind_"))
    graph = saved(graph.join(trusted, "pattern").select("pattern", "value", "kind_", F.when(F.col("kind") == F.col("kind_"), 1.0).otherwise(0.0).alias("seed")), "pattern-graph")
    scores = graph.groupBy("value", "kind_").agg(F.max("seed").alias("score"))
    for _ in range(ROUNDS):
        patterns = graph.join(scores, ["value", "kind_"]).groupBy("pattern", "kind_").agg(F.avg(F.greatest("seed", "score")).alias("confidence"))
        scores = graph.join(patterns, ["pattern", "kind_"]).groupBy("value", "kind_").agg(
            F.greatest(F.max("seed"), 1 - F.exp(F.sum(F.log(1 - F.least(F.lit(0.999), F.when(F.col("confidence") >= CONFIDENCE / 2, F.col("confidence")).otherwise(0.0)))))).alias("score")
        )
        scores = saved(scores, "identifier-scores")
    good = patterns.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind_")
    accepted = graph.where("seed = 0").join(good, ["pattern", "kind_"]).join(scores.where(F.col("score") >= ACCEPT), ["value", "kind_"]).select("pattern", "value", "kind_").distinct()
    new = met.where("kind IS NULL").join(accepted, ["pattern", "value"]).groupBy("row").agg(F.collect_set(F.struct(F.col("kind_").alias("kind"), "start", "end")).alias("more"))
    return base.drop("others").join(new, "row", "left").withColumn("more", F.coalesce("more", F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")))


def _ordered(*arrays: Column) -> Column:
    """kind, start, end in the order of the kinds, then of starts; arrays have rank, kind, start, end."""
    return F.transform(F.array_sort(F.concat(*arrays)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))


def _ranked(column: str, kind: Column, rank: Column) -> Column:
    return F.transform(column, lambda x: F.struct(rank.alias("rank"), x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain matches), base_sha256 of those, and spans, all with what was discovered."""
    base = [_ranked(f"b_{k}", F.lit(k), F.lit(i)) for i, k in enumerate(KINDS)]
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int") - 1
    more = F.transform("more", lambda x: F.struct(rank(x).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return spans(docs).select(
        "doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(_ordered(*base), ","), 256).alias("base_sha256"),
        F.array_join(_ordered(*base, more), ",").alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in angle brackets; overlapping spans are one, named after the first.

    All columns stay, also where their names clash with inner ones, and all rows; null texts stay null; an empty table gives no rows.
    """
    every = F.concat(*[_of_kind(k, "start", "end", "kind") for k in KINDS], F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    hit = spans(docs).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.array_sort(every).alias("__spans")).where(F.size("__spans") > 0)
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes
    of = {c: docs[f"c{i}"] for i, c in enumerate(names)}
    both = docs.join(hit.dropDuplicates(["__id", "__mark"]), of["doc_id"].eqNullSafe(hit["__id"]) & (F.xxhash64(of["text"]) == hit["__mark"]), "left")
    text = of["text"]
    empty = F.expr("cast(array() as array<struct<a: int, b: int, kind: string>>)")

    def step(acc: Column, x: Column) -> Column:  # what stays lies between the end of one span and the start of the next
        kept = F.struct(acc["at"].alias("a"), x["start"].alias("b"), x["kind"].alias("kind"))
        return F.when(x["start"] < acc["at"], F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(kept)).alias("out"))
        )

    def block(z: Column, b: Column) -> Column:
        """A stretch of text for BLOCK spans, so that no substring is looked for from the start of the text."""
        some = F.slice(z, b * BLOCK + 1, F.lit(BLOCK))
        cut = lambda v, seg: F.transform(v, lambda x: F.concat(F.substr(seg, x["a"] - v[0]["a"] + 1, x["b"] - x["a"]), F.lit("<"), x["kind"], F.lit(">")))
        return _let(some, lambda v: _let(F.substr(text, v[0]["a"] + 1, F.element_at(v, -1)["b"] - v[0]["a"]), lambda seg: F.array_join(cut(v, seg), "")))

    blocks = lambda z: F.transform(F.sequence(F.lit(0), ((F.size(z) - 1) / BLOCK).cast("int")), lambda b: block(z, b))
    cut = _let(folded(F.col("__spans"), empty, step), lambda x: F.concat(F.array_join(_let(x["out"], blocks), ""), F.substr(text, x["at"] + 1)))
    return both.select(*[F.when(F.col("__spans").isNull(), text).otherwise(cut).alias("text") if c == "text" else of[c].alias(c) for c in names])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
