"""Findings: what the subject modules report beyond their limits, as one ranked table.

Each part is a table of category, title, subject, severity and detail; ``ranked`` keeps the gravest row of each title.
The rows that parts read are the calls of their caller, written once, so that the source is read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch
from ..sources.scratch import saved
from . import behaviour, graph, modules
from . import movement as m
from .attribution import session_gaps
from .movement import by_subject
from .reports import owned

#: The weights that rank severities.
SEVERITY = {"Critical": 100, "High": 75, "Medium": 50, "Low": 25, "Info": 5}
#: Bridges of the call graph that are findings, the heaviest first.
BRIDGES = 3


def _share(new: Column, old: Column) -> Column:
    """By how many percent ``new`` is over ``old``."""
    return (new / F.greatest(old, F.lit(0.001)) - 1) * 100


def shift_marks(rows: DataFrame, least: int = 10, share: float = 0.6) -> DataFrame:
    """subject, type, value, severity: what changed from the first 60 % of a subject's rows (of ten or more) to the rest.

    Activity by over 75 % (High over 200 %), five or more new contacts (High from ten, if they are half of the recent
    ones), three or more contacts gone, the share of the night (22 to 6) by over 0.2, the mean duration by over 80 %.
    A missing duration counts as 0, a missing contact not at all.
    """
    n = F.count("*").over(Window.partitionBy("subject"))
    r = rows.withColumn("i", F.row_number().over(by_subject())).withColumn("n", n).where(F.col("n") >= least)
    r = r.select("subject", "b_party_number", epoch("start_time").alias("t"), F.coalesce("duration_seconds", F.lit(0)).alias("d"), ((F.hour("start_time") >= 22) | (F.hour("start_time") < 6)).cast("int").alias("night"), (F.col("i") > F.floor(F.col("n") * share)).alias("new"))
    new, old = F.col("new"), ~F.col("new")
    rate = lambda c: F.count_if(c) / F.greatest((F.max(F.when(c, F.col("t"))) - F.min(F.when(c, F.col("t")))) / 3600, F.lit(1.0))
    part = lambda c, x: F.avg(F.when(c, F.col(x)))
    g = r.groupBy("subject").agg(
        F.round(_share(rate(new), rate(old)), 1).alias("activity"), F.count_if(old).alias("n0"), F.count_if(new).alias("n1"),
        (part(new, "night") - part(old, "night")).alias("night"), _share(part(new, "d"), part(old, "d")).alias("duration"),
    )
    seen = r.where("b_party_number IS NOT NULL").groupBy("subject", "b_party_number").agg(F.max("new").alias("late"), F.max(old).alias("early"))
    c = seen.groupBy("subject").agg(F.count_if(F.col("late") & ~F.col("early")).alias("gained"), F.count_if(~F.col("late")).alias("dropped"), F.count_if("late").alias("recent"))
    g = g.join(c, "subject", "left").na.fill(0, ["gained", "dropped", "recent"])
    surge = (F.col("gained") >= 10) & (F.col("gained") >= 0.5 * F.greatest(F.col("recent"), F.lit(1)))
    mark = lambda kind, value, when, severity: F.when(when, F.struct(F.lit(kind).alias("type"), F.round(value.cast("double"), 3).alias("value"), severity.alias("severity")))
    activity, night, duration = F.col("activity"), F.col("night"), F.col("duration")
    marks = F.array(
        mark("Activity Level Change", activity, F.abs(activity) > 75, F.when(F.abs(activity) > 200, "High").otherwise("Medium")),
        mark("New Contact Surge", F.col("gained"), F.col("gained") >= 5, F.when(surge, "High").otherwise("Medium")),
        mark("Contact Drop-off", F.col("dropped"), F.col("dropped") >= 3, F.lit("Medium")),
        mark("Time-of-Day Pattern Shift", night, (F.col("n0") >= 5) & (F.col("n1") >= 5) & (F.abs(night) > 0.2), F.lit("Medium")),
        mark("Call Duration Shift", duration, F.abs(duration) > 80, F.lit("Low")),
    )
    return g.select("subject", F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("m")).select("subject", "m.*")


def first_gaps(rows: DataFrame, minutes: int = 120, n: int = 10) -> DataFrame:
    """A subject's first ten silences of two hours or more, with the contact before and after each."""
    w = by_subject()
    g = rows.select("subject", "id", "start_time", F.lag("start_time").over(w).alias("from"), F.lag("b_party_number").over(w).alias("before"), F.col("b_party_number").alias("after"))
    g = g.withColumn("minutes", F.round((epoch("start_time") - epoch("from")) / 60, 1)).where((epoch("start_time") - epoch("from")) >= minutes * 60)
    i = F.row_number().over(Window.partitionBy("subject").orderBy("start_time", "id"))
    return g.withColumn("i", i).where(F.col("i") <= n).select("subject", F.col("i").cast("long").alias("i"), "minutes", "before", "after")


def gap_marks(silences: DataFrame) -> DataFrame:
    """subject, kind, severity of ``modules.silences``: away (over 720 h, High), quiet (over 168 h), frequent (over ten gaps)."""
    longest = F.round("longest", 1)
    kinds = F.array(F.when(longest > 720, "away").when(longest > 168, "quiet"), F.when(F.col("gaps") > 10, "frequent"))
    out = silences.select("subject", "gaps", "longest", F.explode(F.array_compact(kinds)).alias("kind"))
    return out.withColumn("severity", F.when(F.col("kind") == "away", "High").otherwise("Medium"))


def call_marks(details: DataFrame, bursts: DataFrame) -> DataFrame:
    """subject, kind, n: over three calls under 5 s, over three between 0 and 5 o'clock, any burst."""
    n = bursts.groupBy("subject").agg(F.count("*").alias("bursts"))
    d = details.join(n, "subject", "left").na.fill(0, ["bursts"])
    mark = lambda kind, c, least: F.when(F.col(c) > least, F.struct(F.lit(kind).alias("kind"), F.col(c).alias("n")))
    marks = F.array_compact(F.array(mark("short", "short", 3), mark("odd_hours", "small_hours", 3), mark("bursts", "bursts", 0)))
    return d.select("subject", F.explode(marks).alias("m")).select("subject", "m.*")


def shared_devices(rows: DataFrame) -> DataFrame:
    """subject and sims: the most SIMs that it used in one handset, where over one."""
    per = rows.where("imei IS NOT NULL AND imsi IS NOT NULL").groupBy("subject", "imei").agg(F.countDistinct("imsi").alias("sims"))
    return per.groupBy("subject").agg(F.max("sims").alias("sims")).where("sims > 1")


def _part(df: DataFrame, category: str, title: Column, severity: Column | str, detail: Column, where: str = "true") -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.where(where).select(F.lit(category).alias("category"), title.alias("title"), F.col("subject"), level.alias("severity"), detail.alias("detail"))


def _named(text: str) -> Column:
    return F.concat(F.lit(text), "subject")


def record_parts(cdr: DataFrame, towers: DataFrame) -> list[DataFrame]:
    """The parts that read a subject's records: identity, shifts, gaps, calls, initiative, contacts, places, sessions, hours."""
    keep = ["id", "a_party_number", "b_party_number", "msisdn", "call_type", "direction", "start_time", "duration_seconds", "tower_id", "imei", "imsi"]
    cdr = saved(cdr.select(*keep, *[c for c in ("case_id", "latitude", "longitude") if c in cdr.columns]), "evidence")
    rows = owned(cdr)
    deep, ids = behaviour.deep_identity(rows), behaviour.identity_report(rows)
    shifts, details = shift_marks(rows), modules.call_details(rows)
    pairs = modules.shared_contacts(cdr).withColumn("subject", F.col("a"))
    high = lambda c, over: F.when(F.col(c) > over, "High").otherwise("Medium")
    text = lambda *cs: F.concat_ws(" ", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in cs])
    return [
        _part(deep, "Identity", _named("Suspected burner identity: "), high("burner", 50), text(F.lit("burner score"), "burner"), "suspected"),
        _part(ids, "Identity", _named("SIM swap detected for "), "High", text(F.lit("changes of SIM:"), "swaps"), "swaps > 0"),
        _part(ids, "Identity", _named("Device change for "), "Medium", text(F.lit("changes of handset:"), "devices"), "devices > 0"),
        _part(shared_devices(rows), "Identity", _named("Multi-SIM usage: "), "Medium", text(F.lit("SIMs in one handset:"), "sims")),
        _part(deep, "Identity", _named("Device cycling: "), high("cycling", 60), text(F.lit("cycling score"), "cycling"), "cycling > 30"),
        _part(shifts, "Behavioral Shift", F.concat("type", F.lit(": "), "subject"), F.col("severity"), text(F.lit("by"), "value")),
        _part(gap_marks(modules.silences(rows)), "Network Gap", _named("Network disappearance: "), F.col("severity"), text("kind", F.lit("gaps:"), "gaps", F.lit("longest, hours:"), "longest")),
        _part(call_marks(details, modules.call_bursts(rows)), "Call Pattern", _named("Suspicious calling: "), "Medium", text("kind", "n")),
        _part(modules.dominance(cdr), "Organization", _named("Potential leader identified: "), "High", text(F.lit("initiates"), "made", F.lit("ratio"), "ratio"), "role = 'leader'"),
        _part(pairs, "Correlation", F.concat(F.lit("Linked subjects: "), "a", F.lit(" & "), "b"), "Medium", text(F.lit("shared contacts:"), "shared", F.lit("Jaccard"), "jaccard")),
        _part(modules.radius(m.streams(cdr, towers)), "Movement", _named("Wide operational range: "), "Medium", text("km", F.lit("km")), "km > 100"),
        _part(session_gaps(rows), "Session Pattern", _named("Gap-rich communication: "), "Medium", text(F.lit("gaps over a day:"), "over_24h"), "over_24h > 3"),
        _part(modules.time_profile(rows), "Behavioral", _named("Night-dominant activity: "), "Low", text("night", F.lit("% at night,"), "profile"), "night_owl"),
    ]


def network_parts(cdr: DataFrame) -> list[DataFrame]:
    """Brokers and hubs by structural role, and the heaviest bridges of the call graph."""
    e = saved(graph.edges(cdr), "evidence-edges")
    roles = graph.structural_roles(e).where("role IN ('broker', 'hub')").withColumn("subject", F.col("node"))
    cut = graph.cut_points(e).where("kind = 'bridge'").join(e.select("src", "dst", "weight"), ["src", "dst"])
    cut = cut.orderBy(F.desc("weight"), "src", "dst").limit(BRIDGES).withColumn("subject", F.col("src"))
    return [
        _part(roles, "Network Role", F.concat(F.lit("Structural "), F.initcap("role"), F.lit(": "), "node"), "High", F.concat_ws(" ", F.lit("degree"), F.round("centrality", 4), F.lit("betweenness"), F.round("betweenness", 4), F.lit("core"), "core")),
        _part(cut, "Network Structure", F.concat(F.lit("Critical bridge: "), "src", F.lit(" ↔ "), "dst"), "High", F.concat_ws(" ", "weight", F.lit("interactions"))),
    ]


def ranked(parts: list[DataFrame]) -> DataFrame:
    """All findings, of each title the gravest (of equal ones that of the first part, then by detail); ``weight`` ranks them."""
    weight = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")].cast("long")
    rows = reduce(DataFrame.union, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]).withColumn("weight", weight)
    first = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("weight"), "part", "detail"))
    return rows.withColumn("first", first).where("first = 1").drop("first", "part")


def findings(cdr: DataFrame, towers: DataFrame) -> DataFrame:
    return ranked(record_parts(cdr, towers) + network_parts(cdr))


def counts(found: DataFrame) -> DataFrame:
    """One row for each severity, each category, and all (both null), in one pass."""
    return found.groupingSets([[F.col("severity")], [F.col("category")], []], F.col("severity"), F.col("category")).agg(F.count("*").alias("n"))
