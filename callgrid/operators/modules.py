"""Analytics over a subject's calls: patterns, response times, time profiles, places, shifts, gaps, hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch, haversine_km, hour, top_per, when_text
from .movement import by_subject
from .overlap import top_overlaps
from .reports import involved


def communication(cdr: DataFrame) -> DataFrame:
    """Both ends of each call: outgoing for the caller, incoming for the called."""
    d = F.coalesce("duration_seconds", F.lit(0))
    return involved(cdr).groupBy("subject").agg(
        F.count("*").alias("calls"), F.count_if("owned").alias("outgoing"), F.count_if(~F.col("owned")).alias("incoming"), F.sum(d).alias("seconds"), F.round(F.avg(d), 2).alias("avg_seconds"),
        F.countDistinct("other").alias("contacts"), F.count_if((d > 0) & (d < 5)).alias("very_short"), F.count_if(d > 3600).alias("very_long"),
    )


def pattern_contacts(cdr: DataFrame, n: int = 10) -> DataFrame:
    return top_per(involved(cdr).groupBy("subject", "other").agg(F.count("*").alias("n")), ["subject"], [F.desc("n"), F.col("other")], n)


def response_times(cdr: DataFrame, hours: int = 24) -> DataFrame:
    """From the latest unanswered incoming call of a contact to the next outgoing one, within a day: an as-of join by window."""
    rows = involved(cdr).where("subject <> other").withColumn("t", epoch("start_time"))
    w = Window.partitionBy("subject", "other").orderBy("start_time", "id")
    r = rows.select("subject", "other", "owned", "t", F.lag("owned").over(w).alias("before"), F.lag("t").over(w).alias("t0"))
    # the latest incoming counts once: it is answered by the outgoing call right after it
    a = r.where(F.col("owned") & (F.col("before") == F.lit(False))).withColumn("s", F.col("t") - F.col("t0")).where(F.col("s") <= hours * 3600)
    return a.groupBy("subject").agg(F.count("*").alias("answers"), F.round(F.avg("s") / 60, 2).alias("avg_min"), F.round(F.percentile("s", 0.5) / 60, 2).alias("median_min"), F.count_if(F.col("s") < 60).alias("under_minute"), F.count_if(F.col("s") > 3600).alias("over_hour"))


def time_profile(rows: DataFrame) -> DataFrame:
    h = F.hour("start_time")
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 1)
    g = rows.groupBy("subject").agg(
        F.count("*").alias("n"), pct(h.between(6, 11)).alias("morning"), pct(h.between(12, 17)).alias("afternoon"), pct(h.between(18, 21)).alias("evening"), pct((h >= 22) | (h < 6)).alias("night")
    )
    peak = top_per(rows.groupBy("subject", hour().alias("peak_hour")).agg(F.count("*").alias("c")), ["subject"], [F.desc("c"), F.col("peak_hour")], 1).drop("c")
    best = F.greatest("morning", "afternoon", "evening", "night")
    label = F.when(F.col("night") == best, "night").when(F.col("evening") == best, "evening").when(F.col("afternoon") == best, "afternoon").otherwise("morning")
    return g.join(peak, "subject").withColumn("profile", label).withColumn("night_owl", F.col("night") > 40)


def trend(rows: DataFrame, least: int = 10, band: float = 0.2) -> DataFrame:
    """Rows per day of the earlier and the later half of the events, by subject."""
    w = Window.partitionBy("subject")
    r = rows.withColumn("i", F.row_number().over(by_subject())).withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).withColumn("late", F.col("i") > F.floor(F.col("n") / 2))
    rate = lambda c: F.count_if(c) / F.greatest(F.lit(1.0), (F.max(F.when(c, epoch("start_time"))) - F.min(F.when(c, epoch("start_time")))) / 86400)
    g = r.groupBy("subject").agg(rate(~F.col("late")).alias("a"), rate(F.col("late")).alias("b"))
    return g.select("subject", F.round("a", 3).alias("early"), F.round("b", 3).alias("later"), F.when(F.col("b") > F.col("a") * (1 + band), "increasing").when(F.col("b") < F.col("a") * (1 - band), "decreasing").otherwise("stable").alias("trend"))


def frequent_places(stream: DataFrame, n: int = 10) -> DataFrame:
    g = stream.where("tower_id IS NOT NULL").groupBy("subject", "tower_id").agg(F.count("*").alias("n"))
    g = g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("subject")), 1))
    return top_per(g, ["subject"], [F.desc("n"), F.col("tower_id")], n)


def corridors(stream: DataFrame, n: int = 10) -> DataFrame:
    r = stream.where("tower_id IS NOT NULL").select("subject", F.col("tower_id").alias("src"), F.lead("tower_id").over(by_subject()).alias("dst")).where("src <> dst")
    return top_per(r.groupBy("subject", "src", "dst").agg(F.count("*").alias("n")), ["subject"], [F.desc("n"), F.col("src"), F.col("dst")], n)


def radius(stream: DataFrame) -> DataFrame:
    """The greatest distance between two towers of a subject."""
    p = stream.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("subject", "tower_id", "latitude", "longitude").distinct()
    b = p.select("subject", F.col("tower_id").alias("t2"), F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    return p.join(b, "subject").where("tower_id < t2").groupBy("subject").agg(F.round(F.max(haversine_km("latitude", "longitude", "y", "x", 6371.0)), 3).alias("km"))


def predictability(stream: DataFrame) -> DataFrame:
    g = stream.where("tower_id IS NOT NULL").groupBy("subject", "tower_id").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("subject")))
    e = g.groupBy("subject").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))
    return e.withColumn("label", F.when(F.col("entropy") < 2, "High").when(F.col("entropy") < 4, "Medium").otherwise("Low"))


def hotspots(stream: DataFrame, n: int = 20) -> DataFrame:
    return stream.where("tower_id IS NOT NULL").groupBy("tower_id").agg(F.count("*").alias("visits"), F.countDistinct("subject").alias("subjects")).orderBy(F.desc("visits"), "tower_id").limit(n)


def shifts(rows: DataFrame, least: int = 10, share: float = 0.6) -> DataFrame:
    """A subject's last 40 % of rows against the first 60 %: night share, duration, contacts gained and dropped."""
    w = Window.partitionBy("subject")
    r = rows.withColumn("i", F.row_number().over(by_subject())).withColumn("n", F.count("*").over(w)).where(F.col("n") >= least).withColumn("new", F.col("i") > F.floor(F.col("n") * share))
    night = (F.hour("start_time") >= 22) | (F.hour("start_time") < 6)
    part = lambda c, x: F.avg(F.when(c, x))
    old, new = ~F.col("new"), F.col("new")
    g = r.groupBy("subject").agg((part(new, night.cast("int")) - part(old, night.cast("int"))).alias("night"), part(old, F.col("duration_seconds")).alias("d0"), part(new, F.col("duration_seconds")).alias("d1"))
    seen = r.groupBy("subject", "b_party_number").agg(F.max("new").alias("in_new"), F.max(old).alias("in_old"))
    c = seen.groupBy("subject").agg(F.count_if(F.col("in_new") & ~F.col("in_old")).alias("gained"), F.count_if(~F.col("in_new")).alias("dropped"))
    return g.join(c, "subject").select("subject", F.round("night", 3).alias("night_shift"), F.round("d0", 2).alias("seconds_before"), F.round("d1", 2).alias("seconds_after"), "gained", "dropped")


def silences(rows: DataFrame, minutes: int = 120) -> DataFrame:
    gap = (epoch("start_time") - epoch(F.lag("start_time").over(by_subject()))) / 3600
    g = rows.select("subject", gap.alias("h")).where(F.col("h") >= minutes / 60)
    return g.groupBy("subject").agg(F.count("*").alias("gaps"), F.count_if(F.col("h") > 24).alias("over_day"), F.count_if(F.col("h") > 168).alias("over_week"), F.round(F.max("h"), 3).alias("longest"), F.round(F.avg("h"), 3).alias("average"), F.round(F.sum("h"), 3).alias("total"))


def call_details(rows: DataFrame) -> DataFrame:
    w = by_subject()
    again = (F.lag("b_party_number").over(w) == F.col("b_party_number")) & (epoch("start_time") - epoch(F.lag("start_time").over(w)) < 300)
    r = rows.withColumn("again", F.coalesce(again, F.lit(False)))
    d = F.col("duration_seconds")
    return r.groupBy("subject").agg(F.count_if((d > 0) & (d < 5)).alias("short"), F.count_if(d > 3600).alias("long"), F.count_if(F.hour("start_time") < 5).alias("small_hours"), F.count_if("again").alias("repeats"))


def call_bursts(rows: DataFrame, seconds: int = 600, least: int = 5) -> DataFrame:
    """From each row on, the rows within ten minutes, if at least five."""
    r = rows.withColumn("us", F.unix_micros(F.col("start_time").cast("timestamp")))
    w = Window.partitionBy("subject").orderBy("us").rangeBetween(0, seconds * 1_000_000 - 1)
    b = r.select("subject", "us", F.count("*").over(w).alias("n"), F.max("us").over(w).alias("last"), F.size(F.collect_set("b_party_number").over(w)).cast("long").alias("contacts")).where(F.col("n") >= least)
    return b.select("subject", F.col("us").alias("first"), "last", "n", "contacts").distinct()


def dominance(cdr: DataFrame) -> DataFrame:
    g = involved(cdr).groupBy("subject").agg(F.count_if("owned").alias("made"), F.count_if(~F.col("owned")).alias("received"))
    g = g.withColumn("ratio", F.round(F.col("made") / (F.col("made") + F.col("received")), 3))
    return g.withColumn("role", F.when(F.col("ratio") > 0.6, "leader").when(F.col("ratio") < 0.4, "follower").otherwise("peer"))


def fan_out(cdr: DataFrame, least: int = 5) -> DataFrame:
    g = cdr.where("a_party_number IS NOT NULL").groupBy(F.col("a_party_number").alias("subject")).agg(F.countDistinct("b_party_number").alias("contacts")).where(F.col("contacts") >= least)
    return g.withColumn("breadth", F.when(F.col("contacts") >= 20, "wide").when(F.col("contacts") >= 10, "medium").otherwise("narrow"))


def check_ins(cdr: DataFrame, least: int = 5) -> DataFrame:
    """Regular calls to one contact: a mean gap of about a day or a week."""
    g = cdr.groupBy("a_party_number", "b_party_number").agg(F.count("*").alias("n"), ((epoch(F.max("start_time")) - epoch(F.min("start_time"))) / 3600).alias("span")).where(F.col("n") >= least).withColumn("mean", F.col("span") / (F.col("n") - 1))
    kind = F.when(F.col("mean").between(20, 28), "daily").when(F.col("mean").between(160, 176), "weekly")
    return g.withColumn("kind", kind).where("kind IS NOT NULL").select("a_party_number", "b_party_number", "n", F.round("mean", 3).alias("mean_hours"), "kind")


def home_and_work(rows: DataFrame) -> DataFrame:
    """Each subject's commonest tower from 19 to 8 and from 9 to 18 o'clock (Unknown without one; of equal ones the first by name), and how many towers it visits."""
    h = F.hour("start_time")
    part = F.when((h >= 19) | (h < 8), "home").when(h.between(9, 17), "work")
    n = rows.where("subject IS NOT NULL AND tower_id IS NOT NULL AND start_time IS NOT NULL").withColumn("part", part).groupBy("subject", "part", "tower_id").agg(F.count("*").alias("n"))
    best = lambda p: F.coalesce(F.min_by(F.when(F.col("part") == p, F.col("tower_id")), F.when(F.col("part") == p, F.struct(-F.col("n"), F.col("tower_id")))), F.lit("Unknown"))
    g = n.groupBy("subject").agg(best("home").alias("home"), best("work").alias("work"), F.countDistinct("tower_id").alias("towers"))
    return g.withColumn("mobility", F.when(F.col("towers") > 4, "High").otherwise("Low"))


def contact_sets(cdr: DataFrame) -> DataFrame:
    return cdr.where("a_party_number <> b_party_number").select(F.col("a_party_number").alias("s"), F.col("b_party_number").alias("c")).distinct()


def shared_contacts(cdr: DataFrame, n: int = 20) -> DataFrame:
    """The callers with most contacts in common, with Jaccard similarity."""
    return top_overlaps(contact_sets(cdr), n)


def silent_partners(cdr: DataFrame, n: int = 20) -> DataFrame:
    """Pairs with common contacts that never called each other."""
    direct = cdr.select(F.least("a_party_number", "b_party_number").alias("a"), F.greatest("a_party_number", "b_party_number").alias("b")).distinct()
    return top_overlaps(contact_sets(cdr), n, barred=direct)


def training_rows(cdr: DataFrame, n: int = 5) -> DataFrame:
    """One row of measures a caller, for export as JSON lines."""
    night = (F.hour("start_time") >= 23) | (F.hour("start_time") < 5)
    g = cdr.groupBy(F.col("a_party_number").alias("subject")).agg(F.count("*").alias("calls"), F.countDistinct("b_party_number").alias("contacts"), F.countDistinct("tower_id").alias("towers"), F.round(F.count_if(night) / F.count("*"), 3).alias("night_share"))
    t = top_per(cdr.groupBy(F.col("a_party_number").alias("subject"), "b_party_number").agg(F.count("*").alias("c")), ["subject"], [F.desc("c"), F.col("b_party_number")], n)
    return g.join(t.groupBy("subject").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "b_party_number"))), lambda x: x["b_party_number"]), ",").alias("top_contacts")), "subject")


def first_seen(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", "call_type").agg(when_text(F.min("start_time")).alias("first"))


def leads(cdr: DataFrame, n: int = 20) -> DataFrame:
    """Scored rules in one list: the most contacted, night callers, SIM or handset changes."""
    from .behaviour import identity_report
    from .reports import owned

    own = owned(cdr)
    top = cdr.groupBy(F.col("b_party_number").alias("subject")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "subject").limit(n).select("subject", F.lit("most contacted").alias("rule"), F.least(F.lit(60), F.col("c")).cast("long").alias("score"))
    night = time_profile(own).where("night >= 40").select("subject", F.lit("night activity").alias("rule"), F.least(F.lit(100), F.col("night").cast("long")).alias("score"))
    ids = identity_report(own)
    swap = ids.where("swaps > 0").select("subject", F.lit("SIM change").alias("rule"), F.least(F.lit(85), 70 + 5 * F.col("swaps")).cast("long").alias("score"))
    device = ids.where("devices > 0").select("subject", F.lit("handset change").alias("rule"), F.least(F.lit(78), 60 + 6 * F.col("devices")).cast("long").alias("score"))
    return top.union(night).union(swap).union(device).orderBy(F.desc("score"), "rule", "subject")
