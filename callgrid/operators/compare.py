"""Several subjects, several cases, several tower dumps: set intersections and identifier bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import epoch, joined, top_per, when_text
from .nearest import nearest
from .reports import involved

TYPE_RANK = {"number": 0, "imei": 1, "imsi": 2, "ip": 3}


def common(rows: DataFrame, subjects: list[str], value, least: int | None = None) -> DataFrame:
    """Values that at least ``least`` (default: all) of the subjects share, with counts."""
    v = rows.where(F.col("subject").isin(subjects)).select("subject", value.alias("value") if not isinstance(value, str) else F.col(value).alias("value")).where("value IS NOT NULL")
    g = v.groupBy("value").agg(F.countDistinct("subject").alias("subjects"), F.count("*").alias("n"))
    return g.where(F.col("subjects") >= (least or len(set(subjects))))


def common_contacts(cdr: DataFrame, subjects: list[str], least: int | None = None) -> DataFrame:
    return common(involved(cdr), subjects, "other", least).where(~F.col("value").isin(subjects))


def common_places(located: DataFrame, subjects: list[str], least: int | None = None) -> DataFrame:
    """Places rounded to three decimals, half to even."""
    return common(located, subjects, F.concat_ws(",", F.format_string("%.3f", F.bround("latitude", 3)), F.format_string("%.3f", F.bround("longitude", 3))), least)


def call_matrix(cdr: DataFrame, subjects: list[str]) -> DataFrame:
    inside = F.col("a_party_number").isin(subjects) & F.col("b_party_number").isin(subjects)
    return cdr.where(inside).groupBy("a_party_number", "b_party_number").agg(F.count("*").alias("n"))


# --- cases ---------------------------------------------------------------------------------------------


def identifiers(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """case_id, subject, type, value: what a calling subject is known by in a case."""
    calls = cdr.select("case_id", F.explode(F.array_distinct(F.array("a_party_number", "msisdn"))).alias("subject"), "msisdn", "imei", "imsi")
    of = lambda df, kinds: df.select("case_id", "subject", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(c).alias("value")) for k, c in kinds])).alias("x")).select("case_id", "subject", "x.*")
    a = of(calls, [("number", "subject"), ("number", "msisdn"), ("imei", "imei"), ("imsi", "imsi")])
    b = of(ipdr.withColumnRenamed("msisdn", "subject"), [("imei", "imei"), ("imsi", "imsi")])
    return a.union(b).where("subject IS NOT NULL AND value IS NOT NULL").distinct()


def roles(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """case_id, type, value, role: subject beats counterpart."""
    pairs = [("number", "a_party_number", "subject"), ("number", "b_party_number", "counterpart"), ("number", "msisdn", "subject"), ("imei", "imei", "subject"), ("imsi", "imsi", "subject")]
    of = lambda df, kinds: df.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(c).alias("value"), F.lit(r).alias("role")) for k, c, r in kinds])).alias("x")).select("case_id", "x.*")
    a = of(cdr, pairs)
    b = of(ipdr, [("number", "msisdn", "subject"), ("imei", "imei", "subject"), ("imsi", "imsi", "subject")])
    return a.union(b).where("value IS NOT NULL").groupBy("case_id", "type", "value").agg(F.max("role").alias("role"))


def phone_matches(cdr: DataFrame, ipdr: DataFrame, case_id: str) -> DataFrame:
    """Other cases in which a subject of the case occurs: headline type, role, number of matched values."""
    own = identifiers(cdr, ipdr).where(F.col("case_id") == case_id).drop("case_id")
    hits = own.join(roles(cdr, ipdr).where(F.col("case_id") != case_id), ["type", "value"])
    rank = F.when(F.col("type") == "number", 0).when(F.col("type") == "imei", 1).otherwise(2)
    best = F.min_by("type", rank)
    return hits.groupBy("subject", "case_id").agg(best.alias("type"), F.max("role").alias("role"), F.countDistinct("type", "value").alias("matched"), F.lit("high").alias("confidence"))


def match_ranges(cdr: DataFrame, ipdr: DataFrame, case_id: str) -> DataFrame:
    """Records of another case that carry an identifier of the subject, each counted once, with first and last time."""
    own = identifiers(cdr, ipdr).where(F.col("case_id") == case_id).select("subject", "type", "value")
    tags = lambda df, kinds, feed: df.where(F.col("case_id") != case_id).select("case_id", "id", F.lit(feed).alias("feed"), "start_time", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(c).alias("value")) for k, c in kinds])).alias("x")).select("case_id", "id", "feed", "start_time", "x.*")
    rows = tags(cdr, [("number", "a_party_number"), ("number", "b_party_number"), ("number", "msisdn"), ("imei", "imei"), ("imsi", "imsi")], "c").union(tags(ipdr, [("number", "msisdn"), ("imei", "imei"), ("imsi", "imsi")], "i"))
    once = rows.join(own, ["type", "value"]).select("subject", "case_id", "feed", "id", "start_time").distinct()
    return once.groupBy("subject", "case_id").agg(F.count("*").alias("records"), when_text(F.min("start_time")).alias("first"), when_text(F.max("start_time")).alias("last"))


def ip_matches(ipdr: DataFrame, case_id: str) -> DataFrame:
    both = ipdr.select("case_id", F.explode(F.array(F.struct(F.col("source_ip").alias("ip"), F.lit("subject").alias("role")), F.struct(F.col("destination_ip").alias("ip"), F.lit("counterpart").alias("role")))).alias("x")).select("case_id", "x.*")
    own = ipdr.where(F.col("case_id") == case_id).select(F.col("source_ip").alias("ip")).distinct()
    return both.where(F.col("case_id") != case_id).join(own, "ip").groupBy("ip", "case_id").agg(F.max("role").alias("role"), F.count("*").alias("n"), F.lit("low").alias("confidence"))


def phone_activity(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """What a number does in each case: calls by kind, contacts, towers, sessions, busiest hour."""
    rows = involved(cdr)
    t = F.upper("call_type")
    g = rows.groupBy("case_id", "subject").agg(
        F.count_if(t.contains("VOICE")).alias("voice"), F.count_if(t.contains("SMS")).alias("sms"), F.count_if(~t.contains("VOICE") & ~t.contains("SMS")).alias("others"),
        F.countDistinct("other").alias("contacts"),
    )
    best = lambda c, name: top_per(rows.groupBy("case_id", "subject", c).agg(F.count("*").alias("c")), ["case_id", "subject"], [F.desc("c"), F.col(c)], 3).groupBy("case_id", "subject").agg(joined(F.col(c)).alias(name))
    peak = top_per(rows.groupBy("case_id", "subject", F.hour("start_time").cast("long").alias("peak_hour")).agg(F.count("*").alias("c")), ["case_id", "subject"], [F.desc("c"), F.col("peak_hour")], 1).drop("c")
    data = ipdr.groupBy("case_id", F.col("msisdn").alias("subject")).agg(F.count("*").alias("sessions"))
    key = ["case_id", "subject"]
    return g.join(best("other", "top_contacts"), key).join(best("tower_id", "top_towers"), key, "left").join(peak, key).join(data, key, "left").na.fill(0, ["sessions"])


def ip_activity(ipdr: DataFrame) -> DataFrame:
    return ipdr.groupBy("case_id", "source_ip").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("protocol") == "UDP").alias("udp"), F.count_if(F.col("protocol") == "TCP").alias("tcp"), F.countDistinct("destination_ip").alias("destinations"),
        F.coalesce(F.sum(F.coalesce("bytes_uploaded", F.lit(0)) + F.coalesce("bytes_downloaded", F.lit(0))), F.lit(0)).alias("bytes"), F.countDistinct("tower_id").alias("towers"),
    )


def case_overview(cdr: DataFrame, ipdr: DataFrame, case_id: str) -> DataFrame:
    """Subjects of the case that other cases know: number of cases, headline type, confidence."""
    own = identifiers(cdr, ipdr).where(F.col("case_id") == case_id).select("subject", "type", "value").join(cdr.where(F.col("case_id") == case_id).select(F.col("a_party_number").alias("subject")).distinct(), "subject", "left_semi")
    ips = ipdr.where(F.col("case_id") == case_id).select(F.col("source_ip").alias("subject"), F.lit("ip").alias("type"), F.col("source_ip").alias("value")).distinct()
    known = roles(cdr, ipdr).select("case_id", "type", "value").union(ipdr.select("case_id", F.lit("ip"), F.explode(F.array("source_ip", "destination_ip"))).distinct())
    hits = own.union(ips).join(known.where(F.col("case_id") != case_id), ["type", "value"])
    rank = F.when(F.col("type") == "number", 0).when(F.col("type") == "imei", 1).when(F.col("type") == "imsi", 2).otherwise(3)
    return hits.groupBy("subject").agg(F.countDistinct("case_id").alias("cases"), F.min_by("type", rank).alias("type")).withColumn("confidence", F.when(F.col("type") == "ip", "low").otherwise("high"))


def case_report(cdr: DataFrame, ipdr: DataFrame, case_id: str) -> DataFrame:
    """By linked case: subjects shared by number, device, SIM."""
    m = phone_matches(cdr, ipdr, case_id)
    return m.groupBy("case_id").agg(F.count("*").alias("subjects"), *[F.count_if(F.col("type") == k).alias(f"by_{k}") for k in ("number", "imei", "imsi")], F.sum("matched").alias("matched"))


def case_graph(cdr: DataFrame, ipdr: DataFrame, case_id: str) -> DataFrame:
    """Edges between subjects and the cases that know them; nodes are the two ends."""
    return case_links(phone_matches(cdr, ipdr, case_id).select("subject", "case_id", "type", "confidence"), ip_matches(ipdr, case_id).select(F.col("ip").alias("subject"), "case_id", F.lit("ip").alias("type"), "confidence"))


def case_links(phones: DataFrame, ips: DataFrame) -> DataFrame:
    return phones.union(ips).select(F.concat(F.lit("subject:"), "subject").alias("src"), F.concat(F.lit("case:"), "case_id").alias("dst"), "type", "confidence")


# --- tower dumps -----------------------------------------------------------------------------------------


def dump_list(dumps: DataFrame) -> DataFrame:
    return dumps.groupBy("dump_label").agg(F.count("*").alias("rows"), F.countDistinct("msisdn").alias("numbers"), when_text(F.min("start_time")).alias("first"), when_text(F.max("start_time")).alias("last"))


def numbers_in_dumps(dumps: DataFrame) -> DataFrame:
    return dumps.where("msisdn IS NOT NULL").groupBy("msisdn").agg(F.countDistinct("dump_label").alias("dumps"), joined(F.col("dump_label")).alias("labels"), joined(F.col("imei")).alias("imeis"))


def common_numbers(dumps: DataFrame, least: int = 2) -> DataFrame:
    return numbers_in_dumps(dumps).where(F.col("dumps") >= max(2, least))


def uncommon_numbers(dumps: DataFrame) -> DataFrame:
    return numbers_in_dumps(dumps).where("dumps = 1")


def under_tower(dumps: DataFrame, label: str | None = None) -> DataFrame:
    rows = dumps if not label else dumps.where(F.col("dump_label") == label)
    return rows.where("msisdn IS NOT NULL").groupBy("msisdn").agg(F.count("*").alias("n"))


def multiplicity(dumps: DataFrame) -> DataFrame:
    """Numbers in several handsets and handsets with several numbers."""
    many = lambda key, other, kind: dumps.where(F.col(key).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.countDistinct(other).alias("n"), joined(F.col(other)).alias("others")).where("n > 1").withColumn("kind", F.lit(kind))
    return many("msisdn", "imei", "number").union(many("imei", "msisdn", "handset"))


# --- towers ----------------------------------------------------------------------------------------------


def harvest(rows: DataFrame) -> DataFrame:
    """One row a tower, with coordinates where a row has both."""
    both = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude"))
    g = rows.where("tower_id IS NOT NULL").groupBy("tower_id").agg(F.min(both).alias("p"))
    return g.select("tower_id", F.col("p.latitude").alias("latitude"), F.col("p.longitude").alias("longitude"))


def merge_towers(known: DataFrame, found: DataFrame) -> DataFrame:
    """New towers are added, missing coordinates filled; nothing that is known changes. ``change`` says which."""
    f = found.select("tower_id", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"), F.lit(True).alias("__f"))
    k = known.withColumn("__k", F.lit(True))
    filled = F.col("__k") & F.col("latitude").isNull() & F.col("__lat").isNotNull()
    change = F.when(F.col("__k").isNull(), "added").when(filled, "updated").otherwise("same")
    return k.join(f, "tower_id", "full_outer").select("tower_id", F.coalesce("latitude", "__lat").alias("latitude"), F.coalesce("longitude", "__lon").alias("longitude"), "city", "state", change.alias("change"))


def replace_towers(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows replace known ones whole."""
    return known.join(incoming.select("tower_id"), "tower_id", "left_anti").unionByName(incoming)


def upsert_subscribers(known: DataFrame, incoming: DataFrame, fields: list[str]) -> DataFrame:
    """The latest non-empty value of each field by number; ``seq`` orders incoming rows. Rows without a number are skipped."""
    some = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
    new = incoming.where(some("msisdn").isNotNull()).groupBy("msisdn").agg(*[F.max_by(some(c), F.when(some(c).isNotNull(), F.col("seq"))).alias(f"__{c}") for c in fields])
    return known.join(new, "msisdn", "full_outer").select("msisdn", *[F.coalesce(f"__{c}", c).alias(c) for c in fields])


def geocode(towers: DataFrame, cities: DataFrame) -> DataFrame:
    """City and state of the nearest city where either is missing; the first in table order of equals. Equal positions are looked up once."""
    need = towers.where("city IS NULL OR state IS NULL").select(F.struct("latitude", "longitude").alias("id"), "latitude", "longitude").distinct()
    best = nearest(need, cities.select(F.col("ord").alias("place"), "latitude", "longitude"))
    named = best.join(cities.select(F.col("ord").alias("place"), F.col("city").alias("c"), F.col("state").alias("s")), "place").select("id.latitude", "id.longitude", "c", "s")
    return towers.join(named, ["latitude", "longitude"], "left").select("tower_id", "latitude", "longitude", F.coalesce("city", "c").alias("city"), F.coalesce("state", "s").alias("state"))


def colocation(cdr: DataFrame, least: int = 2) -> DataFrame:
    """Towers at which several parties occur, callers and called alike."""
    p = cdr.where("tower_id IS NOT NULL").select("tower_id", F.explode(F.array("a_party_number", "b_party_number")).alias("p")).where("p IS NOT NULL")
    return p.groupBy("tower_id").agg(F.countDistinct("p").alias("parties")).where(F.col("parties") >= least)


def enrich(rows: DataFrame, tags: DataFrame, labels: DataFrame) -> DataFrame:
    """Subject tags and labels of unordered pairs beside rows with subject and other."""
    out = rows.join(tags, "subject", "left")
    return out.withColumn("subject_a", F.least("subject", "other")).withColumn("subject_b", F.greatest("subject", "other")).join(labels, ["subject_a", "subject_b"], "left")


def correlation(cdr: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score of pairs (a, b): shared contacts x 5, services x 2, towers x 1, overlapping calls x 4."""
    rows = cdr.withColumn("subject", F.col("a_party_number")).withColumn("end", F.col("start_time") + F.expr("make_interval(0, 0, 0, 0, 0, 0, duration_seconds)"))

    def shared(value: str, name: str) -> DataFrame:
        v = rows.where(F.col(value).isNotNull()).select("subject", F.col(value).alias("v")).distinct()
        x = pairs.join(v.withColumnRenamed("subject", "a"), "a").join(v.withColumnRenamed("subject", "b"), ["b", "v"])
        return x.groupBy("a", "b").agg(F.count("*").alias(name))

    one = lambda side: rows.select(F.col("subject").alias(side), F.col("start_time").alias(f"s_{side}"), F.col("end").alias(f"e_{side}"))
    # a call is in the bucket of each hour that it touches; two that overlap count in the hour in which the later one begins
    bucket = lambda c: F.floor(epoch(c) / 3600)
    a = one("a").withColumn("h", F.explode(F.sequence(bucket("s_a"), bucket("e_a"))))
    b = one("b").withColumn("h", F.explode(F.sequence(bucket("s_b"), bucket("e_b"))))
    over = pairs.join(a, "a").join(b, ["b", "h"]).where((F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")))
    over = over.where(F.col("h") == bucket(F.greatest("s_a", "s_b"))).groupBy("a", "b").agg(F.count("*").alias("overlapping"))
    out = pairs
    for x in (shared("b_party_number", "contacts"), shared("call_type", "services"), shared("tower_id", "towers"), over):
        out = out.join(x, ["a", "b"], "left")
    out = out.na.fill(0, ["contacts", "services", "towers", "overlapping"])
    return out.withColumn("score", 5 * F.col("contacts") + 2 * F.col("services") + F.col("towers") + 4 * F.col("overlapping"))


def highlighted(rows: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which any of the columns holds a watched value (table of ``value``)."""
    hit = rows.select("id", F.explode(F.array(*columns)).alias("value")).join(values.select("value").distinct(), "value", "left_semi")
    return rows.join(hit.select("id").distinct(), "id", "left_semi")


