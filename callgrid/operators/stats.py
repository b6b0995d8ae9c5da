"""Totals, distributions and dashboard datasets. Ties in top lists go by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import day, hour, is_sms, week_start

DURATION_BINS = [(10, "<10"), (30, "<30"), (60, "<60"), (300, "<300"), (900, "<900"), (3600, "<3600")]
WEEK_AFTER_DAYS = 120


def top(df: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    return df.orderBy(F.desc(count), key).limit(n)


def counted(df: DataFrame, column: str | Column, name: str) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    return df.select(c.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def contacts(cdr: DataFrame) -> DataFrame:
    return counted(cdr.select(F.explode(F.array("a_party_number", "b_party_number")).alias("p")), "p", "contact")


def top_contacts(cdr: DataFrame, n: int = 10) -> DataFrame:
    return top(contacts(cdr), "contact", n)


def cdr_totals(cdr: DataFrame) -> DataFrame:
    """The average divides by all rows, with a duration or not."""
    total = F.coalesce(F.sum("duration_seconds"), F.lit(0))
    return cdr.agg(
        F.count("*").alias("calls"), total.cast("long").alias("seconds"), F.round(total / F.count("*"), 2).alias("avg_seconds"),
        F.countDistinct("a_party_number").alias("callers"), F.countDistinct("b_party_number").alias("called"),
        F.date_format(F.min("start_time"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("start_time"), "yyyy-MM-dd HH:mm:ss").alias("last"),
    )


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by value of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")
    return df.select(pairs).select("x.*").where("value IS NOT NULL").groupBy("field", "value").agg(F.count("*").alias("n"))


def ipdr_totals(ipdr: DataFrame) -> DataFrame:
    up, down = (F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("bytes_uploaded", "bytes_downloaded"))
    return ipdr.agg(
        F.count("*").alias("sessions"), up.alias("up"), down.alias("down"), (up + down).alias("total"), F.countDistinct("msisdn").alias("subscribers"),
        F.date_format(F.min("start_time"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("start_time"), "yyyy-MM-dd HH:mm:ss").alias("last"),
    )


def daily(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """Calls and sessions of each day that has either."""
    a = cdr.groupBy(day().alias("day")).agg(F.count("*").alias("cdr"))
    b = ipdr.groupBy(day().alias("day")).agg(F.count("*").alias("ipdr"))
    return a.join(b, "day", "full_outer").where("day IS NOT NULL").na.fill(0, ["cdr", "ipdr"])


def bucketed(cdr: DataFrame, ipdr: DataFrame, after: int = WEEK_AFTER_DAYS) -> DataFrame:
    """As daily, in weeks from Monday when more than ``after`` days are active."""
    d = daily(cdr, ipdr)
    many = d.agg(F.count("*").alias("days"))
    bucket = F.when(F.col("days") > after, F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd")).otherwise(F.col("day"))
    return d.crossJoin(F.broadcast(many)).groupBy(bucket.alias("bucket")).agg(F.sum("cdr").alias("cdr"), F.sum("ipdr").alias("ipdr"))


def hourly(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    h = cdr.select(hour().alias("hour")).union(ipdr.select(hour())).groupBy("hour").agg(F.count("*").alias("n"))
    return cdr.sparkSession.range(24).withColumnRenamed("id", "hour").join(h, "hour", "left").na.fill(0, ["n"])


def by_weekday(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """Sunday is 0."""
    d = (F.dayofweek("start_time") - 1).cast("long").alias("dow")
    n = cdr.select(d).union(ipdr.select(d)).groupBy("dow").agg(F.count("*").alias("n"))
    return cdr.sparkSession.range(7).withColumnRenamed("id", "dow").join(n, "dow", "left").na.fill(0, ["n"])


def pattern_of_life(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """Weekday (Monday 0) by hour."""
    c = [F.weekday("start_time").cast("long").alias("weekday"), hour().alias("hour")]
    return cdr.select(*c).union(ipdr.select(*c)).groupBy("weekday", "hour").agg(F.count("*").alias("n"))


def either(first: DataFrame, other: DataFrame) -> DataFrame:
    """``other`` only where ``first`` is empty."""
    some = first.limit(1).agg(F.count("*").alias("__some"))
    return first.union(other.crossJoin(F.broadcast(some)).where("__some = 0").drop("__some"))


def contacts_or_destinations(cdr: DataFrame, ipdr: DataFrame, n: int = 10) -> DataFrame:
    return either(top_contacts(cdr, n), top(counted(ipdr, "destination_ip", "contact"), "contact", n))


def active_subjects(cdr: DataFrame, ipdr: DataFrame, n: int = 10) -> DataFrame:
    return top(counted(cdr.select(F.col("a_party_number").alias("s")).union(ipdr.select("msisdn")), "s", "subject"), "subject", n)


def top_towers(cdr: DataFrame, ipdr: DataFrame, n: int = 10) -> DataFrame:
    return top(counted(cdr.select("tower_id").union(ipdr.select("tower_id")), "tower_id", "tower"), "tower", n)


def call_types(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    return either(counted(cdr, "call_type", "kind"), counted(ipdr, F.upper("protocol"), "kind"))


def duration_histogram(cdr: DataFrame) -> DataFrame:
    label, d = F.lit(">=3600"), F.col("duration_seconds")
    for edge, name in reversed(DURATION_BINS):
        label = F.when(d < edge, name).otherwise(label)
    names = cdr.sparkSession.createDataFrame([(n,) for _, n in DURATION_BINS] + [(">=3600",)], "bin string")
    n = cdr.where("duration_seconds IS NOT NULL").groupBy(label.alias("bin")).agg(F.count("*").alias("n"))
    return names.join(n, "bin", "left").na.fill(0, ["n"])


def top_ports(ipdr: DataFrame, n: int = 10) -> DataFrame:
    return top(counted(ipdr, F.col("destination_port").cast("long"), "port"), "port", n)


def top_volume(ipdr: DataFrame, n: int = 10) -> DataFrame:
    total = F.coalesce(F.sum("bytes_uploaded"), F.lit(0)) + F.coalesce(F.sum("bytes_downloaded"), F.lit(0))
    return top(ipdr.where("destination_ip IS NOT NULL").groupBy("destination_ip").agg(total.cast("long").alias("bytes")), "destination_ip", n, "bytes")


def by_state(cdr: DataFrame, ipdr: DataFrame, towers: DataFrame, n: int = 12) -> DataFrame:
    states = towers.where("state IS NOT NULL").select("tower_id", "state")
    of = lambda df: top(df.join(states, "tower_id").groupBy("state").agg(F.count("*").alias("n")), "state", n)
    return either(of(cdr), of(ipdr))


def tower_diversity(cdr: DataFrame, weekly: bool = False) -> DataFrame:
    """Distinct towers of a day; of a week the most of its days."""
    d = cdr.where("tower_id IS NOT NULL").groupBy(day().alias("day"), week_start().alias("week")).agg(F.countDistinct("tower_id").alias("towers"))
    return d.groupBy("week").agg(F.max("towers").alias("towers")) if weekly else d.drop("week")


def new_and_returning(cdr: DataFrame) -> DataFrame:
    """Of each day, the rows whose contact is first seen that day and the others."""
    rows = cdr.where("b_party_number IS NOT NULL AND start_time IS NOT NULL").select("b_party_number", day().alias("day")).groupBy("b_party_number", "day").agg(F.count("*").alias("n"))
    first = F.min("day").over(Window.partitionBy("b_party_number"))
    fresh = rows.withColumn("fresh", F.col("day") == first)
    return fresh.groupBy("day").agg(F.sum(F.when(F.col("fresh"), F.col("n")).otherwise(0)).alias("new"), F.sum(F.when(~F.col("fresh"), F.col("n")).otherwise(0)).alias("returning"))


def contact_direction(cdr: DataFrame, n: int = 8) -> DataFrame:
    d = F.upper("direction")
    g = cdr.where("b_party_number IS NOT NULL").groupBy(F.col("b_party_number").alias("contact")).agg(F.count_if(d == "MO").alias("mo"), F.count_if(d == "MT").alias("mt"))
    return g.withColumn("total", F.col("mo") + F.col("mt")).orderBy(F.desc("total"), "contact").limit(n)


def contact_duration(cdr: DataFrame, n: int = 10) -> DataFrame:
    g = cdr.where("b_party_number IS NOT NULL AND duration_seconds IS NOT NULL").groupBy(F.col("b_party_number").alias("contact")).agg(F.avg("duration_seconds").alias("a"))
    return g.orderBy(F.desc("a"), "contact").limit(n).select("contact", F.round("a", 1).alias("avg_seconds"))


def service_timeline(cdr: DataFrame, ipdr: DataFrame, days: int = 14, kinds: int = 6) -> DataFrame:
    """The most used services over the last active days, with zeros."""
    rows = cdr.select(day().alias("day"), F.col("call_type").alias("service")).union(ipdr.select(day(), F.upper("protocol"))).where("day IS NOT NULL")
    n = rows.groupBy("day", "service").agg(F.count("*").alias("n"))
    last = n.select("day").distinct().orderBy(F.desc("day")).limit(days)
    best = n.where("service IS NOT NULL").groupBy("service").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "service").limit(kinds).select("service")
    return last.crossJoin(F.broadcast(best)).join(n, ["day", "service"], "left").na.fill(0, ["n"])


def cumulative(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    d = daily(cdr, ipdr).select("day", (F.col("cdr") + F.col("ipdr")).alias("n"))  # one row a day: small before the ordered window
    return d.select("day", F.sum("n").over(Window.orderBy("day")).alias("total"))


def directed_pairs(cdr: DataFrame) -> DataFrame:
    return cdr.where("a_party_number IS NOT NULL AND b_party_number IS NOT NULL").groupBy("a_party_number", "b_party_number").agg(F.count("*").alias("n"))


def subject_days(df: DataFrame, subject: str) -> DataFrame:
    return df.where(F.col(subject).isNotNull() & F.col("start_time").isNotNull()).groupBy(F.col(subject).alias("subject"), day().alias("day")).agg(F.count("*").alias("n"))


def service_kind(call_type: Column) -> Column:
    u = F.upper(F.coalesce(call_type, F.lit("")))
    has = lambda *w: reduce(lambda a, b: a | b, [u.contains(x) for x in w])
    return F.when(has("CALL", "VOICE"), "CALL").when(has("SMS", "TEXT", "MMS"), "SMS").otherwise("DATA")


def subject_services(cdr: DataFrame) -> DataFrame:
    k = service_kind(F.col("call_type"))
    return cdr.where("a_party_number IS NOT NULL").groupBy(F.col("a_party_number").alias("subject")).agg(*[F.count_if(k == x).alias(x.lower() + "s") for x in ("CALL", "SMS", "DATA")])


def tower_activity(cdr: DataFrame, ipdr: DataFrame, towers: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("tower_id").agg(F.count("*").alias(name))
    return towers.select("tower_id").join(n(cdr, "cdr"), "tower_id", "left").join(n(ipdr, "ipdr"), "tower_id", "left").na.fill(0, ["cdr", "ipdr"])


def tower_stats(towers: DataFrame) -> DataFrame:
    return towers.agg(F.count("*").alias("towers"), F.count_if(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("placed"), F.countDistinct("state").alias("states"), F.countDistinct("city").alias("cities"))


def towers_by_state(towers: DataFrame, n: int = 40) -> DataFrame:
    return top(counted(towers, F.coalesce("state", F.lit("Unknown")), "state"), "state", n)


def case_counts(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    return cdr.select("case_id").union(ipdr.select("case_id")).groupBy("case_id").agg(F.count("*").alias("records"))


def data_quality(cdr: DataFrame) -> DataFrame:
    """100 less a penalty times the share of rows affected, for each field; not below 0."""
    share = lambda c: F.count_if(F.col(c).isNull()) / F.count("*")
    loss = 10 * share("tower_id") + 15 * share("start_time") + 8 * share("duration_seconds") + 5 * share("technology")
    return cdr.agg(F.count("*").alias("rows"), F.round(F.greatest(F.lit(0.0), 100 - loss), 3).alias("score"))


def compare_periods(cdr: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Two periods of days (inclusive): volumes and the contacts and towers lost, gained and kept."""
    d = cdr.withColumn("day", day())
    one = d.where(F.col("day").between(*a)).withColumn("p", F.lit("a"))
    two = d.where(F.col("day").between(*b)).withColumn("p", F.lit("b"))
    rows = one.union(two)
    n = rows.agg(F.count_if(F.col("p") == "a").alias("rows_a"), F.count_if(F.col("p") == "b").alias("rows_b"))
    out = n
    for c, name in (("b_party_number", "contacts"), ("a_party_number", "subjects"), ("tower_id", "towers")):
        seen = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.max(F.col("p") == "a").alias("in_a"), F.max(F.col("p") == "b").alias("in_b"))
        out = out.crossJoin(F.broadcast(seen.agg(
            F.count_if(F.col("in_a") & F.col("in_b")).alias(f"shared_{name}"), F.count_if(~F.col("in_a")).alias(f"new_{name}"), F.count_if(~F.col("in_b")).alias(f"lost_{name}")
        )))
    return out.withColumn("change_pct", F.round(100.0 * (F.col("rows_b") - F.col("rows_a")) / F.when(F.col("rows_a") > 0, F.col("rows_a")), 2))


def sms_share(cdr: DataFrame) -> DataFrame:
    return cdr.agg(F.count_if(is_sms()).alias("sms"), F.count("*").alias("rows"))
