"""Reports for all subjects at once; filter by subject for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import day, epoch, hour, is_sms, looks_foreign, top_per, when_text

OFF_DAYS = 3


def involved(cdr: DataFrame) -> DataFrame:
    """Each call once for either party: subject, other, owned (the subject made it). A call to oneself counts once."""
    sides = F.explode(
        F.when(F.col("a_party_number") == F.col("b_party_number"), F.array(F.struct(F.col("a_party_number").alias("subject"), F.col("b_party_number").alias("other"), F.lit(True).alias("owned")))).otherwise(
            F.array(
                F.struct(F.col("a_party_number").alias("subject"), F.col("b_party_number").alias("other"), F.lit(True).alias("owned")),
                F.struct(F.col("b_party_number").alias("subject"), F.col("a_party_number").alias("other"), F.lit(False).alias("owned")),
            )
        )
    ).alias("side")
    return cdr.select("*", sides).select(*cdr.columns, "side.*").where("subject IS NOT NULL")


def owned(cdr: DataFrame) -> DataFrame:
    return cdr.where("a_party_number IS NOT NULL AND start_time IS NOT NULL").withColumn("subject", F.col("a_party_number"))


def sessions_of(ipdr: DataFrame) -> DataFrame:
    """Each session once for its address and once for its number."""
    return ipdr.select("*", F.explode(F.array_distinct(F.array("source_ip", "msisdn"))).alias("subject")).where("subject IS NOT NULL")


def volume_by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", day().alias("day")).agg(F.count("*").alias("n"))


def hourly_pattern(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", hour().alias("hour")).agg(F.count("*").alias("n"))


def tower_footprint(rows: DataFrame, n: int = 20) -> DataFrame:
    g = rows.where("tower_id IS NOT NULL").groupBy("subject", "tower_id").agg(F.count("*").alias("n"))
    return top_per(g, ["subject"], [F.desc("n"), F.col("tower_id")], n)


def off_periods(rows: DataFrame, days: int = OFF_DAYS) -> DataFrame:
    """Silence of at least ``days`` between consecutive rows."""
    w = Window.partitionBy("subject").orderBy("start_time", "id")
    gap = epoch("start_time") - epoch(F.lag("start_time").over(w))
    out = rows.where("start_time IS NOT NULL").select("subject", F.lag("start_time").over(w).alias("before"), F.col("start_time").alias("after"), gap.alias("gap"))
    return out.where(F.col("gap") >= days * 86400).select("subject", when_text("before").alias("before"), when_text("after").alias("after"), F.floor(F.col("gap") / 86400).alias("days"))


def off_dates(rows: DataFrame, days: int = OFF_DAYS) -> DataFrame:
    """Consecutive active dates at least ``days`` apart."""
    w = Window.partitionBy("subject").orderBy("d")
    d = rows.select("subject", F.to_date("start_time").alias("d")).distinct()
    out = d.select("subject", F.lag("d").over(w).alias("before"), F.col("d").alias("after"))
    return out.where(F.datediff("after", "before") >= days).select("subject", F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after"), F.datediff("after", "before").cast("long").alias("days"))


def day_first_last(rows: DataFrame) -> DataFrame:
    at = F.struct("start_time", "id")
    return rows.groupBy("subject", day().alias("day")).agg(F.min_by("other", at).alias("first"), F.max_by("other", at).alias("last"), F.count("*").alias("n"))


def single_days(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", day().alias("day")).agg(F.count("*").alias("n"), F.min("other").alias("other")).where("n = 1").drop("n")


def weekday_table(rows: DataFrame) -> DataFrame:
    """Counts by weekday from Sunday, and of weekdays and weekends."""
    d = rows.groupBy("subject", (F.dayofweek("start_time") - 1).alias("d")).agg(F.count("*").alias("n"))
    total = d.groupBy("subject", F.when(F.col("d").isin(0, 6), "weekend").otherwise("weekdays").alias("part")).agg(F.sum("n").alias("n"))
    return d.select("subject", F.col("d").cast("string").alias("part"), "n").union(total)


def longest_calls(rows: DataFrame, n: int = 30) -> DataFrame:
    calls = rows.where(~is_sms() & F.col("duration_seconds").isNotNull())
    return top_per(calls, ["subject"], [F.desc("duration_seconds"), F.col("id")], n).select("subject", "id", "other", F.col("duration_seconds").cast("long").alias("seconds"))


def day_night(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows by day (6 to 18) and night, with the tower that the subject's own rows use most in each."""
    part = F.when(hour().between(6, 17), "day").otherwise("night").alias("part")
    n = rows.groupBy("subject", part).agg(F.count("*").alias("n"))
    t = top_per(own.where("tower_id IS NOT NULL").groupBy("subject", part, "tower_id").agg(F.count("*").alias("c")), ["subject", "part"], [F.desc("c"), F.col("tower_id")], 1)
    return n.join(t.select("subject", "part", F.col("tower_id").alias("tower")), ["subject", "part"], "left")


def isd_calls(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows with numbers that look foreign, and the country of the longest known prefix."""
    from .lookups import isd_country

    far = rows.where(looks_foreign(F.col("other")))
    return isd_country(far, "other", prefixes).groupBy("subject", "other", F.coalesce("country", F.lit("Unknown")).alias("country")).agg(F.count("*").alias("n"))


def other_circle(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Rows whose other party belongs to another circle than the subject, by a table of number series."""
    from .lookups import series_lookup

    both = series_lookup(series_lookup(rows, "subject", series, "own"), "other", series, "far")
    return both.where("own_circle <> far_circle").groupBy("subject", "own_circle", "far_circle").agg(F.count("*").alias("n"))


def device_summary(rows: DataFrame, column: str, tac: DataFrame | None = None) -> DataFrame:
    """First and last use and count of each handset (with make and model) or SIM."""
    g = rows.where(F.col(column).isNotNull()).groupBy("subject", column).agg(when_text(F.min("start_time")).alias("first"), when_text(F.max("start_time")).alias("last"), F.count("*").alias("n"))
    if tac is None:
        return g
    return g.join(tac, F.substring(column, 1, 8) == tac["tac"], "left").drop("tac")


def bank_sms(rows: DataFrame) -> DataFrame:
    return rows.where(is_sms() & F.col("other").rlike("[A-Za-z]")).groupBy("subject", "other").agg(F.count("*").alias("n"))


def traffic_by_day(rows: DataFrame) -> DataFrame:
    mb = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 1048576, 2)
    return rows.groupBy("subject", day().alias("day")).agg(F.count("*").alias("sessions"), mb("bytes_uploaded").alias("up_mb"), mb("bytes_downloaded").alias("down_mb"))


def breakdown(rows: DataFrame, columns: tuple[str, ...] = ("protocol", "apn", "rat")) -> DataFrame:
    """Counts by value, as a share of all rows of the subject, with a value or not."""
    each = rows.select("subject", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).select("subject", "x.*")
    n = each.groupBy("subject", "field", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("subject", "field"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / total, 1)).where("value IS NOT NULL")


def destinations(ipdr: DataFrame, n: int = 30) -> DataFrame:
    g = ipdr.where("destination_ip IS NOT NULL").groupBy(F.col("source_ip").alias("subject"), "destination_ip").agg(F.count("*").alias("n"))
    return top_per(g, ["subject"], [F.desc("n"), F.col("destination_ip")], n)


def port_usage(rows: DataFrame, n: int = 30) -> DataFrame:
    g = rows.where("destination_port IS NOT NULL").groupBy("subject", F.col("destination_port").cast("long").alias("port"), "protocol").agg(F.count("*").alias("n"))
    return top_per(g, ["subject"], [F.desc("n"), F.col("port"), F.col("protocol")], n)


def subject_profile(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """One wide row a calling subject: contacts, records, towers, rates, hours, gaps."""
    own = owned(cdr)
    w = Window.partitionBy("subject").orderBy("start_time", "id")
    rows = own.withColumn("gap", epoch("start_time") - epoch(F.lag("start_time").over(w)))
    night = hour().isin(23, 0, 1, 2, 3, 4)
    g = rows.groupBy("subject").agg(
        F.countDistinct("b_party_number").alias("contacts"), F.count("*").alias("records"), F.countDistinct("tower_id").alias("towers"), F.countDistinct(day()).alias("days"),
        F.round(F.count_if(night) / F.count("*"), 3).alias("night_share"), F.round(F.coalesce(F.max("gap"), F.lit(0.0)) / 86400, 2).alias("longest_gap_days"),
        F.count_if(F.col("gap") >= 3 * 86400).alias("dormant"), when_text(F.min("start_time")).alias("first"), when_text(F.max("start_time")).alias("last"),
    )
    peak = top_per(hourly_pattern(own), ["subject"], [F.desc("n"), F.col("hour")], 1).select("subject", F.col("hour").alias("peak_hour"))
    favourite = lambda part, name: top_per(own.where(part & F.col("tower_id").isNotNull()).groupBy("subject", "tower_id").agg(F.count("*").alias("c")), ["subject"], [F.desc("c"), F.col("tower_id")], 1).select("subject", F.col("tower_id").alias(name))
    ip = ipdr.groupBy(F.col("msisdn").alias("subject")).agg(F.count("*").alias("sessions"))
    out = g.join(peak, "subject", "left").join(favourite(night, "night_tower"), "subject", "left").join(favourite(F.dayofweek("start_time").isin(1, 7), "weekend_tower"), "subject", "left")
    return out.join(ip, "subject", "left").na.fill(0, ["sessions"]).withColumn("per_day", F.round(F.col("records") / F.col("days"), 2))


def subject_kind(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """phone where a value is a party or number of a case, else ip."""
    phone = cdr.select("case_id", F.explode(F.array("a_party_number", "b_party_number", "msisdn")).alias("subject")).distinct().withColumn("kind", F.lit("phone"))
    ip = ipdr.select("case_id", F.explode(F.array("source_ip", "destination_ip")).alias("subject")).distinct().withColumn("kind", F.lit("ip"))
    both = phone.union(ip).where("subject IS NOT NULL")
    return both.groupBy("case_id", "subject").agg(F.max("kind").alias("kind"))
