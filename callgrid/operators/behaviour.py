"""Behaviour in time, identity, and session-level signals of addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import day, epoch, joined, top_per, when_text
from .movement import by_subject

MIB = 1 << 20
#: Ports of tunnels, and of proxies and anonymity networks (fixed values).
VPN_PORTS = [500, 1194, 1195, 1701, 1723, 4500, 51820, 51821]
PROXY_PORTS = [1080, 3128, 8118, 9001, 9030, 9050, 9051]
WEB_PORTS = [80, 443]


def daily_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject", day().alias("day")).agg(F.count("*").alias("n"))


def _moments() -> tuple[Column, Column, Column]:
    w = Window.partitionBy("subject")
    return F.avg("n").over(w), F.stddev_pop("n").over(w), F.count("*").over(w)


def bursts(rows: DataFrame, z: float = 2.0, least_days: int = 3) -> DataFrame:
    """Days at least two deviations above the subject's mean; on none where all days are equal.

    With whole numbers, so that a day at just two deviations counts whatever the order of days: with d days, s rows
    and q as the sum of the squares of n, the score is (d n - s) / sqrt(d q - s s).
    """
    w = Window.partitionBy("subject")
    whole = lambda c: c.cast("decimal(19,0)")
    days, total, squares = F.count("*").over(w), F.sum("n").over(w), F.sum(F.col("n") * F.col("n")).over(w)
    s = daily_counts(rows).withColumns({"days": days, "s": total, "q": squares})
    s = s.withColumns({"over": (F.col("days") * F.col("n") - F.col("s")).cast("double"), "spread": (whole(F.col("days")) * whole(F.col("q")) - whole(F.col("s")) * whole(F.col("s"))).cast("double")})
    high = (F.col("over") > 0) & (F.col("over") * F.col("over") >= z * z * F.col("spread"))
    return s.where((F.col("days") >= least_days) & high).select("subject", "day", "n", F.round(F.col("over") / F.sqrt("spread"), 3).alias("z"))


def odd_hours(rows: DataFrame, share: float = 0.2, least: int = 3) -> DataFrame:
    n = F.count_if(F.hour("start_time").between(1, 4))
    g = rows.groupBy("subject").agg(n.alias("odd"), F.count("*").alias("events"))
    return g.where((F.col("odd") >= least) & (F.col("odd") / F.col("events") >= share)).withColumn("share", F.round(F.col("odd") / F.col("events"), 3))


def cadence(rows: DataFrame, keys: list[str], least: int, hours: float, cv: float) -> DataFrame:
    """Regular series: enough rows, a long enough span and a small coefficient of variation of the gaps."""
    w = Window.partitionBy(*keys).orderBy("start_time", "id")
    gap = (epoch("start_time") - epoch(F.lag("start_time").over(w))) / 3600
    g = rows.withColumn("gap", gap).groupBy(*keys).agg(
        F.count("*").alias("n"), ((epoch(F.max("start_time")) - epoch(F.min("start_time"))) / 3600).alias("span"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd")
    )
    out = g.where((F.col("n") >= least) & (F.col("span") >= hours) & (F.col("mean") > 0)).withColumn("cv", F.col("sd") / F.col("mean"))
    return out.where(F.col("cv") <= cv).select(*keys, "n", F.round("mean", 3).alias("mean_hours"), F.round("cv", 3).alias("cv"))


def periodic_contacts(cdr: DataFrame, least: int = 4, hours: float = 12, cv: float = 0.35) -> DataFrame:
    return cadence(cdr.where("a_party_number IS NOT NULL AND b_party_number IS NOT NULL"), ["a_party_number", "b_party_number"], least, hours, cv)


def baseline(rows: DataFrame) -> DataFrame:
    d = daily_counts(rows)
    g = d.groupBy("subject").agg(
        F.count("*").alias("days"), F.sum("n").alias("events"), F.datediff(F.max(F.to_date("day")), F.min(F.to_date("day"))).cast("long").alias("span"),
        F.round(F.avg("n"), 3).alias("mean"), F.round(F.stddev_pop("n"), 3).alias("sd"), F.min_by("day", F.struct(-F.col("n"), F.col("day"))).alias("peak_day"),
    )
    return g.where("events >= 5 AND days >= 2")


def escalation(rows: DataFrame, least_days: int = 5, factor: float = 2, level: float = 3) -> DataFrame:
    """The median of the later half of active days is at least 3 and twice that of the earlier half."""
    w = Window.partitionBy("subject")
    d = daily_counts(rows).withColumn("i", F.row_number().over(w.orderBy("day"))).withColumn("days", F.count("*").over(w))
    half = F.floor(F.col("days") / 2)
    g = d.where(F.col("days") >= least_days).groupBy("subject", "days").agg(F.percentile(F.when(F.col("i") <= half, F.col("n")), 0.5).alias("early"), F.percentile(F.when(F.col("i") > half, F.col("n")), 0.5).alias("late"))
    return g.where((F.col("late") >= level) & (F.col("late") >= factor * F.col("early")))


def dormancy(rows: DataFrame, days: int = 14, least: int = 4) -> DataFrame:
    """The longest silence, if of 14 whole days, and the rows from its end on."""
    w = by_subject()
    g = rows.select("subject", "start_time", "id", F.lag("start_time").over(w).alias("b"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("subject")).alias("n"))
    g = g.withColumn("days", F.floor((epoch("start_time") - epoch("b")) / 86400)).where((F.col("n") >= least) & (F.col("days") >= days))
    return top_per(g, ["subject"], [F.desc("days"), F.col("i")], 1).select("subject", "days", when_text("b").alias("last"), when_text("start_time").alias("back"), (F.col("n") - F.col("i") + 1).cast("long").alias("after"))


def first_contacts(cdr: DataFrame, n: int = 12) -> DataFrame:
    g = cdr.where("a_party_number <> b_party_number").groupBy(F.least("a_party_number", "b_party_number").alias("a"), F.greatest("a_party_number", "b_party_number").alias("b")).agg(F.min("start_time").alias("first"))
    return g.orderBy(F.desc("first"), "a", "b").limit(n).select("a", "b", when_text("first").alias("first"))


def spikes(rows: DataFrame, z: float = 2.5, least_days: int = 5, least: int = 20) -> DataFrame:
    mean, sd, days = _moments()
    s = daily_counts(rows).withColumns({"mean": mean, "sd": sd, "days": days}).where((F.col("days") >= least_days) & (F.col("n") >= least) & (F.col("sd") > 0))
    s = s.withColumn("z", (F.col("n") - F.col("mean")) / F.col("sd")).where(F.col("z") > z)
    return s.select("subject", "day", "n", F.round("z", 3).alias("z"), F.round(100 * (F.col("n") - F.col("mean")) / F.col("mean"), 1).alias("excess_pct"))


def service_bursts(rows: DataFrame, factor: float = 3, least: int = 10) -> DataFrame:
    d = rows.groupBy("subject", "service", day().alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("subject", "service")
    d = d.withColumns({"mean": F.avg("n").over(w), "total": F.sum("n").over(w)})
    return d.where((F.col("total") >= least) & (F.col("n") > factor * F.col("mean"))).select("subject", "service", "day", "n")


# --- identity --------------------------------------------------------------------------------------------


def device_anomalies(cdr: DataFrame) -> DataFrame:
    """Numbers in several handsets (with their SIMs) and handsets with several numbers."""
    a = cdr.where("msisdn IS NOT NULL AND imei IS NOT NULL").groupBy(F.col("msisdn").alias("key")).agg(F.countDistinct("imei").alias("n"), joined(F.col("imei")).alias("others"), joined(F.col("imsi")).alias("imsis")).where("n > 1")
    b = cdr.where("msisdn IS NOT NULL AND imei IS NOT NULL").groupBy(F.col("imei").alias("key")).agg(F.countDistinct("msisdn").alias("n"), joined(F.col("msisdn")).alias("others")).where("n > 1")
    return a.withColumn("kind", F.lit("number")).unionByName(b.withColumn("imsis", F.lit(None).cast("string")).withColumn("kind", F.lit("handset")))


def clone_corroboration(legs: DataFrame, cdr: DataFrame) -> DataFrame:
    """Impossible travel of numbers that are also seen in several handsets."""
    many = device_anomalies(cdr).where("kind = 'number'").select(F.col("key").alias("subject"), F.col("n").alias("handsets"))
    return legs.where("impossible").groupBy("subject").agg(F.count("*").alias("legs")).join(many, "subject", "left").na.fill(1, ["handsets"]).withColumn("cloned", F.col("handsets") > 1)


def identity_states(rows: DataFrame) -> DataFrame:
    """Runs of one (handset, SIM): a return to an earlier pair is a new run."""
    w = by_subject()
    change = F.when(F.row_number().over(w) == 1, 1).when(F.lag("imei").over(w).eqNullSafe(F.col("imei")) & F.lag("imsi").over(w).eqNullSafe(F.col("imsi")), 0).otherwise(1)
    runs = rows.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    return runs.groupBy("subject", "run").agg(F.first("imei").alias("imei"), F.first("imsi").alias("imsi"), F.count("*").alias("n"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))


def transitions(states: DataFrame) -> DataFrame:
    w = Window.partitionBy("subject").orderBy("run")
    before = lambda c: F.lag(c).over(w)
    s = states.select("subject", "run", "imei", "imsi", before("imei").alias("imei0"), before("imsi").alias("imsi0"), before("run").alias("run0")).where("run0 IS NOT NULL")
    gone = F.col("imei").isNull() | F.col("imsi").isNull() | F.col("imei0").isNull() | F.col("imsi0").isNull()
    d, m = F.col("imei") != F.col("imei0"), F.col("imsi") != F.col("imsi0")
    kind = F.when(gone, "partial").when(d & m, "combined").when(m, "sim_swap").when(d, "device_change").otherwise("same")
    conf = F.when(gone, 40).when(d & m, 60).when(m, 85).when(d, 80).otherwise(0)
    return s.select("subject", "run", kind.alias("kind"), conf.cast("long").alias("confidence"))


def identity_report(rows: DataFrame) -> DataFrame:
    """Changes of handset or SIM among rows that have both, and a burner score: distinct pairs per hundred rows, over five rows."""
    full = rows.where("imei IS NOT NULL AND imsi IS NOT NULL")
    changes = transitions(identity_states(full)).groupBy("subject").agg(F.count_if(F.col("kind") == "sim_swap").alias("swaps"), F.count_if(F.col("kind") == "device_change").alias("devices"), F.count_if(F.col("kind") == "combined").alias("both"))
    n = rows.groupBy("subject").agg(F.count("*").alias("rows"), F.countDistinct("imei", "imsi").alias("pairs"))
    score = F.when(F.col("rows") > 5, F.floor(100 * F.col("pairs") / F.col("rows"))).otherwise(0)
    out = n.join(changes, "subject", "left").na.fill(0).withColumn("burner", score.cast("long"))
    return out.withColumn("suspected", (F.col("burner") > 30) | (F.col("swaps") + F.col("devices") + F.col("both") > 0))


def deep_identity(rows: DataFrame) -> DataFrame:
    """As identity_report with cycling of handsets: returns to the one before last, and a weighted score."""
    s = identity_states(rows.where("imei IS NOT NULL"))
    w = Window.partitionBy("subject").orderBy("run")
    dev = s.withColumn("b", F.lag("imei").over(w)).where("b IS NULL OR b <> imei")
    back = dev.withColumns({"x1": F.lag("imei", 1).over(w), "x2": F.lag("imei", 2).over(w)})
    g = back.groupBy("subject").agg(F.count("*").alias("steps"), F.count_if((F.col("imei") == F.col("x2")) & (F.col("imei") != F.col("x1"))).alias("returns"))
    cyc = F.when(F.col("steps") - 1 >= 3, F.least(F.lit(100), F.floor(200 * F.col("returns") / F.col("steps")))).otherwise(0)
    n = rows.groupBy("subject").agg(F.count("*").alias("rows"), F.countDistinct("imei", "imsi").alias("pairs"), F.countDistinct("imei").alias("imeis"), F.countDistinct("imsi").alias("imsis"))
    out = n.join(g.select("subject", "steps", cyc.cast("long").alias("cycling")), "subject", "left").na.fill(0)
    score = F.floor(40 * F.col("pairs") / F.col("rows") + 20 * F.least(F.col("imeis"), F.lit(10)) / 10 + 20 * F.least(F.col("imsis"), F.lit(10)) / 10 + 20 * F.col("cycling") / 100)
    return out.withColumn("burner", score.cast("long")).withColumn("suspected", (F.col("burner") > 25) | (F.col("steps") - 1 > 2)).drop("steps")


# --- addresses -------------------------------------------------------------------------------------------


def tunnel_use(ipdr: DataFrame) -> DataFrame:
    p = F.col("destination_port")
    vpn, proxy = p.isin(VPN_PORTS), p.isin(PROXY_PORTS)
    g = ipdr.where(vpn | proxy).groupBy(F.col("source_ip").alias("subject")).agg(
        F.count_if(vpn).alias("vpn"), F.count_if(proxy).alias("proxy"), F.array_join(F.transform(F.sort_array(F.collect_set(p)), lambda x: x.cast("string")), ",").alias("ports"),
        F.array_join(F.slice(F.sort_array(F.collect_set("destination_ip")), 1, 6), ",").alias("servers"),
    )
    return g


def traffic_volume(ipdr: DataFrame, n: int = 15, mib: int = 50, ratio: float = 3) -> DataFrame:
    """Bytes by source; exfiltration: at least 50 MiB up and three times what came down."""
    rows = ipdr.where("bytes_uploaded IS NOT NULL OR bytes_downloaded IS NOT NULL")
    g = rows.groupBy(F.col("source_ip").alias("subject")).agg(F.coalesce(F.sum("bytes_uploaded"), F.lit(0)).alias("up"), F.coalesce(F.sum("bytes_downloaded"), F.lit(0)).alias("down"), F.count("*").alias("sessions"))
    g = g.withColumn("exfil", (F.col("up") >= mib * MIB) & ((F.col("down") == 0) | (F.col("up") >= ratio * F.col("down"))))
    return g.orderBy(F.desc("up"), "subject").limit(n)


def beacons(ipdr: DataFrame, n: int = 15, least: int = 4, hours: float = 6, cv: float = 0.25) -> DataFrame:
    port = ipdr.where("destination_port IS NOT NULL").groupBy("source_ip", "destination_ip").agg(F.max_by("destination_port", F.struct("start_time", "id")).cast("long").alias("port"))
    out = cadence(ipdr, ["source_ip", "destination_ip"], least, hours, cv).join(port, ["source_ip", "destination_ip"], "left")
    return out.withColumn("non_web", ~F.coalesce(F.col("port").isin(WEB_PORTS), F.lit(False))).orderBy("cv", "source_ip", "destination_ip").limit(n)


def rare_destinations(ipdr: DataFrame, sources: int = 2, least: int = 3, each: int = 5) -> DataFrame:
    """Destinations of at most two sources that a source uses three times or more, its five most used."""
    p = ipdr.where("destination_ip IS NOT NULL").groupBy(F.col("source_ip").alias("subject"), "destination_ip").agg(F.count("*").alias("n"))
    few = p.groupBy("destination_ip").agg(F.count("*").alias("sources")).where(F.col("sources") <= sources)
    return top_per(p.where(F.col("n") >= least).join(few, "destination_ip"), ["subject"], [F.desc("n"), F.col("destination_ip")], each)
