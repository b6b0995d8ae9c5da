"""Transparent composite risk: factors with weights, summed by subject, with a watchlist override and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import behaviour as b
from . import copresence as h
from . import graph as g
from . import movement as m
from .reports import owned

# Weights of the factors of calling subjects and of addresses, and the bands of scores.
WEIGHTS = {
    "cloned_sim": 30, "impossible_travel": 22, "sim_multi_handset": 16, "burner_handset": 14, "hidden_link": 16, "convoy": 11, "periodic_contact": 8, "activity_burst": 8, "odd_hours": 7, "broker": 10, "cut_point": 8,
    "escalation": 9, "reactivation": 7, "shared_route": 8,
}
IP_WEIGHTS = {"tor_proxy": 18, "vpn": 12, "exfil": 16, "beaconing": 16}
BANDS = [(75, "critical"), (50, "high"), (25, "elevated"), (0, "low")]
LOW_EVIDENCE_MIN, LOW_EVIDENCE_CAP = 3, 49
#: Ids of an audit chain that are put in order at once.
STRETCH = 1_000_000
#: Of these only the first that a subject has counts.
ONE_OF = ["cloned_sim", "impossible_travel", "sim_multi_handset"]


def _named(df: DataFrame, subject: str, factor: str) -> DataFrame:
    return df.select(F.col(subject).alias("subject"), F.lit(factor).alias("factor")).distinct()


def cdr_factors(cdr: DataFrame, towers: DataFrame, network: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """subject, factor, weight: each factor once a subject; of cloned, impossible and multi-handset the strongest, of broker and cut point the first.

    Shared routes, brokers and cut points are those of the reports, which are top lists; ``network`` gives the last two
    (node) where they are known.
    """
    stream, own = m.streams(cdr, towers), owned(cdr)
    legs = m.legs(stream)
    clones = b.clone_corroboration(legs, cdr)
    devices = b.device_anomalies(cdr)
    burners = devices.where("kind = 'handset'").select(F.explode(F.split("others", ",")).alias("subject"))
    pairs = h.convoys(h.co_presence(stream), cdr)
    if network is None:
        contacts = g.edges(cdr)
        network = saved(g.brokers(contacts).select("node"), "brokers"), g.top_cut_points(contacts).select("node")
    brokers, cuts = network
    cuts = cuts.join(brokers, "node", "left_anti")
    both = lambda df, name: _named(df.select(F.explode(F.array("a", "b")).alias("s")), "s", name)
    parts = [
        _named(clones.where("cloned"), "subject", "cloned_sim"), _named(legs.where("impossible"), "subject", "impossible_travel"), _named(devices.where("kind = 'number'"), "key", "sim_multi_handset"),
        _named(burners, "subject", "burner_handset"), both(pairs.where("hidden_link"), "hidden_link"), both(pairs.where("convoy AND NOT hidden_link"), "convoy"), _named(b.odd_hours(own), "subject", "odd_hours"),
        _named(b.bursts(own), "subject", "activity_burst"), _named(b.periodic_contacts(cdr), "a_party_number", "periodic_contact"), _named(b.escalation(own), "subject", "escalation"),
        _named(b.dormancy(own), "subject", "reactivation"), both(m.shared_routes(stream), "shared_route"), _named(brokers, "node", "broker"), _named(cuts, "node", "cut_point"),
    ]
    rows = reduce(DataFrame.union, parts).where("subject IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, ONE_OF)), F.col("factor"))
    first = F.min(F.when(rank > 0, rank)).over(Window.partitionBy("subject"))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("factor")].cast("long")
    return rows.withColumn("r", rank).withColumn("f", first).where((F.col("r") == 0) | (F.col("r") == F.col("f"))).select("subject", "factor", weight.alias("weight"))


def ip_signals(ipdr: DataFrame) -> DataFrame:
    """subject, factor and the sessions behind it; a beacon to other than web ports is a factor each."""
    t, v, c = b.tunnel_use(ipdr), b.traffic_volume(ipdr), b.beacons(ipdr)
    named = lambda df, subject, factor, sessions: df.select(F.col(subject).alias("subject"), F.lit(factor).alias("factor"), F.expr(sessions).cast("long").alias("sessions"))
    parts = [
        named(t.where("proxy > 0"), "subject", "tor_proxy", "vpn + proxy"), named(t.where("vpn > 0"), "subject", "vpn", "vpn + proxy"),
        named(v.where("exfil"), "subject", "exfil", "sessions"), named(c.where("non_web"), "source_ip", "beaconing", "n"),
    ]
    return reduce(DataFrame.union, parts)


def ip_factors(ipdr: DataFrame) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in IP_WEIGHTS.items() for x in kv])[F.col("factor")].cast("long")
    return ip_signals(ipdr).select("subject", "factor", "sessions", weight.alias("weight"))


def scores(factors: DataFrame, events: DataFrame) -> DataFrame:
    """At most 100; at most LOW_EVIDENCE_CAP with under LOW_EVIDENCE_MIN events (subject, events); in bands."""
    s = factors.groupBy("subject").agg(F.least(F.lit(100), F.sum("weight")).alias("raw"), F.count("*").alias("factors"), F.array_join(F.sort_array(F.collect_list("factor")), ",").alias("why")).join(events, "subject", "left").na.fill(0, ["events"])
    s = s.withColumn("score", F.when(F.col("events") < LOW_EVIDENCE_MIN, F.least(F.lit(LOW_EVIDENCE_CAP), F.col("raw"))).otherwise(F.col("raw")).cast("long")).drop("raw")
    band = F.when(F.col("score") >= BANDS[0][0], BANDS[0][1])
    for least, name in BANDS[1:]:
        band = band.when(F.col("score") >= least, name)
    return s.withColumn("band", band)


def leaderboard(cdr: DataFrame, towers: DataFrame, network: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return scores(cdr_factors(cdr, towers, network), owned(cdr).groupBy("subject").agg(F.count("*").alias("events"))).orderBy(F.desc("score"), "subject")


def ip_leaderboard(ipdr: DataFrame) -> DataFrame:
    """Scores of addresses; the evidence of one is the most sessions of any of its signals."""
    factors = ip_factors(ipdr)
    return scores(factors, factors.groupBy("subject").agg(F.max("sessions").alias("events"))).orderBy(F.desc("score"), "subject")


def watchlist_kind(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(value.rlike(r"^\d{15}$"), "imei").otherwise("phone")


def with_watchlist(board: DataFrame, watch: DataFrame) -> DataFrame:
    """Subjects on the list (value) have score 100 and band critical."""
    hit = watch.select(F.col("value").alias("subject"), F.lit(True).alias("watched")).distinct()
    out = board.join(hit, "subject", "left").withColumn("watched", F.coalesce("watched", F.lit(False)))
    return out.withColumn("score", F.when(F.col("watched"), F.lit(100)).otherwise(F.col("score")).cast("long")).withColumn("band", F.when(F.col("watched"), "critical").otherwise(F.col("band")))


def watchlist_hits(phones: DataFrame, addresses: DataFrame, watch: DataFrame) -> DataFrame:
    """subject, kind: numbers of the list (value) on the board of calls, addresses of it on that of sessions; never crossed."""
    listed = watch.select(F.col("value").alias("subject"), watchlist_kind(F.col("value")).alias("kind")).distinct()
    on = lambda board, kind: listed.where(F.col("kind") == kind).join(board.select("subject"), "subject", "left_semi")
    return on(phones, "phone").union(on(addresses, "ip"))


def raised(board: DataFrame, hits: DataFrame, kind: str) -> DataFrame:
    """The board with its hits first: score 100, critical, and the match as first of the factors."""
    hit = F.col("hit").isNotNull()
    out = board.join(hits.where(F.col("kind") == kind).select("subject", F.lit(True).alias("hit")), "subject", "left")
    out = out.withColumns({
        "score": F.when(hit, F.lit(100)).otherwise(F.col("score")).cast("long"), "band": F.when(hit, "critical").otherwise(F.col("band")),
        "factors": F.col("factors") + F.when(hit, 1).otherwise(0), "why": F.when(hit, F.concat(F.lit("watchlist_match,"), "why")).otherwise(F.col("why")),
    })
    return out.drop("hit").orderBy(F.desc("score"), "subject")


def findings(cdr: DataFrame, towers: DataFrame) -> DataFrame:
    """Rule outputs as one table: severity, title, subject; the first of equal titles."""
    f = cdr_factors(cdr, towers)
    sev = F.when(F.col("weight") >= 18, "high").when(F.col("weight") >= 10, "medium").otherwise("low")
    return f.select(sev.alias("severity"), F.concat_ws(": ", "factor", "subject").alias("title"), "subject", F.col("factor").alias("category"))


def manifest(board: DataFrame) -> DataFrame:
    return board.groupBy("band").agg(F.count("*").alias("n"))


def audit_breaks(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows whose prev_hash is not the entry_hash before, or whose entry_hash is not the digest of their fields.

    The row before is that of the next smaller id, whatever gaps ids have. Ids are dealt to ranges of equal width;
    inside one they are put in order, and the first of each range meets the last of the nearest range before it.
    """
    text = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("prev_hash", *fields)]), 256)
    rows = rows.withColumn("good", F.col("entry_hash") == text).withColumn("stretch", F.floor(F.col("id") / STRETCH))
    ends = rows.groupBy("stretch").agg(F.max_by("entry_hash", "id").alias("end"))
    ends = ends.select("stretch", F.lag("end").over(Window.orderBy("stretch")).alias("end_before"))  # one row for STRETCH ids
    inside = F.lag("entry_hash").over(Window.partitionBy("stretch").orderBy("id"))
    first = F.lag("id").over(Window.partitionBy("stretch").orderBy("id")).isNull()
    both = rows.withColumn("inside", inside).withColumn("first", first).join(ends, "stretch")
    before = F.when(F.col("first"), F.col("end_before")).otherwise(F.col("inside"))
    alone = F.col("first") & F.col("end_before").isNull()
    kind = F.when(~F.col("good"), "content").when(~alone & ~F.col("prev_hash").eqNullSafe(before), "prev_hash")
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select("id", "kind")
