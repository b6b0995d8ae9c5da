"""Many reports in one call: the sections of a subject's report, the inference report, all analytics of a case."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import behaviour, copresence, graph, modules, risk
from . import movement as m
from . import reports as r

SEPARATOR = "\u001f"


def cased(rows: DataFrame) -> DataFrame:
    """Rows whose subject is that of one case, so that reports by subject are also by case."""
    return rows.withColumn("subject", F.concat_ws(SEPARATOR, F.coalesce("case_id", F.lit("")), "subject"))


def uncased(report: DataFrame) -> DataFrame:
    """The report with case_id and the plain subject."""
    parts = F.split("subject", SEPARATOR, 2)
    return report.select(parts[0].alias("case_id"), parts[1].alias("subject"), *[c for c in report.columns if c != "subject"])


def cdr_sections(cdr: DataFrame, prefixes: DataFrame, series: DataFrame, tac: DataFrame) -> dict[str, DataFrame]:
    """The fourteen sections of a subject's call report, for all subjects."""
    both, own = r.involved(cdr), r.owned(cdr)
    return {
        "daily_volume": r.volume_by_day(both), "hourly": r.hourly_pattern(both), "towers": r.tower_footprint(own), "off_periods": r.off_periods(both), "first_last": r.day_first_last(both),
        "single_days": r.single_days(both), "weekdays": r.weekday_table(both), "longest_calls": r.longest_calls(both), "day_night": r.day_night(both, own), "isd": r.isd_calls(both, prefixes),
        "other_circle": r.other_circle(both, series), "imei": r.device_summary(own, "imei", tac), "imsi": r.device_summary(own, "imsi"), "bank_sms": r.bank_sms(both),
    }


def ipdr_sections(ipdr: DataFrame) -> dict[str, DataFrame]:
    """The eight sections of a subject's session report."""
    rows, source = r.sessions_of(ipdr), ipdr.where("source_ip IS NOT NULL").withColumn("subject", F.col("source_ip"))
    return {
        "daily_traffic": r.traffic_by_day(rows), "hourly": r.hourly_pattern(rows), "towers": r.tower_footprint(rows), "off_periods": r.off_dates(rows),
        "breakdown": r.breakdown(rows), "destinations": r.destinations(ipdr), "throughput": r.traffic_by_day(source), "ports": r.port_usage(rows),
    }


def as_rows(sections: dict[str, DataFrame], kind: str) -> DataFrame:
    """kind, section, subject and each row of it as JSON: sections of unlike columns in one table."""
    one = lambda name, df: df.select(F.lit(kind).alias("kind"), F.lit(name).alias("section"), "subject", F.to_json(F.struct(*[c for c in df.columns if c != "subject"])).alias("row"))
    return reduce(DataFrame.union, [one(name, df) for name, df in sections.items()])


def routed(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """subject and kind of its report: 'cdr' if it takes part in any call, else 'ipdr'."""
    calls = r.involved(cdr).select("subject").distinct().withColumn("kind", F.lit("cdr"))
    return calls.union(r.sessions_of(ipdr).select("subject").distinct().join(calls, "subject", "left_anti").withColumn("kind", F.lit("ipdr")))


def subject_reports(cdr: DataFrame, ipdr: DataFrame, prefixes: DataFrame, series: DataFrame, tac: DataFrame) -> DataFrame:
    """kind, section, subject, row: the whole report of every subject, by calls or else by sessions."""
    kind = saved(routed(cdr, ipdr), "routes")
    rows = as_rows(cdr_sections(cdr, prefixes, series, tac), "cdr").union(as_rows(ipdr_sections(ipdr), "ipdr"))
    return rows.join(kind, ["subject", "kind"], "left_semi")


def section_counts(report: DataFrame, subjects: DataFrame, sections: dict[str, list[str]]) -> DataFrame:
    """kind, section, subject, n for each section of a subject's kind, 0 for an empty one."""
    names = F.create_map(*[x for kind, s in sections.items() for x in (F.lit(kind), F.array(*map(F.lit, s)))])
    shell = subjects.select("subject", "kind", F.explode(names[F.col("kind")]).alias("section"))
    return shell.join(report.groupBy("kind", "section", "subject").agg(F.count("*").alias("n")), ["kind", "section", "subject"], "left").na.fill(0, ["n"])


def inferences(cdr: DataFrame, ipdr: DataFrame, towers: DataFrame) -> dict[str, DataFrame]:
    """The inference report: every analysis of calls (cdr.*) and of sessions (ipdr.*), and both boards of risk.

    The streams and legs that most of them read are written once.
    """
    stream = saved(m.streams(cdr, towers), "streams")
    own = r.owned(cdr)
    legs = saved(m.legs(stream), "legs")
    e = saved(graph.edges(cdr), "edges")
    brokers = saved(graph.brokers(e), "brokers")
    cuts = saved(graph.top_cut_points(e), "cut-points")
    return {
        "cdr.movement": m.profile(stream), "cdr.impossible_travel": m.first_impossible(stream), "cdr.co_presence": copresence.convoys(copresence.co_presence(stream), cdr), "cdr.shared_routes": m.shared_routes(stream),
        "cdr.brokers": brokers, "cdr.cut_points": cuts, "cdr.one_way": graph.one_way_ties(cdr), "cdr.relays": graph.relays(cdr), "cdr.odd_hours": behaviour.odd_hours(own),
        "cdr.bursts": behaviour.bursts(own), "cdr.escalation": behaviour.escalation(own), "cdr.dormancy": behaviour.dormancy(own), "cdr.first_contacts": behaviour.first_contacts(cdr), "cdr.periodic_contacts": behaviour.periodic_contacts(cdr),
        "cdr.devices": behaviour.device_anomalies(cdr), "cdr.clones": behaviour.clone_corroboration(legs, cdr), "cdr.entities": graph.resolve_entities(cdr), "cdr.risk": risk.leaderboard(cdr, towers, (brokers.select("node"), cuts.select("node"))),
        "ipdr.tunnels": behaviour.tunnel_use(ipdr), "ipdr.volume": behaviour.traffic_volume(ipdr), "ipdr.beaconing": behaviour.beacons(ipdr), "ipdr.destinations": behaviour.rare_destinations(ipdr), "ipdr.risk": risk.ip_leaderboard(ipdr),
    }


def export_manifest(report: dict[str, DataFrame], cdr: DataFrame, ipdr: DataFrame, hits: DataFrame) -> DataFrame:
    """name, n: the twelve counts that an export of the inference report states; ``hits`` are those of ``risk.watchlist_hits``."""
    roles = report["cdr.brokers"].select("node").union(report["cdr.cut_points"].select("node"))
    tunnels = report["ipdr.tunnels"].where("vpn > 0 OR proxy > 0")
    parts = {
        "cdr_subjects": r.owned(cdr).select("a_party_number").distinct(), "ipdr_sessions": ipdr, "persons_of_interest": report["cdr.risk"], "flagged_ips": report["ipdr.risk"], "watchlist_hits": hits,
        "impossible_travel": report["cdr.impossible_travel"].select("subject").distinct(), "hidden_links_convoys": report["cdr.co_presence"].where("hidden_link OR convoy"), "network_roles": roles,
        "multi_sim_identities": report["cdr.entities"], "behavioural_shifts": report["cdr.escalation"].select("subject").union(report["cdr.dormancy"].select("subject")), "ipdr_vpn_proxy": tunnels, "ipdr_beaconing": report["ipdr.beaconing"],
    }
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()])


def summary(cdr: DataFrame, ipdr: DataFrame, towers: DataFrame, found: DataFrame) -> DataFrame:
    """One row: what a run over all modules read, and how many findings it gave (``evidence.ranked``)."""
    c = cdr.agg(F.count("*").alias("cdr_count"), F.countDistinct("a_party_number").alias("subjects"), F.date_format(F.min("start_time"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("start_time"), "yyyy-MM-dd").alias("last_day"))
    n = found.agg(F.count("*").alias("findings"), F.count_if(F.col("severity").isin("Critical", "High")).alias("high_priority"))
    return c.crossJoin(ipdr.agg(F.count("*").alias("ipdr_count"))).crossJoin(towers.agg(F.count("*").alias("towers"))).crossJoin(n)  # one row each


def case_analytics(cdr: DataFrame, ipdr: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """What a case's store holds, as builders for ``store.publish``: each table has case_id, and cases never mix."""
    own = cased(r.owned(cdr))
    both = cased(r.involved(cdr))
    sessions = cased(r.sessions_of(ipdr))
    by_case = lambda df: F.coalesce(df["case_id"], F.lit(""))
    return {
        "subjects": lambda: cdr.where("a_party_number IS NOT NULL").select(by_case(cdr).alias("case_id"), F.lit("cdr").alias("kind"), F.col("a_party_number").alias("subject")).union(ipdr.where("source_ip IS NOT NULL").select(by_case(ipdr), F.lit("ipdr"), "source_ip")).distinct(),
        "daily_volume": lambda: uncased(r.volume_by_day(both)), "hourly": lambda: uncased(r.hourly_pattern(both)), "towers": lambda: uncased(r.tower_footprint(own)), "weekdays": lambda: uncased(r.weekday_table(both)),
        "time_profile": lambda: uncased(modules.time_profile(own)), "bursts": lambda: uncased(behaviour.bursts(own)), "odd_hours": lambda: uncased(behaviour.odd_hours(own)), "silences": lambda: uncased(modules.silences(own)),
        "identity": lambda: uncased(behaviour.identity_report(own)), "traffic": lambda: uncased(r.traffic_by_day(sessions)), "ports": lambda: uncased(r.port_usage(sessions)),
        "watermark": lambda: cdr.select(by_case(cdr).alias("case_id"), F.lit("cdr").alias("kind"), "id").union(ipdr.select(by_case(ipdr), F.lit("ipdr"), "id")).groupBy("case_id", "kind").agg(F.max("id").alias("max_id"), F.count("*").alias("rows")),
    }
