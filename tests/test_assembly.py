"""Reports in one call, over hand-made calls and sessions."""

import json
from datetime import datetime, timedelta

from callgrid.functions import dims
from callgrid.operators import assembly, risk

T0 = datetime(2024, 1, 1, 10)
CDR = "id long, case_id string, a_party_number string, b_party_number string, msisdn string, call_type string, direction string, start_time timestamp_ntz, duration_seconds int, tower_id string, technology string, imei string, imsi string"
IPDR = "id long, case_id string, msisdn string, source_ip string, destination_ip string, destination_port int, source_port int, protocol string, apn string, rat string, tower_id string, imei string, imsi string, bytes_uploaded long, bytes_downloaded long, start_time timestamp_ntz"


def tables(spark):
    calls = [("1", "a", "b", 0), ("1", "a", "c", 1), ("2", "a", "b", 2), (None, "d", "a", 3)]
    cdr = spark.createDataFrame([(i, case, x, y, x, "Voice", "MO", T0 + timedelta(hours=h), 60, "M", "4G", "i" + x, "s" + x) for i, (case, x, y, h) in enumerate(calls)], CDR)
    ses = [("1", "a", "10.0.0.1", 1194), ("1", "z", "10.0.0.2", 443)]
    ipdr = spark.createDataFrame([(i, case, x, ip, "8.8.8.8", port, 50000, "UDP", None, None, "M", "i", "s", 10, 20, T0 + timedelta(hours=i)) for i, (case, x, ip, port) in enumerate(ses)], IPDR)
    return cdr, ipdr, spark.createDataFrame([("M", 13.0, 80.0)], "tower_id string, latitude double, longitude double")


def test_reports(spark):
    """Callers and called have the report of calls, others that of sessions; empty sections are there with 0."""
    cdr, ipdr, _ = tables(spark)
    kinds = {r["subject"]: r["kind"] for r in assembly.routed(cdr, ipdr).collect()}
    assert kinds == {"a": "cdr", "b": "cdr", "c": "cdr", "d": "cdr", "z": "ipdr", "10.0.0.1": "ipdr", "10.0.0.2": "ipdr"}
    report = assembly.subject_reports(cdr, ipdr, dims.isd(spark), dims.series(spark), dims.tac(spark))
    got = {(r["kind"], r["section"], r["subject"]): json.loads(r["row"]) for r in report.collect()}
    assert got["cdr", "daily_volume", "a"] == {"day": "2024-01-01", "n": 4} and got["ipdr", "ports", "z"] == {"port": 443, "protocol": "UDP", "n": 1}
    assert ("ipdr", "ports", "a") not in got
    n = {(r["section"], r["subject"]): r["n"] for r in assembly.section_counts(report, assembly.routed(cdr, ipdr), {"cdr": ["imei", "bank_sms"], "ipdr": ["ports"]}).collect()}
    assert n["imei", "a"] == 1 and n["bank_sms", "a"] == 0 and n["ports", "10.0.0.1"] == 1 and ("ports", "a") not in n


def test_cases_do_not_mix(spark):
    cdr, ipdr, _ = tables(spark)
    made = {key: build() for key, build in assembly.case_analytics(cdr, ipdr).items()}
    assert sorted((r["case_id"], r["subject"], r["n"]) for r in made["daily_volume"].collect()) == [("", "a", 1), ("", "d", 1), ("1", "a", 2), ("1", "b", 1), ("1", "c", 1), ("2", "a", 1), ("2", "b", 1)]
    assert {(r["case_id"], r["kind"]): (r["max_id"], r["rows"]) for r in made["watermark"].collect()} == {("1", "cdr"): (1, 2), ("2", "cdr"): (2, 1), ("", "cdr"): (3, 1), ("1", "ipdr"): (1, 2)}
    assert all(df.columns[0] == "case_id" for df in made.values())


def test_manifest(spark):
    """The twelve counts; a listed number counts as a hit only on the board of calls, an address only on that of sessions."""
    cdr, ipdr, towers = tables(spark)
    report = assembly.inferences(cdr, ipdr, towers)
    watch = spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), ("a",), ("nobody",)], "value string")
    hits = risk.watchlist_hits(report["cdr.risk"], report["ipdr.risk"], watch)
    assert sorted(map(tuple, hits.collect())) == [("10.0.0.1", "ip"), ("a", "phone")]
    got = {r["name"]: r["n"] for r in assembly.export_manifest(report, cdr, ipdr, hits).collect()}
    assert got == {
        "cdr_subjects": 2, "ipdr_sessions": 2, "persons_of_interest": 1, "flagged_ips": 1, "watchlist_hits": 2, "impossible_travel": 0, "hidden_links_convoys": 0, "network_roles": 2,  # a, as a broker and as a cut point
        "multi_sim_identities": 0, "behavioural_shifts": 0, "ipdr_vpn_proxy": 1, "ipdr_beaconing": 0,
    }
    (row,) = risk.raised(report["ipdr.risk"], hits, "ip").collect()
    assert (row["subject"], row["score"], row["band"], row["factors"], row["why"]) == ("10.0.0.1", 100, "critical", 2, "watchlist_match,vpn")
    assert risk.raised(report["ipdr.risk"], hits.where("subject = 'a'"), "ip").first()["score"] == 12
