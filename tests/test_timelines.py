"""Timelines, import counts and IPv6 attribution against literals."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from callgrid.functions import services as s
from callgrid.operators import attribution, movement, timelines
from callgrid.sources import readers

T0 = datetime(2024, 3, 4, 12)
CDR = "id long, a_party_number string, b_party_number string, msisdn string, imsi string, imei string, call_type string, direction string, start_time timestamp_ntz, duration_seconds int, tower_id string"
IPDR = "id long, source_ip string, destination_ip string, destination_port int, source_port int, protocol string, bytes_uploaded long, bytes_downloaded long, start_time timestamp_ntz, tower_id string"
TOWERS = "tower_id string, latitude double, longitude double, city string, state string"


def call(i, a, minutes, tower, b="B", kind="Voice"):
    return (i, a, b, a, None, f"H{a}", kind, "MO", None if minutes is None else T0 + timedelta(minutes=minutes), 10, tower)


def frames(spark):
    towers = spark.createDataFrame([("T1", 10.0, 70.0, "Here", "S"), ("T2", 11.0, 70.0, None, None), ("T3", None, None, None, None)], TOWERS)
    cdr = spark.createDataFrame([call(1, "A", 0, "T1"), call(2, "A", 60, "T2"), call(3, "A", 61, "T1"), call(4, "A", 61, "T2"), call(5, "A", 70, "T3"), call(6, "A", 80, "T1"), call(7, None, 5, "T1"), call(8, "A", None, "T2"), call(9, "C", 30, "T1", kind="SMS")], CDR)
    rows = [(1, "10.0.0.1", "157.240.1.1", 443, 50000, "TCP", 5, 6, T0, "T1"), (2, "10.0.0.1", "157.240.1.1", 443, 50000, "TCP", 5, None, T0 + timedelta(seconds=20), "T2"), (3, "10.0.0.1", "157.240.1.1", 443, 50000, "TCP", 1, 1, T0 + timedelta(hours=5), "T2"), (4, "10.0.0.2", "8.8.8.8", 1194, 50000, "UDP", 1, 1, T0 + timedelta(seconds=1), "T1")]
    return cdr, spark.createDataFrame(rows, IPDR), towers


def test_unified(spark):
    cdr, ipdr, towers = frames(spark)
    rows = timelines.unified(cdr, attribution.attribute(ipdr, s.networks(spark), s.ports(spark)), towers, s.families(spark)).collect()
    moves = {r["id"]: tuple(r["move"]) if r["move"] else None for r in rows if r["event_type"] == "Voice Call"}
    assert set(moves) == set(range(1, 10))
    assert moves[1] is moves[5] is moves[6] is moves[7] is moves[8] is moves[9] is None  # no row before, no position, no caller, no time
    assert moves[2] == ("T1", 111.2, 60.0, 111.2, "road", False)
    assert moves[3] == ("T2", 111.2, 1.0, 6671.7, "impossible", True)
    assert moves[4] == ("T1", 111.2, 0.0, None, "impossible", True)
    sessions = [(r["time"], r["subject"], r["seconds"], r["tower_id"], r["session"]["rows"], r["session"]["up"], r["session"]["down"], r["service"]) for r in rows if r["event_type"] == "IP Session"]
    assert [x[:7] for x in sessions] == [(T0, "10.0.0.1", 20, "T1", 2, 10, 6), (T0 + timedelta(seconds=1), "10.0.0.2", 0, "T1", 1, 1, 1), (T0 + timedelta(hours=5), "10.0.0.1", 0, "T2", 1, 1, 1)]
    assert all(x[7] for x in sessions)
    assert [r["time"] is None for r in rows] == [False] * 11 + [True] * 4  # a call without a time and the towers come last
    assert [r["subject"] for r in rows[-3:]] == ["T1", "T2", "T3"] and rows[-3]["tower"]["city"] == "Here"
    times = [r["time"] for r in rows[:11]]
    assert times == sorted(times)


def test_simple(spark):
    cdr, ipdr, towers = frames(spark)
    rows = timelines.simple(cdr, attribution.attribute(ipdr, s.networks(spark), s.ports(spark)), towers).collect()
    assert len(rows) == 9 + 4 + 3
    events = {r["event"] for r in rows}
    assert {"A called B", "10.0.0.2 -> 8.8.8.8", "Tower T3 registered"} <= events
    empty = timelines.simple(cdr.limit(0), attribution.attribute(ipdr.limit(0), s.networks(spark), s.ports(spark)), towers.limit(0))
    assert empty.count() == 0


def test_subject(spark):
    cdr, _, towers = frames(spark)
    events, summary = timelines.of_subject(cdr, towers, "A")
    assert [r["id"] for r in events.collect()] == [1, 2, 3, 4, 5, 6]
    got = summary.collect()
    assert len(got) == 1 and got[0]["event_count"] == 6 and got[0]["movement"]["impossible"] == 2 and got[0]["movement"]["road"] == 1
    assert got[0]["baseline"] is None and got[0]["escalation"] is None and got[0]["dormancy"] is None
    assert timelines.of_subject(cdr, towers, "nobody")[1].count() == 0
    silent = cdr.union(spark.createDataFrame([call(20, "A", 60 * 24 * 20, "T1")], CDR))
    row = timelines.summaries(movement.streams(silent, towers)).where("subject = 'A'").first()
    assert row["dormancy"]["days"] == 19 and row["dormancy"]["after"] == 1 and row["baseline"]["days"] == 2 and row["baseline"]["peak_day"] == "2024-03-04"


def test_observed_counts(spark):
    rows = [("A", "B", "2024-01-01 10:00:00", "2024-01-01 10:01:00", "60"), ("A", "B", "soon", "later", "60"), ("A", "B", None, "later", "x"), ("A", "B", "01/02/2024 10:00:00", None, "1")] + [("A", str(i), "never", None, "1") for i in range(9)]
    raw = spark.createDataFrame(rows, "a_party_number string, b_party_number string, start_time string, end_time string, duration_seconds string")
    report = readers.import_report(raw, "cdr").first()
    assert tuple(report) == (13, 2, 11, 10, 2, 12)
    good, rejected, seen = readers.observed(raw, "cdr")
    assert good.count() == 2
    assert seen.get == {"total": 13, "imported": 2, "dropped": 11, "start_failed": 10, "end_failed": 2}
    assert readers.examples(rejected).count() == 5 and rejected.count() == 11


def test_ipv6_destinations_are_attributed(spark):
    rows = [(1, "10.0.0.1", "2001:4860:4860::8888", 443, 50000, "TCP", 5, 6, T0, "T1"), (2, "10.0.0.1", "2a03:2880::1", 443, 50000, "TCP", 5, 6, T0, "T1"), (3, "2409:4000::9", "93.184.216.1", 9999, 50000, "TCP", 5, 6, T0, "T1"), (4, "10.0.0.1", "fd00::1", 443, 50000, "TCP", 5, 6, T0, "T1")]
    wide = spark.createDataFrame([(1, "Google", False, "2001:4860::/32"), (2, "Google Public DNS", False, "2001:4860:4860::/48"), (3, "Jio", True, "2409:4000::/22")], "ord long, provider string, is_isp boolean, cidr string")
    got = {r["id"]: r for r in attribution.attribute(spark.createDataFrame(rows, IPDR), s.networks(spark), s.ports(spark), wide).collect()}
    assert (got[1]["provider"], got[1]["service"], got[1]["category"], got[1]["confidence"]) == ("Google Public DNS", "Likely Google Public DNS", "content", 90)
    assert got[2]["provider"] is None and got[4]["provider"] is None
    assert got[3]["provider"] == "Jio"
    plain = attribution.attribute(spark.createDataFrame(rows, IPDR), s.networks(spark), s.ports(spark))
    assert plain.where(F.col("provider").isNotNull()).count() == 0
