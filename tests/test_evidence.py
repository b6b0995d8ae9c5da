"""Findings of hand-made calls, as literals."""

from datetime import datetime, timedelta

from callgrid.operators import evidence, modules
from callgrid.operators.reports import owned

T0 = datetime(2024, 1, 1, 10)
CDR = "id long, case_id string, a_party_number string, b_party_number string, msisdn string, call_type string, direction string, start_time timestamp_ntz, duration_seconds int, tower_id string, technology string, imei string, imsi string"


def calls(spark, rows):
    """rows: hours after T0, caller, called, seconds, handset, SIM."""
    return spark.createDataFrame([(i, "1", a, b, a, "Voice", "MO", T0 + timedelta(hours=h), d, "M", "4G", imei, imsi) for i, (h, a, b, d, imei, imsi) in enumerate(rows)], CDR)


def test_shifts(spark):
    """Six rows an hour apart and four in two hours (rates 1.2 and 2: 66.7 %, no mark); then four in half an hour (4 an hour: 233.3 %)."""
    def ten(name, step, late=lambda i: ("b", 60)):
        return [(i, name, "a", 60, "i", "s") for i in range(6)] + [(6 + step * i, name, *late(i), "i", "s") for i in range(4)]

    rows = ten("calm", 2 / 3) + ten("fast", 1 / 6) + ten("long", 1, lambda i: ("a", 109)) + ten("short", 1, lambda i: ("a", None)) + ten("nine", 0.01)[:9]
    rows += [(i, "social", f"c{i}", 60, "i", "s") for i in range(30)] + [(2 * i, "loses", f"d{min(i, 3)}", 60, "i", "s") for i in range(10)]
    got = sorted((r["subject"], r["type"], r["value"], r["severity"]) for r in evidence.shift_marks(owned(calls(spark, rows))).where("type <> 'Time-of-Day Pattern Shift'").collect())
    assert got == [
        ("fast", "Activity Level Change", 233.3, "High"), ("long", "Call Duration Shift", 81.667, "Low"), ("loses", "Contact Drop-off", 3.0, "Medium"), ("short", "Call Duration Shift", -100.0, "Low"),
        ("social", "Contact Drop-off", 18.0, "Medium"), ("social", "New Contact Surge", 12.0, "High"),
    ]


def test_shift_to_the_night(spark):
    rows = [(i * 24, "x", "a", 60, "i", "s") for i in range(9)] + [(i * 24 + 12, "x", "a", 60, "i", "s") for i in range(9, 15)]
    got = [(r["type"], r["value"], r["severity"]) for r in evidence.shift_marks(owned(calls(spark, rows))).collect()]
    assert got == [("Time-of-Day Pattern Shift", 1.0, "Medium")]


def test_gaps(spark):
    rows = [(0, "away", "a", 9, "i", "s"), (721, "away", "b", 9, "i", "s"), (0, "edge", "a", 9, "i", "s"), (720, "edge", "a", 9, "i", "s"), (0, "week", "a", 9, "i", "s"), (168, "week", "a", 9, "i", "s")]
    rows += [(2 * i, "often", f"c{i}", 9, "i", "s") for i in range(12)] + [(2 * i, "ten", "c", 9, "i", "s") for i in range(11)]
    cdr = owned(calls(spark, rows))
    got = sorted((r["subject"], r["kind"], r["severity"]) for r in evidence.gap_marks(modules.silences(cdr)).collect())
    assert got == [("away", "away", "High"), ("edge", "quiet", "Medium"), ("often", "frequent", "Medium")]
    gaps = sorted((r["i"], r["minutes"], r["before"], r["after"]) for r in evidence.first_gaps(cdr).where("subject = 'often'").collect())
    assert gaps == [(i + 1, 120.0, f"c{i}", f"c{i + 1}") for i in range(10)]


def test_call_findings(spark):
    rows = [(24 * i, "signals", "a", 4, "i", "s") for i in range(4)] + [(24 * i, "three", "a", 4, "i", "s") for i in range(3)]
    rows += [(24 * i - 8, "night", "a", 60, "i", "s") for i in range(1, 5)] + [(i / 30, "burst", f"c{i}", 60, "i", "s") for i in range(5)]
    cdr = owned(calls(spark, rows))
    got = sorted((r["subject"], r["kind"], r["n"]) for r in evidence.call_marks(modules.call_details(cdr), modules.call_bursts(cdr)).collect())
    assert got == [("burst", "bursts", 1), ("night", "odd_hours", 4), ("signals", "short", 4)]


def test_findings_rank_and_count(spark):
    """One title is one finding, the gravest; counts are of what is left."""
    part = lambda *rows: spark.createDataFrame(list(rows), "category string, title string, subject string, severity string, detail string")
    parts = [part(("Gap", "t1", "a", "Medium", "x"), ("Gap", "t1", "a", "High", "y"), ("Gap", "t2", "b", "Low", "z")), part(("Call", "t2", "b", "Low", "a"), ("Call", "t3", "c", "Medium", "q"), ("Call", "t3", "c", "Medium", "p"))]
    found = evidence.ranked(parts)
    assert sorted((r["title"], r["category"], r["severity"], r["detail"], r["weight"]) for r in found.collect()) == [("t1", "Gap", "High", "y", 75), ("t2", "Gap", "Low", "z", 25), ("t3", "Call", "Medium", "p", 50)]
    got = {(r["severity"], r["category"]): r["n"] for r in evidence.counts(found).collect()}
    assert got == {("High", None): 1, ("Low", None): 1, ("Medium", None): 1, (None, "Gap"): 2, (None, "Call"): 1, (None, None): 3}


def test_findings(spark):
    """A bridge between two triangles, one of whose callers swaps its SIM."""
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    rows = [(i, a, b, 60, f"i{a}", f"s{a}") for i, (a, b) in enumerate(edges)] + [(9, "a", "b", 60, "ia", "new")]
    towers = spark.createDataFrame([("M", 13.0, 80.0)], "tower_id string, latitude double, longitude double")
    got = {(r["category"], r["title"], r["severity"]) for r in evidence.findings(calls(spark, rows), towers).collect()}
    assert {("Identity", "SIM swap detected for a", "High"), ("Identity", "Multi-SIM usage: a", "Medium"), ("Network Structure", "Critical bridge: c ↔ d", "High"), ("Organization", "Potential leader identified: a", "High")} <= got
    assert {t for c, t, _ in got if c == "Network Role"} == {"Structural Broker: c", "Structural Broker: d"}
