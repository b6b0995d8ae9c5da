"""Risk factors and scores of hand-made calls, as literals."""

from datetime import datetime, timedelta

from callgrid.operators import risk

T0 = datetime(2024, 1, 1, 10)
CDR = "id long, case_id string, a_party_number string, b_party_number string, msisdn string, call_type string, direction string, start_time timestamp_ntz, duration_seconds int, tower_id string, technology string, imei string, imsi string"


def test_factors(spark):
    """Two triangles joined by a bridge, two callers that share a handset, a cloned SIM and a number on two handsets."""
    triangles = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")]
    rows = [(60 * i, a, b, "M", {"e": "shared", "f": "shared"}.get(a, f"i{a}")) for i, (a, b) in enumerate(triangles)]
    rows += [(0, "x", "y", "M", "1"), (18, "x", "y", "D", "2"), (30, "x", "y", "D", "2"), (2000, "z", "y", "M", "3"), (2400, "z", "y", "M", "4")]
    cdr = spark.createDataFrame([(i, "1", a, b, a, "Voice", "MO", T0 + timedelta(minutes=m), 60, t, "4G", imei, "s" + a) for i, (m, a, b, t, imei) in enumerate(rows)], CDR)
    towers = spark.createDataFrame([("M", 13.0827, 80.2707), ("D", 28.6139, 77.209)], "tower_id string, latitude double, longitude double")
    got = {(r["subject"], r["factor"]): r["weight"] for r in risk.cdr_factors(cdr, towers).collect()}
    assert got == {
        ("x", "cloned_sim"): 30, ("z", "sim_multi_handset"): 16, ("e", "burner_handset"): 14, ("f", "burner_handset"): 14,
        ("c", "broker"): 10, ("d", "broker"): 10, ("y", "broker"): 10,
    }
    assert sum(risk.WEIGHTS.values()) == 174 and risk.WEIGHTS["impossible_travel"] == 22 and risk.WEIGHTS["hidden_link"] == 16


def test_scores(spark):
    factors = spark.createDataFrame([("a", "cloned_sim", 30), ("a", "convoy", 11), ("a", "hidden_link", 16), ("b", "cloned_sim", 30), ("b", "hidden_link", 16), ("b", "convoy", 11), ("c", "vpn", 12)] + [("d", f"f{i}", 30) for i in range(4)] + [("e", "exfil", 25)], "subject string, factor string, weight long")
    events = spark.createDataFrame([("a", 9), ("b", 2), ("d", 3)], "subject string, events long")
    got = {r["subject"]: (r["score"], r["band"], r["events"]) for r in risk.scores(factors, events).collect()}
    assert got == {"a": (57, "high", 9), "b": (49, "elevated", 2), "c": (12, "low", 0), "d": (100, "critical", 3), "e": (25, "elevated", 0)}


def test_audit_chain(spark, monkeypatch):
    """Gaps in the numbers are no breaks; an altered field and a deleted row are; ranges of numbers are joined up."""
    import hashlib

    monkeypatch.setattr(risk, "STRETCH", 10)
    rows, last = [], "genesis"
    for i in [1, 2, 5, 9, 30, 31, 47, 48, 60]:
        entry = hashlib.sha256(f"{last}\x1fu{i}\x1flogin".encode()).hexdigest()
        rows.append((i, f"u{i}", "login", last, entry))
        last = entry
    kind = "id long, username string, action string, prev_hash string, entry_hash string"
    breaks = lambda some: sorted((r["id"], r["kind"]) for r in risk.audit_breaks(spark.createDataFrame(some, kind), ["username", "action"]).collect())
    assert breaks(rows) == []
    assert breaks([r if r[0] != 9 else (9, "u9", "logout", *r[3:]) for r in rows]) == [(9, "content")]
    assert breaks([r for r in rows if r[0] != 30]) == [(31, "prev_hash")] and breaks([r for r in rows if r[0] != 47]) == [(48, "prev_hash")]
