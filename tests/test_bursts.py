"""Bursts at just two deviations: counted by whole numbers, whatever the order of days."""

from callgrid.operators.behaviour import bursts

#: Counts of days whose greatest is at just 2, 2 and 3.4375 deviations.
DAYS = [
    {1: 1, 2: 1, 3: 2, 6: 1, 8: 1, 9: 1, 10: 1, 11: 2, 12: 1, 13: 2, 15: 2, 19: 1, 20: 1, 21: 1, 23: 1, 25: 1, 26: 1, 28: 1, 29: 1, 30: 1},
    {4: 1, 5: 1, 6: 2, 7: 3, 8: 1, 9: 2, 12: 1, 14: 1, 16: 2, 17: 2, 20: 2, 22: 1, 23: 2, 25: 1, 26: 1, 27: 2, 28: 3, 29: 2},
    dict(zip((3, 4, 7, 12, 15, 17, 18, 19, 20, 21, 23, 25, 26, 27, 28, 29, 30), (5, 2, 2, 2, 1, 2, 1, 2, 2, 1, 2, 1, 1, 1, 2, 2, 1), strict=True)),
]


def test_days_at_the_limit(spark):
    """60 subjects of each kind, so that their days meet in many orders; one of equal days and one of two days have none."""
    rows = [(f"{kind}-{i}", f"2024-01-{d:02d} 10:00:00") for kind, days in enumerate(DAYS) for i in range(60) for d, n in days.items() for _ in range(n)]
    rows += [("even", f"2024-01-{d:02d} 10:00:00") for d in range(1, 6)] + [("short", f"2024-01-{d:02d} 10:00:00") for d in (1, 2, 2)]
    got = bursts(spark.createDataFrame(rows, "subject string, t string").selectExpr("subject", "cast(t as timestamp) as start_time")).collect()
    limit = ((2, 2.0), (3, 2.0), (5, 3.438))
    want = {(f"{kind}-{i}", f"2024-01-{d:02d}", n, limit[kind][1]) for kind, days in enumerate(DAYS) for i in range(60) for d, n in days.items() if n == limit[kind][0]}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_bursts_of_a_store(spark):
    """The bursts that a case's store holds are those of the exact rule."""
    from callgrid.operators.assembly import case_analytics

    rows = [(i, "1", f"{kind}-{i}", f"2024-01-{d:02d} 10:00:00") for kind, days in enumerate(DAYS) for i in range(40) for d, n in days.items() for _ in range(n)]
    cdr = spark.createDataFrame(rows, "id long, case_id string, a_party_number string, t string").selectExpr("id", "case_id", "a_party_number", "a_party_number as b_party_number", "cast(t as timestamp) as start_time")
    ipdr = spark.createDataFrame([], "id long, case_id string, source_ip string, msisdn string, start_time timestamp")
    got = case_analytics(cdr, ipdr)["bursts"]().groupBy("case_id", "n").count().collect()
    assert sorted(tuple(r) for r in got) == [("1", 2, 160), ("1", 3, 80), ("1", 5, 40)]
