"""Subjects that ever met, by bits, against plain loops and the distinct pairs of all meetings."""

import random
from datetime import datetime, timedelta

import pytest

from callgrid.operators import copresence, meetingpairs


@pytest.mark.parametrize("group", [5, 30_000])
def test_distinct_pairs(spark, monkeypatch, group):
    """Many groups and few, chunks of few meetings, rows at one time, at the window's very end, and beyond it."""
    monkeypatch.setattr(meetingpairs, "GROUP", group)
    monkeypatch.setattr(meetingpairs, "AT_ONCE", 7)
    r = random.Random(group)
    rows = [(f"p{r.randrange(4)}", f"s{r.randrange(40):02d}", r.randrange(0, 2000) * 100) for _ in range(300)] + [("q", "x", 0), ("q", "y", 1000), ("q", "z", 2001), ("q", "x", 2001)]
    near = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and abs(a[2] - b[2]) <= 1000}
    df = spark.createDataFrame(rows, "k string, subject string, us long")
    assert meetingpairs.distinct_pairs(df, ["k"], 1000).first()["pairs"] == len(near)
    assert meetingpairs.distinct_pairs(df.where("false"), ["k"], 1000).first()["pairs"] == 0


def test_meeting_counts(spark):
    """The same row as of the table of all meetings, null cases, towers and callers among them."""
    r = random.Random(1)
    t = datetime(2024, 1, 1)
    rows = [(i, r.choice(["1", "2", None]), r.choice(["T1", "T2", None]), r.choice([f"s{k}" for k in range(30)] + [None]), t + timedelta(seconds=r.randrange(40_000))) for i in range(600)]
    cdr = spark.createDataFrame(rows, "id long, case_id string, tower_id string, a_party_number string, start_time timestamp")
    got, want = copresence.meeting_counts(cdr), copresence.meeting_summary(copresence.meetings(cdr))
    assert got.columns == want.columns and tuple(got.first()) == tuple(want.first()) and got.first()["total"] > 1000
