"""Traffic classes, nearest places, and streams in order of time, against literals and plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgrid.functions import services as s
from callgrid.operators import attribution, movement, nearest, traffic
from callgrid.streaming import streams

T0 = datetime(2024, 3, 4, 12)
IPDR = "id long, source_ip string, destination_ip string, destination_port int, source_port int, protocol string, bytes_uploaded long, bytes_downloaded long, start_time timestamp_ntz, end_time timestamp_ntz, tower_id string"


def session(number, seconds, up, down, proto="TCP", port=443, source=50000, rows=1, hour=12):
    """Rows of one session, evenly over its seconds."""
    at = T0.replace(hour=hour)
    step = [at + timedelta(seconds=seconds * i / rows) for i in range(rows)] + [at + timedelta(seconds=seconds)]
    share = lambda n, i: n // rows + (n % rows if i == 0 else 0)
    return [(number * 100 + i, f"10.0.0.{number}", "8.8.8.8", port, source, proto, share(up, i), share(down, i), step[i], step[i + 1], "T") for i in range(rows)]


CASES = [
    ("VPN / Encrypted Tunnel", (31, 10, 10, "UDP", 1194)), ("Network Traffic", (30, 10, 10, "UDP", 1194)), ("Remote Desktop", (5, 10, 10, "TCP", 3389)), ("File Transfer", (5, 10, 10, "TCP", 21)), ("Presence / Keep-alive", (5, 0, 10, "TCP", 21)),
    ("Cloud Sync", (200, 200_000, 200_000, "TCP", 443, 50000, 4)), ("Video Call", (60, 3_000_000, 3_000_000, "UDP", 40000)), ("Voice Call", (40, 9_000, 9_000, "UDP", 3478)), ("Conference", (400, 50_000, 150_000, "UDP", 40000)), ("Screen Sharing", (100, 50_000, 150_000, "UDP", 40000)),
    ("Streaming", (400, 1_000, 9_000_000, "TCP", 443)), ("Media Upload", (5, 71_000, 29_000, "TCP", 443)), ("Browsing / Interactive", (5, 70_000, 30_000, "TCP", 443)), ("Messaging", (8, 2_000, 3_000, "UDP", 40000)), ("Voice Call", (40, 9_000, 9_000, "UDP", None, 3479)),
    ("VPN / Encrypted Tunnel", (31, 10, 10, "TCP", 443, 500)), ("Network Traffic", (200, 10, 10, "GRE", 443)), ("Presence / Keep-alive", (0, None, None, None, None, None)),
]


def test_traffic_classes(spark):
    rows = []
    for i, (_, args) in enumerate(CASES):
        args = list(args)
        plain = [a if a is not None else 0 for a in args[:3]]
        rows += [tuple(r[:6]) + ((None, None) if args[1] is None else r[6:8]) + tuple(r[8:]) for r in session(i, *plain, *args[3:])]
    got = {r["source_ip"]: r for r in traffic.traffic_classes(spark.createDataFrame(rows, IPDR), s.families(spark)).collect()}
    assert [got[f"10.0.0.{i}"]["class"] for i in range(len(CASES))] == [c for c, _ in CASES]
    assert got["10.0.0.0"]["evidence"] == ["Tunnel port held open", "Business hours"] and got["10.0.0.0"]["confidence_change"] == 10
    night = traffic.traffic_classes(spark.createDataFrame(session(1, 5, 10, 10, hour=3), IPDR), s.families(spark)).first()
    assert night["evidence"] == ["Minimal traffic", "Late-night activity"] and night["confidence_change"] == -5
    assert traffic.traffic_classes(spark.createDataFrame([], IPDR), s.families(spark)).count() == 0
    loose = traffic.Limits(small=1_000_000, burst=600)
    assert traffic.traffic_classes(spark.createDataFrame(session(1, 100, 200_000, 150_000, "UDP", 40000), IPDR), s.families(spark), loose).first()["class"] == "Screen Sharing"


@pytest.mark.parametrize("places", [1, 7, 400])
def test_nearest_places(spark, places):
    """Near the poles, over the date line, with equally near places and points that stand on one."""
    rng = random.Random(places)
    known = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(places)]
    if places > 300:
        known += [(1000, 89.9, 10.0), (1001, 89.9, -170.0), (1002, -90.0, 0.0), (1003, 0.0, 179.99), (1004, 0.0, -179.99), (1005, 12.0, 77.0), (1006, 12.0, 77.0), (1007, None, 3.0)]
    points = [(f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [("north", 90.0, 0.0), ("south", -89.99, 120.0), ("line", 0.0, 180.0), ("same", 12.0, 77.0), ("none", None, 1.0)]
    a, b = spark.createDataFrame(points, "id string, latitude double, longitude double"), spark.createDataFrame(known, "place long, latitude double, longitude double")
    got, want = (sorted(map(tuple, f(a, b).collect())) for f in (nearest.nearest, nearest.all_distances))
    assert got == want and len(got) == 154
    assert nearest.nearest(a, b.limit(0)).count() == 0 and nearest.nearest(a.limit(0), b).count() == 0


def collected(spark, tmp_path, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name).collect()


def in_batches(spark, tmp_path, df, batches):
    """The rows as files that a stream reads one by one; batches: how the ids fall."""
    for i, ids in enumerate(batches):
        df.where(F.col("id").isin(ids)).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_impossible_travel_in_order(spark, tmp_path):
    """Rows in random order within the watermark give the legs of the batch twin; rows without a position break legs."""
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}", T0 + timedelta(minutes=7 * i + rng.randrange(7)), *((None, None) if i % 11 == 0 else (10.0 + rng.randrange(4) * 3, 70.0))) for i in range(60)]
    rows += [(60, "s0", rows[57][2], 40.0, 70.0), (61, "s0", rows[57][2], 10.0, 75.0)]  # at one time
    df = spark.createDataFrame(rows, "id long, subject string, start_time timestamp_ntz, latitude double, longitude double")
    want = movement.legs(df.withColumn("tower_id", F.lit("T")).withColumn("imei", F.lit("1"))).where("impossible").select("subject", "id").collect()
    order = [r[0] for r in rows]
    for i in range(0, len(order), 6):  # late by some rows, not by more than the watermark
        part = order[i : i + 6]
        rng.shuffle(part)
        order[i : i + 6] = part
    end = spark.createDataFrame([(100 + i, f"z{i}", T0 + timedelta(days=3 + i), 0.0, 0.0) for i in range(2)], df.schema)
    stream = in_batches(spark, tmp_path, df.union(end), [order[i : i + 4] for i in range(0, len(order), 4)] + [[100], [101]])
    got = collected(spark, tmp_path, streams.impossible_travel(stream, late="1 hour"), "travel")
    assert len(want) > 5 and sorted((r["subject"], r["id"]) for r in got) == sorted(map(tuple, want))
    assert all(r["km"] >= 5 for r in got) and not math.isnan(sum(r["t"] for r in got))


def test_family_sessions(spark, tmp_path):
    """Each family has its own gap, as in the batch sessions, with rows that come late."""
    rng = random.Random(6)
    rows = [(i, f"10.0.0.{i % 2}", rng.choice(["8.8.8.8", None]), rng.choice([53, 443, 1194, 9999]), None, "UDP", i, 2 * i, T0 + timedelta(seconds=40 * i), None, f"T{i}") for i in range(120)]
    rows += [(200, "10.0.0.9", "1.1.1.1", 53, None, "UDP", 1, 1, T0, None, "A"), (201, "10.0.0.9", "1.1.1.1", 53, None, "UDP", 1, 1, T0 + timedelta(seconds=60), None, "B"), (202, "10.0.0.9", "1.1.1.1", 53, None, "UDP", 1, 1, T0 + timedelta(seconds=121), None, "C")]
    df = spark.createDataFrame(rows, IPDR)
    want = attribution.ipdr_sessions(df, s.families(spark)).select("source_ip", "destination_ip", "family", "start", "rows", "up", "down", "tower")
    end = spark.createDataFrame([(900 + i, "10.9.9.9", "x", 53, None, "UDP", 0, 0, T0 + timedelta(days=2 + i), None, "T") for i in range(2)], IPDR)
    ids = [r[0] for r in rows]
    for i in range(0, 120, 10):
        part = ids[i : i + 10]
        rng.shuffle(part)
        ids[i : i + 10] = part
    stream = in_batches(spark, tmp_path, df.union(end), [[200, 201, 202, *ids[:9]], *[ids[i : i + 37] for i in range(9, 120, 37)], [900], [901]])
    got = collected(spark, tmp_path, streams.family_sessions(stream, s.families(spark)), "sessions")
    key = lambda r: (r["source_ip"], r["destination_ip"], r["family"], str(r["start"])[:19], r["rows"], r["up"], r["down"], r["tower"])
    assert sorted(key(r) for r in got if r["source_ip"] != "10.9.9.9") == sorted(map(key, want.collect()))
    assert sorted(r["rows"] for r in got if r["source_ip"] == "10.0.0.9") == [1, 2]
