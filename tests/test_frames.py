"""Hand-made frames with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgrid.functions import exprs
from callgrid.operators import behaviour, graph, movement
from callgrid.sources import readers, sinks
from callgrid.streaming import streams

T0 = datetime(2024, 1, 1, 10)
CDR = "id long, case_id string, a_party_number string, b_party_number string, msisdn string, call_type string, direction string, start_time timestamp_ntz, duration_seconds int, tower_id string, technology string, imei string, imsi string"


def calls(spark, rows):
    """rows: (minutes, a, b, tower, imei)"""
    return spark.createDataFrame([(i, "1", a, b, a, "Voice", "MO", T0 + timedelta(minutes=m), 60, t, "4G", imei, "s" + a) for i, (m, a, b, t, imei) in enumerate(rows)], CDR)


def test_distance_and_modes(spark):
    r = spark.range(1).select(exprs.haversine_km(F.lit(13.0827), F.lit(80.2707), F.lit(28.6139), F.lit(77.209)).alias("km"), exprs.classify_speed(F.lit(80.0)).alias("a"), exprs.classify_speed(F.lit(5000.0)).alias("b"), exprs.ip_number(F.lit("10.0.0.256")).alias("bad")).first()
    assert 1700 < r["km"] < 1800 and r["a"] == "road" and r["b"] == "impossible" and r["bad"] is None


def test_impossible_travel(spark):
    towers = spark.createDataFrame([("M", 13.0827, 80.2707), ("D", 28.6139, 77.209)], "tower_id string, latitude double, longitude double")
    df = calls(spark, [(0, "x", "y", "M", "1"), (18, "x", "y", "D", "1"), (100, "z", "y", "M", "1"), (100, "z", "y", "D", "1")])
    got = {r["subject"]: r["kmh"] for r in movement.legs(movement.streams(df, towers)).where("impossible").collect()}
    assert set(got) == {"x", "z"} and got["x"] > 900 and got["z"] is None


def test_no_leg_without_two_positions(spark):
    """A first row, a row without a position and the one after it have no leg."""
    towers = spark.createDataFrame([("M", 13.0827, 80.2707), ("D", 28.6139, 77.209)], "tower_id string, latitude double, longitude double")
    df = calls(spark, [(0, "x", "y", "M", "1"), (10, "x", "y", "nowhere", "1"), (20, "x", "y", "D", "1"), (600, "x", "y", "M", "1")])
    assert [(r["from_tower"], r["tower_id"]) for r in movement.legs(movement.streams(df, towers)).collect()] == [("D", "M")]


def test_identity_states(spark):
    df = calls(spark, [(0, "x", "y", "M", "A"), (1, "x", "y", "M", "B"), (2, "x", "y", "M", "A")]).withColumn("subject", F.col("a_party_number"))
    s = behaviour.identity_states(df)
    assert s.count() == 3 and [r["kind"] for r in behaviour.transitions(s).collect()] == ["device_change"] * 2


def test_graph(spark):
    """Two triangles joined by a bridge."""
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("p", "q")]
    e = graph.edges(calls(spark, [(i, a, b, "M", "1") for i, (a, b) in enumerate(pairs)]))
    assert {r["label"] for r in graph.components(e).collect()} == {"a", "p"}
    cut = {(r["kind"], r["src"], r["dst"]) for r in graph.cut_points(e).collect()}
    assert cut == {("bridge", "c", "d"), ("bridge", "p", "q"), ("cut_point", "c", None), ("cut_point", "d", None)}
    assert {r["node"]: r["core"] for r in graph.core_numbers(e).collect()} == {**dict.fromkeys("abcdef", 2), "p": 1, "q": 1}
    part = e.where("src < 'p'")
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(part, graph.nodes(part).select("node")).collect()}
    assert b["c"] == b["d"] == pytest.approx(0.6, abs=1e-4) and b["a"] == 0
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(part).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["c"] == pytest.approx(ranks["d"]) and ranks["c"] > ranks["a"]


def test_graph_in_full(spark, monkeypatch):
    """A chain longer than 12 steps, pivots in several batches, and a core of over 200."""
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", 1) for i in range(14)], "src string, dst string, weight int")
    c = {r["node"]: r["closeness"] for r in graph.closeness(chain, chain.where("src = 'n00'").select(F.col("src").alias("node"))).collect()}
    assert c == {"n00": pytest.approx(14 / 105, abs=1e-6)}
    monkeypatch.setattr(graph, "BATCH", 2)
    path = chain.where("src < 'n03'")
    b = {r["node"]: r["betweenness"] for r in graph.betweenness(path, graph.nodes(path).select("node")).collect()}
    assert b == {"n00": 0, "n01": pytest.approx(2 / 3, abs=1e-6), "n02": pytest.approx(2 / 3, abs=1e-6), "n03": 0}
    dense = spark.range(203).selectExpr("concat('m', id) AS src", "id").crossJoin(spark.range(203).selectExpr("concat('m', id) AS dst", "id AS other")).where("id < other").selectExpr("src", "dst", "1 AS weight")
    assert [(r["core"], r["n"]) for r in graph.core_numbers(dense).groupBy("core").agg(F.count("*").alias("n")).collect()] == [(202, 203)]


def test_closeness_of_every_node(spark):
    """The registered query has a row for each node."""
    from callgrid.plans import catalog

    found = [catalog.QUERIES[q](spark, "/root/testdata/sf0.01").select("node") for q in ("I05_closeness", "I01_graph_nodes")]
    assert sorted(r["node"] for r in found[0].collect()) == sorted(r["node"] for r in found[1].collect())


def test_lcs():
    assert movement._lcs(list("abcbdab"), list("bdcaba")) == 4 and movement._lcs([], ["a"]) == 0


def test_lcs_of_all_pairs(spark):
    """Seven subjects on one route are 21 pairs; a long route and its shifted copy have all but the shift in common."""
    start = "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) AS start_time"
    few = spark.range(5).crossJoin(spark.range(7).withColumnRenamed("id", "s")).selectExpr("id", "concat('s', s) AS subject", "concat('t', id) AS tower_id", start)
    got = movement.lcs_similarity(few, movement.route_pairs(few, least=1)).collect()
    assert len(got) == 21 and all((r["common"], r["similarity"]) == (5, 1.0) for r in got)
    long = spark.range(6000).selectExpr("id", "'x' AS subject", "concat('t', id) AS tower_id", start).union(spark.range(6000).selectExpr("id", "'y' AS subject", "concat('t', id + 1000) AS tower_id", start))
    assert [r["common"] for r in movement.lcs_similarity(long, movement.route_pairs(long, least=1)).collect()] == [5000]


def test_ingest(spark, tmp_path):
    p = tmp_path / "feed.csv"
    p.write_text("Calling Number;B Party;Call Date;End Time;Duration;Site ID\n9811099887;981;01/02/2024 10:00:00;;60;T1\n98;97;2024-02-01 11:00;x;1.0;\n98;97;never;;5;T2\n")
    raw = readers.delimited(spark, str(p))
    good, bad = readers.canonical(raw, "cdr", "7")
    rows = good.orderBy("start_time").collect()
    assert bad.count() == 1 and [r["start_time"] for r in rows] == [datetime(2024, 2, 1, 10), datetime(2024, 2, 1, 11)]
    assert rows[0]["a_party_number"] == "9811099887" and rows[0]["case_id"] == "7" and rows[1]["tower_id"] is None and rows[1]["duration_seconds"] == 1
    assert readers.import_report(raw, "cdr").first()["dropped"] == 1
    with pytest.raises(ValueError):
        readers.canonical(spark.createDataFrame([("x",)], "foo string"), "cdr")
    sinks.load(good, f"{tmp_path}/t", "append")
    sinks.load(good.limit(1), f"{tmp_path}/t", "replace")
    sinks.load(good.withColumn("case_id", F.lit("8")), f"{tmp_path}/t", "replace")
    assert {r["case_id"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy("case_id").count().collect()} == {7: 1, 8: 2}


def test_merged_networks(spark):
    df = spark.createDataFrame([("p", 0, 10), ("p", 11, 20), ("p", 5, 8), ("p", 30, 40)], "provider string, lo long, hi long")
    assert sorted((r["lo"], r["hi"]) for r in readers.merged_networks(df).collect()) == [(0, 20), (30, 40)]


def test_streams(spark, tmp_path):
    df = calls(spark, [(0, "a", "b", "T", "1"), (10, "c", "b", "T", "1"), (50, "a", "b", "T", "1"), (500, "a", "b", "U", "1"), (2000, "a", "b", "U", "1")])
    df.repartition(1).write.parquet(f"{tmp_path}/in")

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    src = lambda: streams.source(spark, f"{tmp_path}/in", df.schema)
    assert sum(r["n"] for r in run(streams.hourly_counts(src()), "hourly")) == 4  # the last window is still open
    assert {(r["s1"], r["s2"]) for r in run(streams.meetings(src()), "met")} == {("a", "c"), ("c", "a")}
    assert sorted(r["calls"] for r in run(streams.talk_sessions(src()), "talk")) == [1, 1, 1, 1]
    watch = spark.createDataFrame([("c", "seen")], "value string, note string")
    assert len(run(streams.watchlist_hits(src(), watch), "hits")) == 1
    place = F.when(F.col("tower_id") == "T", 10.0).otherwise(60.0)
    fast = run(streams.impossible_travel(src().select("id", F.col("a_party_number").alias("subject"), "start_time", place.alias("latitude"), F.lit(70.0).alias("longitude")), kmh=1), "fast")
    assert [(r["subject"], r["id"]) for r in fast] == [("a", 3)]  # the watermark, an hour behind the last row, has passed it
