"""Headers, times, loads, snapshots and increments, with expected values as literals."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from callgrid.operators import lookups, modules, records
from callgrid.sources import readers, sinks
from callgrid.streaming import streams

T0 = datetime(2026, 1, 1, 10)
CALLS = "id long, case_id string, a_party_number string, b_party_number string, start_time timestamp_ntz, duration_seconds int, tower_id string"


def calls(spark, rows):
    """rows: (id, case, a, b, minutes)"""
    return spark.createDataFrame([(i, c, a, b, T0 + timedelta(minutes=m), 60, "T1") for i, c, a, b, m in rows], CALLS)


def test_headers():
    found, missing = readers.resolve(["Caller", "Called", "Call Date", "End Time", "Duration"], "cdr")
    assert missing == [] and found == {"a_party_number": "Caller", "b_party_number": "Called", "start_time": "Call Date", "end_time": "End Time", "duration_seconds": "Duration"}
    assert readers.resolve(["Caller", "Call Date", "End Time", "Duration"], "cdr")[1] == ["b_party_number"]
    found, missing = readers.resolve(["x", "y", "start_time", "end_time", "duration_seconds"], "cdr", {"a_party_number": "x", "b_party_number": "y", "imei": "absent"})
    assert missing == [] and found["a_party_number"] == "x" and "imei" not in found
    found, missing = readers.resolve(["src_ip", "dst_ip", "session_start", "session_end", "technology"], "ipdr")
    assert missing == [] and found["source_ip"] == "src_ip" and found["rat"] == "technology"
    # one name, two feeds; of two headers for one column the first of the file
    assert readers.resolve(["b_party", "number", "date"], "dump")[0] == {"other_party": "b_party", "msisdn": "number", "start_time": "date"}
    assert readers.resolve(["Lat", "latitude"], "cdr")[0]["latitude"] == "Lat"
    assert readers.operator_hint(["Jio Cell", "x"]) == "Jio" and readers.operator_hint(["VI_Number", "VI IMEI"]) == "Vi" and readers.operator_hint(["x"]) is None


def test_times(spark):
    texts = ["2026-01-02 10:00:01", "2026-01-02T10:00:01", "2026/01/02 10:00:01", "02/01/2026 10:00:01", "02-01-2026 10:00:01", "01/22/2026 10:00:01", "02-Jan-2026 10:00:01", "02/01/2026 10:00", "2026-01-02 10:00", "02-01-2026 10:00", "02.01.2026", "2/1/2026", "bad", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"] for r in df.select("i", readers.parse_time(F.col("t")).alias("x")).orderBy("i").collect()]
    exact, minute = datetime(2026, 1, 2, 10, 0, 1), datetime(2026, 1, 2, 10)
    assert got == [exact] * 5 + [datetime(2026, 1, 22, 10, 0, 1), exact] + [minute] * 3 + [datetime(2026, 1, 2)] * 2 + [None] * 3


def test_feed_with_other_headers(spark, tmp_path):
    text = "Caller,Called,Call Date,End Time,Duration\n111,222,2026-01-01 10:00:00,2026-01-01 10:05:00,300\n333,444,02/01/2026 11:00:00,02/01/2026 11:05:00,120\n555,666,bad,2026-01-03 09:00:00,90\n"
    (tmp_path / "feed.csv").write_text(text)
    raw = readers.delimited(spark, str(tmp_path / "feed.csv"))
    good, bad = readers.canonical(raw, "cdr", "c1")
    assert [(r["a_party_number"], r["start_time"], r["duration_seconds"]) for r in good.orderBy("start_time").collect()] == [("111", datetime(2026, 1, 1, 10), 300), ("333", datetime(2026, 1, 2, 11), 120)]
    assert [r["Caller"] for r in bad.collect()] == ["555"]
    rows, report = readers.preview(raw, "cdr", 2)
    assert rows.count() == 2 and report["missing"] == [] and report["mapping"]["start_time"] == "Call Date"


def test_dimension_from_file(spark, tmp_path):
    (tmp_path / "isd.csv").write_text("Prefix,Country\n44,United Kingdom\n1242,Bahamas\n1,United States\n")
    prefixes = readers.dimension(spark, f"{tmp_path}/isd.csv", {"prefix": "string", "country": "string"})
    df = spark.createDataFrame([("+44 20",), ("0012425",), ("13",), ("999",)], "n string")
    got = {r["n"]: r["country"] for r in lookups.isd_country(df, "n", prefixes).collect()}
    assert got == {"+44 20": "United Kingdom", "0012425": "Bahamas", "13": "United States", "999": None}
    (tmp_path / "cities.json").write_text('{"city": "A", "state": "S", "latitude": "1.5", "longitude": "x"}\n')
    kinds = {"ord": "long", "city": "string", "latitude": "double", "longitude": "double"}
    assert [tuple(r) for r in readers.dimension(spark, f"{tmp_path}/cities.json", kinds).collect()] == [(0, "A", 1.5, None)]


def test_loads(spark, tmp_path):
    df = calls(spark, [(1, "a", "x", "y", 0), (2, "b", "x", "y", 1)])
    at = f"{tmp_path}/facts"
    sinks.load(df, at, "replace")
    sinks.load(df.where("case_id = 'a'").withColumn("id", F.lit(9).cast("long")), at, "replace")
    assert sorted(r["id"] for r in spark.read.parquet(at).collect()) == [2, 9]
    sinks.reset(spark, at, "a")
    assert [r["id"] for r in spark.read.schema(CALLS).parquet(at).collect()] == [2]
    assert sinks.snapshot({"calls": df, "none": df.where("false")}, f"{tmp_path}/snap") == {"calls": 2, "none": 0}
    assert sinks.restore(spark, f"{tmp_path}/snap", ["calls", "none"], f"{tmp_path}/back") == {"calls": 2, "none": 0}
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/back/calls").collect()) == [1, 2]
    made = []
    build = lambda: made.append(1) or df.groupBy("case_id").count()
    for version in (1, 1, 2, 2):
        assert sinks.read_through(spark, f"{tmp_path}/analytic", version, build).count() == 2
    assert len(made) == 2


def test_increments(spark, tmp_path):
    """Six callers and four days each; then rows of two callers: the refreshed reports are those made anew, and only the touched are."""
    old = calls(spark, [(10 * s + d, "a", f"s{s}", f"s{(s + 1) % 6}", 1440 * d) for s in range(6) for d in range(4)])
    more = calls(spark, [(100, "a", "s1", "s9", 1440 * 5), (101, "a", "s4", "s1", 1440 * 6), (102, "b", "s1", "s2", 0)])
    seen = streams.watermark(old)
    every = old.union(more)
    reports = streams.daily_reports(old)
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert plain(streams.refreshed(reports, every, seen)) == plain(streams.daily_reports(every))
    assert plain(streams.refreshed(reports, old, seen)) == plain(reports)
    assert plain(streams.refreshed(reports.where("false"), every, None)) == plain(streams.daily_reports(every))
    got = {(r["case_id"], r["subject"]) for r in streams.touched_subjects(streams.new_rows(every, seen)).collect()}
    assert seen == 53 and got == {("a", "s1"), ("a", "s9"), ("a", "s4"), ("b", "s1"), ("b", "s2")}
    # as a stream's batches, the second of which comes twice
    step = streams.refresh_touched(f"{tmp_path}/facts", f"{tmp_path}/reports")
    for number, batch in ((0, old), (1, more), (1, more)):
        step(batch, number)
    assert spark.read.parquet(f"{tmp_path}/facts").count() == every.count()
    assert plain(spark.read.parquet(f"{tmp_path}/reports").withColumn("case_id", F.col("case_id").cast("string"))) == plain(streams.daily_reports(every))


def test_streams_of_alerts(spark, tmp_path):
    """Six calls in six minutes are a burst; rows that are sent again count once."""
    rows = [(i, "a", "x", f"y{i}", i) for i in range(6)] + [(50, "a", "z", "y", 3)]
    for part in range(2):
        calls(spark, rows).write.parquet(f"{tmp_path}/in/{part}")
    calls(spark, [(99, "a", "late", "y", 600)]).write.parquet(f"{tmp_path}/in/9")
    files = spark.readStream.schema(CALLS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def collected(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    once = collected(streams.without_resent(files), "once")
    assert sorted((r["a_party_number"], r["b_party_number"]) for r in once) == sorted([("x", f"y{i}") for i in range(6)] + [("z", "y"), ("late", "y")])
    bursts = collected(streams.burst_alerts(files, 12), "bursts")
    assert {r["a_party_number"] for r in bursts} == {"x"} and max(r["n"] for r in bursts) == 12


def test_home_and_work_towers(spark):
    rows = [("x", "H", 23), ("x", "H", 7), ("x", "W", 9), ("x", "W", 17), ("x", "V", 12), ("x", "N", 18), ("y", "A", 3), ("y", "B", 2), ("z", "C", 18)]
    df = spark.createDataFrame([(s, t, datetime(2026, 1, 1, h)) for s, t, h in rows], "subject string, tower_id string, start_time timestamp_ntz")
    got = {r["subject"]: (r["home"], r["work"], r["towers"], r["mobility"]) for r in modules.home_and_work(df).collect()}
    assert got == {"x": ("H", "W", 4, "Low"), "y": ("A", "Unknown", 2, "Low"), "z": ("Unknown", "Unknown", 1, "Low")}


def test_audit_and_groups(spark):
    audit = spark.createDataFrame([(i, datetime(2026, 1, 1 + i), "u" if i % 2 else "v", "login") for i in range(5)], "id long, ts timestamp_ntz, username string, action string")
    assert [r["id"] for r in records.audit_rows(audit, {"username": "u"}, "2026-01-02").collect()] == [3, 1]
    assert [r["id"] for r in records.audit_rows(audit, until="2026-01-02").collect()] == [1, 0]
    watch = spark.createDataFrame([("1", "g"), ("2", None), ("3", " "), ("4", "g")], "value string, `group` string")
    assert {r["group"]: r["n"] for r in records.watchlist_groups(watch).collect()} == {"g": 2, "Default": 2}
