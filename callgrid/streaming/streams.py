"""Streams over the call table: windows, sessions, joins and state, each with a batch twin in the operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.services import GAPS
from ..operators.attribution import port_family
from ..operators.reports import owned, volume_by_day


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Times become zoned, as watermarks ask; the session zone is UTC."""
    return df.withColumn("start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", late)


def hourly_counts(calls: DataFrame) -> DataFrame:
    return timed(calls).groupBy(F.window("start_time", "1 hour").alias("w"), "call_type").agg(F.count("*").alias("n")).select("w.start", "call_type", "n")


def burst_alerts(calls: DataFrame, least: int = 5) -> DataFrame:
    g = timed(calls).groupBy(F.window("start_time", "10 minutes", "1 minute").alias("w"), "a_party_number").agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select("w.start", "a_party_number", "n")


def talk_sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = timed(calls).groupBy(F.session_window("start_time", gap).alias("w"), "a_party_number").agg(F.count("*").alias("calls"), F.sum("duration_seconds").alias("seconds"))
    return g.select("a_party_number", "w.start", "calls", "seconds")


def without_resent(calls: DataFrame, keys: tuple[str, ...] = ("a_party_number", "b_party_number", "start_time")) -> DataFrame:
    return timed(calls).dropDuplicatesWithinWatermark(list(keys))


def watchlist_hits(calls: DataFrame, watch: DataFrame) -> DataFrame:
    return calls.join(watch.select(F.col("value").alias("a_party_number"), "note"), "a_party_number")


def meetings(calls: DataFrame) -> DataFrame:
    """Stream with stream: two callers at one tower within the hour."""
    side = lambda k: timed(calls).select(F.col("tower_id").alias(f"tower{k}"), F.col("a_party_number").alias(f"s{k}"), F.col("start_time").alias(f"t{k}"), F.col("id").alias(f"id{k}"))
    near = F.expr("tower1 = tower2 AND t2 BETWEEN t1 AND t1 + INTERVAL 1 HOUR AND s1 <> s2")
    return side(1).join(side(2), near).where("t2 > t1 OR id2 > id1").select(F.col("tower1").alias("tower_id"), "s1", "s2", "id1", "id2")


def family_sessions(ipdr: DataFrame, families: DataFrame, late: str = "1 hour") -> DataFrame:
    """Sessions of one source, destination and port family, each family with its own gap: source_ip, destination_ip, family, start, rows, up, down and tower (of the first row).

    The twin of ``ipdr_sessions``: a row exactly one gap later still belongs. Rows without a time are in no session; a missing destination is '?'.
    """
    gap = F.create_map(*[F.lit(x) for family, seconds in GAPS.items() for x in (family, f"{seconds} seconds")])[F.col("family")]
    rows = timed(port_family(ipdr, families), late).withColumn("destination_ip", F.coalesce("destination_ip", F.lit("?")))
    g = rows.groupBy(F.session_window("start_time", gap).alias("w"), "source_ip", "destination_ip", "family").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce("bytes_uploaded", F.lit(0))).alias("up"), F.sum(F.coalesce("bytes_downloaded", F.lit(0))).alias("down"), F.min_by("tower_id", F.struct("start_time", "id")).alias("tower"),
    )
    return g.select("source_ip", "destination_ip", "family", "w.start", "rows", "up", "down", "tower")


#: Half the way around the earth, in km: a leg is never longer.
FARTHEST = 20_016


def impossible_travel(stream: DataFrame, kmh: float = 900, km: float = 5, late: str = "1 hour") -> DataFrame:
    """subject, id, t and km of legs that are too fast, from the row just before in time. stream: subject, id, start_time, latitude, longitude.

    The twin of ``legs``: a leg needs a position at both its rows. Rows wait in state until the watermark has passed them and are then taken
    in order of time and id, so rows that come late, but within ``late``, change nothing; later ones are dropped. A subject's
    last row is forgotten once no leg from it could be too fast any more, so the state of silent subjects ends. The end of a
    stream that no watermark passes is not reported.
    """
    forget = FARTHEST / kmh * 3600

    def distance(a: tuple, b: tuple) -> float | None:
        if None in (a[2], a[3], b[2], b[3]):
            return None
        y1, x1, y2, x2 = map(math.radians, (a[2], a[3], b[2], b[3]))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = (None, []) if not state.exists else (state.get[0], list(state.get[1]))
        last = tuple(last) if last is not None else None
        none = lambda v: None if pd.isna(v) else float(v)
        for rows in frames:
            waiting += [(float(t), int(i), none(y), none(x)) for t, i, y, x in zip(rows["t"], rows["id"], rows["latitude"], rows["longitude"], strict=True)]
        waiting = sorted(map(tuple, waiting), key=lambda r: r[:2])
        passed, out = state.getCurrentWatermarkMs() / 1000, []
        while waiting and waiting[0][0] <= passed:
            row = waiting.pop(0)
            far = distance(last, row) if last is not None else None
            hours = (row[0] - last[0]) / 3600 if last is not None else 0
            if far is not None and far >= km and (hours <= 0 or far / hours > kmh):
                out.append((key[0], row[1], row[0], far))
            last = row
        if not waiting and (last is None or last[0] + forget <= passed):
            if state.exists:
                state.remove()
        else:
            state.update((last, waiting))
            due = waiting[0][0] if waiting else last[0] + forget
            state.setTimeoutTimestamp(max(int(due * 1000) + 1, int(passed * 1000) + 1))
        yield pd.DataFrame(out, columns=["subject", "id", "t", "km"])

    row = "struct<t: double, id: long, latitude: double, longitude: double>"
    rows = timed(stream, late).select("subject", "id", "start_time", (F.unix_micros("start_time") / 1e6).alias("t"), F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))
    return rows.groupBy("subject").applyInPandasWithState(step, "subject string, id long, t double, km double", f"last {row}, waiting array<{row}>", "append", GroupStateTimeout.EventTimeTimeout)


def new_rows(facts: DataFrame, seen: int | None) -> DataFrame:
    """The rows after the watermark (the greatest id that reports have seen; None: all)."""
    return facts if seen is None else facts.where(F.col("id") > seen)


def watermark(facts: DataFrame) -> int | None:
    return facts.agg(F.max("id")).first()[0]


def touched_subjects(rows: DataFrame) -> DataFrame:
    """case_id and subject of both ends of the rows."""
    side = lambda c: rows.select("case_id", F.col(c).alias("subject"))
    return side("a_party_number").union(side("b_party_number")).where("subject IS NOT NULL").distinct()


def daily_reports(facts: DataFrame) -> DataFrame:
    """case_id and the daily report of each of its callers."""
    named = owned(facts).withColumn("subject", F.concat_ws("|", "case_id", "a_party_number"))
    return volume_by_day(named).withColumn("case_id", F.split("subject", r"\|")[0])


def refreshed(reports: DataFrame, facts: DataFrame, seen: int | None) -> DataFrame:
    """The daily reports after new rows came: those of touched callers are made anew, the others stay; the same as all made anew."""
    touched = new_rows(facts, seen).select("case_id", "a_party_number").distinct()
    again = daily_reports(facts.join(touched, ["case_id", "a_party_number"], "left_semi"))
    return reports.join(again.select("subject").distinct(), "subject", "left_anti").unionByName(again)


def refresh_touched(facts_path: str, reports_path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the rows, then rebuilds the daily reports of the touched cases only.

    Rows lie in a folder of their case and batch, so a batch that comes again replaces its own rows and no others.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id", "batch").parquet(facts_path)
        facts = spark.read.option("partitionOverwriteMode", "dynamic").schema(rows.schema).parquet(facts_path)
        facts = facts.join(batch.select("case_id").distinct(), "case_id", "left_semi")
        daily_reports(facts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("case_id").parquet(reports_path)

    return run
