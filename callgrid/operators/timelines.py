"""Timelines: calls, reconstructed sessions and towers in order of time, and what is known of a subject along its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import epoch
from . import behaviour, movement
from .attribution import in_sessions

def annotated(stream: DataFrame) -> DataFrame:
    """The rows of each subject's stream with ``move``, the leg that ends there in rounded figures; null where there is none."""
    move = F.struct("from_tower", F.round("km", 2).alias("km"), F.round(F.col("hours") * 60, 1).alias("minutes"), F.round("kmh", 1).alias("kmh"), "mode", "impossible")
    rows = movement.with_leg(stream).withColumn("move", F.when(F.col("moved"), move))
    return rows.select(*stream.columns, "move")


def described_sessions(attributed: DataFrame, families: DataFrame) -> DataFrame:
    """Each reconstructed session of attributed rows with times, rows, bytes, first tower, and what its surest row (the earliest of equal ones) says; one shuffle for both."""
    rows = in_sessions(attributed.withColumnRenamed("family", "service_family"), families)
    at = F.struct("start_time", "id")
    best = F.min_by(F.struct("service", "subtype", "confidence", "service_family", "evidence"), F.struct(-F.col("confidence"), F.col("start_time"), F.col("id")))
    end = F.coalesce("end_time", "start_time") if "end_time" in attributed.columns else F.col("start_time")
    g = rows.groupBy("source_ip", "destination_ip", "family", "session").agg(
        F.min("start_time").alias("start"), F.max(end).alias("end"), F.count("*").alias("rows"), F.min_by("tower_id", at).alias("tower_id"),
        F.sum(F.coalesce("bytes_uploaded", F.lit(0))).alias("up"), F.sum(F.coalesce("bytes_downloaded", F.lit(0))).alias("down"), best.alias("b"),
    )
    return g.select("source_ip", "destination_ip", "start", "end", F.floor(epoch("end") - epoch("start")).cast("long").alias("seconds"), "rows", "tower_id", "up", "down", "b.*")


def _no(kind: str):
    return F.lit(None).cast(kind)


def _in_time(events: DataFrame) -> DataFrame:
    """In order of time, rows without one last and towers behind them."""
    return events.orderBy(F.asc_nulls_last("time"), F.startswith("event_type", F.lit("Tower")), "event_type", "subject", "peer", "id")


def unified(cdr: DataFrame, attributed: DataFrame, towers: DataFrame, families: DataFrame) -> DataFrame:
    """Calls with the caller's move since the call before, reconstructed sessions with their service, and known towers, which have no time and come last.

    A call without a caller or a time has no move. ``id`` is that of a call; sessions and towers have none.
    """
    known = F.col("a_party_number").isNotNull() & F.col("start_time").isNotNull()
    moved = annotated(movement.streams(cdr.where(known).withColumn("msisdn", F.col("a_party_number")), towers))
    calls = moved.unionByName(cdr.where(~known), True).select(
        F.col("start_time").alias("time"), F.lit("Voice Call").alias("event_type"), F.lit("Voice").alias("service"), _no("long").alias("confidence"),
        F.col("a_party_number").alias("subject"), F.col("b_party_number").alias("peer"), "tower_id", "id", F.col("duration_seconds").cast("long").alias("seconds"), "move",
    )
    sessions = described_sessions(attributed, families).select(
        F.col("start").alias("time"), F.lit("IP Session").alias("event_type"), "service", "confidence", F.col("source_ip").alias("subject"), F.col("destination_ip").alias("peer"), "tower_id", "seconds",
        F.struct("subtype", F.col("service_family").alias("family"), "end", "rows", "up", "down", "evidence").alias("session"),
    )
    registry = towers.select(
        F.lit("Tower Known").alias("event_type"), F.lit("Tower Registry").alias("service"), F.col("tower_id").alias("subject"), "tower_id", F.struct("city", "state", "latitude", "longitude").alias("tower"),
    )
    return _in_time(calls.unionByName(sessions, True).unionByName(registry, True))


def simple(cdr: DataFrame, attributed: DataFrame, towers: DataFrame) -> DataFrame:
    """Each call, each attributed session row and each tower as one line of text, in order of time; towers, which have none, last."""
    calls = cdr.select(
        F.col("start_time").alias("time"), F.lit("Voice Call").alias("event_type"), F.concat_ws(" called ", "a_party_number", "b_party_number").alias("event"),
        F.col("a_party_number").alias("subject"), F.col("b_party_number").alias("peer"), F.col("duration_seconds").cast("long").alias("seconds"), "tower_id", "id",
    )
    rows = attributed.select(
        F.col("start_time").alias("time"), F.lit("IP Session").alias("event_type"), F.concat_ws(" -> ", "source_ip", "destination_ip").alias("event"),
        F.col("source_ip").alias("subject"), F.col("destination_ip").alias("peer"), "service", "confidence", "tower_id", "id",
    )
    registry = towers.select(F.lit("Tower Registry").alias("event_type"), F.concat(F.lit("Tower "), "tower_id", F.lit(" registered")).alias("event"), F.col("tower_id").alias("subject"), "tower_id")
    return _in_time(calls.unionByName(rows, True).unionByName(registry, True))


def summaries(stream: DataFrame, days: int = 14, factor: float = 2, level: float = 3) -> DataFrame:
    """One row for each subject: number of events, movement profile, baseline, escalation and dormancy; null where a rule gives none."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("subject", F.struct(*[c for c in df.columns if c != "subject"]).alias(name))

    out = packed(movement.profile(stream), "movement")
    for found, name in ((behaviour.baseline(stream), "baseline"), (behaviour.escalation(stream, factor=factor, level=level), "escalation"), (behaviour.dormancy(stream, days=days), "dormancy")):
        out = out.join(packed(found, name), "subject", "left")
    return out.select("subject", F.col("movement.events").alias("event_count"), "movement", "baseline", "escalation", "dormancy")


def of_subject(cdr: DataFrame, towers: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """The annotated timeline of one number (or SIM, where rows have no number) and its summary; only its rows are read and shuffled."""
    stream = movement.streams(cdr.where(F.coalesce("msisdn", "imsi") == subject), towers)
    return annotated(stream).orderBy(*movement.ORDER), summaries(stream)
