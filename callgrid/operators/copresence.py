"""Co-presence and meetings: band joins over time buckets, place by tower or grid cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import day, epoch, haversine_km
from .meetingpairs import distinct_pairs

WINDOW_MIN, NEAR_KM, CONVOY_DAYS = 20, 1.5, 2
#: Grid cells (degrees): wider than 1.5 km up to 70 degrees of latitude.
CELL = 0.05


def band_pairs(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Pairs of rows (suffixes _1, _2) with equal keys and times (column ``t``) at most ``seconds`` apart, the earlier first, then the smaller id.

    A row is filed under its time bucket, its partner also under the one before: each pair meets once, and no two
    rows further apart than two buckets ever meet. One hot key is still split by time.
    """
    b = F.floor(F.col("t") / seconds).cast("long")
    one = rows.select(*[F.col(c).alias(c if c in keys else f"{c}_1") for c in rows.columns], b.alias("__b"))
    two = rows.select(*[F.col(c).alias(c if c in keys else f"{c}_2") for c in rows.columns], F.explode(F.array(b, b - 1)).alias("__b"))
    later = (F.col("t_2") > F.col("t_1")) | ((F.col("t_2") == F.col("t_1")) & (F.col("id_2") > F.col("id_1")))
    return one.join(two, [*keys, "__b"]).where(later & (F.col("t_2") - F.col("t_1") <= seconds)).drop("__b")


def co_presence(stream: DataFrame, minutes: int = WINDOW_MIN, km: float = NEAR_KM) -> DataFrame:
    """Pairs of subjects by occurrences at most 20 minutes apart at one tower or within 1.5 km: occurrences, days, towers."""
    rows = stream.where("tower_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL").select("id", "subject", "tower_id", "latitude", "longitude", epoch("start_time").alias("t"), day().alias("day"))
    same = band_pairs(rows, ["tower_id"], minutes * 60).withColumn("place", F.col("tower_id"))
    # near towers: pairs of towers first, as they are few, then their rows by time
    tw = rows.groupBy("tower_id").agg(F.min("latitude").alias("y"), F.min("longitude").alias("x"))
    cell = lambda c: F.floor(F.col(c) / CELL)
    a = tw.select(F.col("tower_id").alias("t1"), F.col("y").alias("y1"), F.col("x").alias("x1"), cell("y").alias("cy"), cell("x").alias("cx"))
    b = tw.select(F.col("tower_id").alias("t2"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.explode(F.array(*[cell("y") + i for i in (-1, 0, 1)])).alias("cy"), cell("x").alias("c")).withColumn("cx", F.explode(F.array(*[F.col("c") + i for i in (-1, 0, 1)])))
    near = a.join(b, ["cy", "cx"]).where((F.col("t1") < F.col("t2")) & (haversine_km("y1", "x1", "y2", "x2") <= km)).select("t1", "t2", F.concat_ws("~", "t1", "t2").alias("pair"))
    filed = rows.join(near.select(F.explode(F.array("t1", "t2")).alias("tower_id"), "pair"), "tower_id")
    apart = band_pairs(filed, ["pair"], minutes * 60).where("tower_id_1 <> tower_id_2").withColumn("place", F.col("pair"))
    both = same.select("subject_1", "subject_2", "day_1", "place").union(apart.select("subject_1", "subject_2", "day_1", "place")).where("subject_1 <> subject_2")
    return both.groupBy(F.least("subject_1", "subject_2").alias("a"), F.greatest("subject_1", "subject_2").alias("b")).agg(
        F.count("*").alias("occurrences"), F.countDistinct("day_1").alias("days"), F.array_join(F.slice(F.sort_array(F.collect_set("place")), 1, 8), ",").alias("places")
    )


def convoys(pairs: DataFrame, cdr: DataFrame, least_days: int = CONVOY_DAYS) -> DataFrame:
    """Convoy: together on several days; hidden link: a convoy that never called each other."""
    called = cdr.where("a_party_number <> b_party_number").select(F.least("a_party_number", "b_party_number").alias("a"), F.greatest("a_party_number", "b_party_number").alias("b"), F.lit(True).alias("called")).distinct()
    out = pairs.join(called, ["a", "b"], "left").withColumn("ever_called", F.coalesce("called", F.lit(False))).drop("called")
    return out.withColumn("convoy", F.col("days") >= least_days).withColumn("hidden_link", F.col("convoy") & ~F.col("ever_called"))


def meetings(cdr: DataFrame, window_min: float = 60) -> DataFrame:
    """Rows of two callers at one tower of a case at most an hour apart, with gap and confidence."""
    rows = cdr.where("tower_id IS NOT NULL AND a_party_number IS NOT NULL AND start_time IS NOT NULL").select("id", "case_id", "tower_id", F.col("a_party_number").alias("subject"), epoch("start_time").alias("t"))
    m = band_pairs(rows, ["case_id", "tower_id"], window_min * 60).where("subject_1 <> subject_2")
    gap = F.round((F.col("t_2") - F.col("t_1")) / 60, 1)
    out = m.select("case_id", "tower_id", "subject_1", "subject_2", "id_1", "id_2", gap.alias("gap_min"))
    return out.withColumn("confidence", F.when(F.col("gap_min") < 5, "High").when(F.col("gap_min") < 15, "Medium").otherwise("Low"))


def meeting_summary(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("total"), F.countDistinct(F.least("subject_1", "subject_2"), F.greatest("subject_1", "subject_2")).alias("pairs"), *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("High", "Medium", "Low")])


def meeting_counts(cdr: DataFrame, window_min: float = 60) -> DataFrame:
    """``meeting_summary`` of ``meetings``: meetings are counted as they are joined, and pairs by bits, so that no table of meetings is written."""
    m = meetings(cdr, window_min).agg(F.count("*").alias("total"), *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("High", "Medium", "Low")])
    rows = cdr.where("case_id IS NOT NULL AND tower_id IS NOT NULL AND a_party_number IS NOT NULL AND start_time IS NOT NULL")
    rows = rows.select("case_id", "tower_id", F.col("a_party_number").alias("subject"), F.unix_micros(F.col("start_time").cast("timestamp")).alias("us"))
    pairs = distinct_pairs(rows, ["case_id", "tower_id"], int(window_min * 60_000_000))
    return m.crossJoin(F.broadcast(pairs)).select("total", "pairs", "high", "medium", "low")  # one row each


def hour_meetings(cdr: DataFrame, per_record: bool = True) -> DataFrame:
    """Two callers at one tower in one hour of the clock: one row a pair of records, or a pair of callers."""
    slot = F.date_format("start_time", "yyyy-MM-dd HH")
    rows = cdr.where("tower_id IS NOT NULL").select("tower_id", slot.alias("slot"), F.col("a_party_number").alias("s"), "id")
    rows = rows if per_record else rows.drop("id").distinct()
    side = lambda k: rows.select("tower_id", "slot", *[F.col(c).alias(f"{c}{k}") for c in rows.columns if c not in ("tower_id", "slot")])
    return side(1).join(side(2), ["tower_id", "slot"]).where("s1 < s2")


def colocation_counts(cdr: DataFrame, seconds: int = 3600) -> DataFrame:
    """Row pairs strictly less than an hour apart, by pair and tower."""
    rows = cdr.where("tower_id IS NOT NULL").select("id", "tower_id", F.col("a_party_number").alias("subject"), epoch("start_time").alias("t"))
    m = band_pairs(rows, ["tower_id"], seconds).where((F.col("subject_1") != F.col("subject_2")) & (F.col("t_2") - F.col("t_1") < seconds))
    return m.groupBy(F.least("subject_1", "subject_2").alias("a"), F.greatest("subject_1", "subject_2").alias("b"), "tower_id").agg(F.count("*").alias("n"))
