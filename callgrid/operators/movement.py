"""Movement: subject streams, legs, anchors, dwell, shared routes."""

from __future__ import annotations

from functools import reduce
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import classify_speed, epoch, haversine_km, top_per
from .records import with_position

ORDER = ["start_time", "id"]
MIN_LEG_KM, FAR_KM, IMPOSSIBLE_KMH = 1.0, 5.0, 900.0
SHARED_MOST, SHARED_LEAST = 30, 3


def by_subject() -> Window:
    return Window.partitionBy("subject").orderBy(*ORDER)


def streams(cdr: DataFrame, towers: DataFrame) -> DataFrame:
    """Calls by subject (number, else SIM) with kind and position."""
    rows = with_position(cdr, towers).withColumn("subject", F.coalesce("msisdn", "imsi"))
    return rows.where("subject IS NOT NULL AND start_time IS NOT NULL").withColumn("kind", F.when(F.upper("call_type") == "SMS", "sms").otherwise("call"))


def with_leg(stream: DataFrame) -> DataFrame:
    """Adds from_tower, from_imei, km, hours, kmh, impossible and mode of the leg from the row before, and ``moved``, whether there is one (see ``legs``)."""
    w = by_subject()
    before = lambda c: F.lag(c).over(w)
    km = haversine_km(before("latitude"), before("longitude"), "latitude", "longitude")
    rows = stream.withColumns({"from_tower": before("tower_id"), "from_imei": before("imei"), "km": km, "hours": (epoch("start_time") - epoch(before("start_time"))) / 3600})
    rows = rows.withColumn("kmh", F.when(F.col("hours") > 0, F.col("km") / F.col("hours")))
    moved = F.coalesce((F.col("km") >= MIN_LEG_KM) & (F.col("kmh").isNotNull() | (F.col("km") >= FAR_KM)), F.lit(False))
    impossible = F.when(F.col("kmh").isNull(), True).otherwise((F.col("kmh") > IMPOSSIBLE_KMH) & (F.col("km") >= FAR_KM))
    return rows.withColumns({"moved": moved, "impossible": impossible, "mode": F.when(F.col("kmh").isNull(), "impossible").otherwise(classify_speed(F.col("kmh")))})


def legs(stream: DataFrame) -> DataFrame:
    """The leg from the row before, located or not: at least a kilometre between two located rows, with speed and mode.

    Impossible: faster than 900 km/h over 5 km or more, or 5 km in no time (speed null).
    """
    return with_leg(stream).where("moved").select("subject", "id", "start_time", "tower_id", "imei", "from_tower", "from_imei", "km", "hours", "kmh", "impossible", "mode")


def first_impossible(stream: DataFrame) -> DataFrame:
    return top_per(legs(stream).where("impossible"), ["subject"], [F.col(c) for c in ORDER], 1)


def anchors(stream: DataFrame) -> DataFrame:
    """The towers most used at night (22 to 6) and at work (Monday to Friday, 9 to 17), with the position last seen there."""
    h = F.hour("start_time")
    home = (h >= 22) | (h < 6)
    work = h.between(9, 16) & F.weekday("start_time").between(0, 4)
    rows = stream.where("tower_id IS NOT NULL")
    at = F.struct(*ORDER)
    last = rows.groupBy("subject", "tower_id").agg(F.max_by("latitude", at).alias("latitude"), F.max_by("longitude", at).alias("longitude"))

    def most(part: Column, name: str) -> DataFrame:
        g = rows.where(part).groupBy("subject", "tower_id").agg(F.count("*").alias("n"))
        return top_per(g, ["subject"], [F.desc("n"), F.col("tower_id")], 1).withColumn("anchor", F.lit(name))

    return most(home, "home").union(most(work, "work")).join(last, ["subject", "tower_id"])


def profile(stream: DataFrame) -> DataFrame:
    base = stream.groupBy("subject").agg(F.countDistinct("tower_id").alias("towers"), F.count("*").alias("events"))
    modes = legs(stream).groupBy("subject").agg(F.max("km").alias("longest_km"), *[F.count_if(F.col("mode") == m).alias(m) for m in ("walking", "urban", "road", "rail", "air", "impossible")])
    return base.join(modes, "subject", "left").na.fill(0)


def dwell(stream: DataFrame, n: int = 6, most_hours: float = 24) -> DataFrame:
    """Hours at each tower: the gap to the next located row, if at most a day, counts for the tower before it."""
    rows = stream.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    gap = (epoch(F.lead("start_time").over(by_subject())) - epoch("start_time")) / 3600
    g = rows.withColumn("gap", gap).groupBy("subject", "tower_id").agg(F.sum(F.when((F.col("gap") > 0) & (F.col("gap") <= most_hours), F.col("gap"))).alias("hours"), F.count("*").alias("visits")).where("hours IS NOT NULL")
    return top_per(g, ["subject"], [F.desc(F.round("hours", 6)), F.col("tower_id")], n)


def mobility(stream: DataFrame) -> DataFrame:
    p = stream.groupBy("subject").agg(F.countDistinct("tower_id").alias("towers")).join(legs(stream).groupBy("subject").agg(F.max("km").alias("km")), "subject", "left").na.fill(0.0, ["km"])
    kind = F.when(F.col("towers") <= 1, "stationary").when((F.col("towers") <= 3) & (F.col("km") < 25), "local").when((F.col("km") >= 100) | (F.col("towers") >= 8), "highly mobile").otherwise("mobile")
    return p.select("subject", "towers", kind.alias("mobility"))


def tower_runs(stream: DataFrame) -> DataFrame:
    """The towers of a subject in order, repeats in a row once."""
    rows = stream.where("tower_id IS NOT NULL")
    return rows.withColumn("__b", F.lag("tower_id").over(by_subject())).where("__b IS NULL OR __b <> tower_id").drop("__b")


def route_shingles(stream: DataFrame) -> DataFrame:
    w = by_subject()
    r = tower_runs(stream).select("subject", F.concat_ws(">", "tower_id", F.lead("tower_id", 1).over(w), F.lead("tower_id", 2).over(w)).alias("shingle"), F.lead("tower_id", 2).over(w).alias("third"))
    return r.where("third IS NOT NULL").select("subject", "shingle").distinct()


def route_pairs(stream: DataFrame, most: int = SHARED_MOST, least: int = SHARED_LEAST) -> DataFrame:
    """All pairs with at least ``least`` common runs of three towers; runs that over 30 subjects share say nothing and drop out, which also bounds the pairs."""
    s = route_shingles(stream)
    rare = s.groupBy("shingle").agg(F.count("*").alias("c")).where(F.col("c").between(2, most)).select("shingle")
    s = s.join(rare, "shingle")
    g = s.select(F.col("subject").alias("a"), "shingle").join(s.select(F.col("subject").alias("b"), "shingle"), "shingle").where("a < b").groupBy("a", "b").agg(F.count("*").alias("segments"))
    return g.where(F.col("segments") >= least)


def shared_routes(stream: DataFrame, n: int = 15, most: int = SHARED_MOST, least: int = SHARED_LEAST) -> DataFrame:
    """The pairs with most common runs."""
    return route_pairs(stream, most, least).orderBy(F.desc("segments"), "a", "b").limit(n)


def stays(stream: DataFrame, least: int = 2) -> DataFrame:
    """Runs of consecutive rows at one tower."""
    rows = stream.where("tower_id IS NOT NULL")
    change = F.when(F.lag("tower_id").over(by_subject()) == F.col("tower_id"), 0).otherwise(1)
    runs = rows.withColumn("change", change).withColumn("run", F.sum("change").over(by_subject()))
    g = runs.groupBy("subject", "run", "tower_id").agg(F.count("*").alias("n"), F.min("start_time").alias("s"), F.max("start_time").alias("e"))
    return g.where(F.col("n") >= least).select("subject", "tower_id", "n", F.round((epoch("e") - epoch("s")) / 60, 3).alias("minutes"))


#: Cell radius (km) by technology (fixed values).
RADIUS = [("5G", 1.0), ("4G", 3.0), ("3G", 5.0), ("2G", 15.0)]


def position_fixes(stream: DataFrame, minutes: int = 30) -> DataFrame:
    """A position from at least two towers within half an hour: their centre, weighted by the square of the inverse radius."""
    r = F.lit(5.0)
    for name, km in RADIUS:
        r = F.when(F.upper("technology") == name, km).otherwise(r)
    rows = stream.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("w", 1 / (r * r)).withColumn("slot", F.floor(epoch("start_time") / (minutes * 60)))
    g = rows.groupBy("subject", "slot").agg(F.countDistinct("tower_id").alias("towers"), (F.sum(F.col("w") * F.col("latitude")) / F.sum("w")).alias("latitude"), (F.sum(F.col("w") * F.col("longitude")) / F.sum("w")).alias("longitude"))
    return g.where("towers >= 2").select("subject", "slot", "towers", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


def zones(stream: DataFrame) -> DataFrame:
    return stream.where("tower_id IS NOT NULL").groupBy("subject", "tower_id").agg(F.count("*").alias("visits"))


def lcs_similarity(stream: DataFrame, pairs: DataFrame) -> DataFrame:
    """Longest common subsequence of tower runs, as a share of the shorter, of candidate pairs (a, b); never of all pairs.

    A subject's towers form one list, compared whole. Arrow batches are kept small, as routes may be long.
    """
    stream.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    runs = tower_runs(stream).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("start_time", "id", "tower_id"))).alias("s")).select("subject", F.transform("s", lambda x: x["tower_id"]).alias("route"))
    both = pairs.select("a", "b").join(runs.select(F.col("subject").alias("a"), F.col("route").alias("x")), "a").join(runs.select(F.col("subject").alias("b"), F.col("route").alias("y")), "b")

    def lcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "common": [_lcs(list(x), list(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)], "shorter": [min(len(x), len(y)) for x, y in zip(pdf["x"], pdf["y"], strict=True)]})

    return both.mapInPandas(lcs, "a string, b string, common long, shorter long").withColumn("similarity", F.round(F.col("common") / F.col("shorter"), 3))


def _lcs(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence: one row of bits per step."""
    at: dict[str, int] = {}
    for i, v in enumerate(x):
        at[v] = at.get(v, 0) | 1 << i
    full, row = (1 << len(x)) - 1, (1 << len(x)) - 1
    for v in y:
        m = row & at.get(v, 0)
        row = (row + m | row - m) & full
    return len(x) - row.bit_count()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
