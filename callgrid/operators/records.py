"""Record queries: filters, search, unified pages, located records, lookups."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CDR_SEARCH = ["msisdn", "imsi", "imei", "a_party_number", "b_party_number", "call_type", "direction", "tower_id", "technology"]
IPDR_SEARCH = ["msisdn", "imsi", "imei", "source_ip", "destination_ip", "protocol", "tower_id", "apn", "rat"]


def newest() -> list[Column]:
    return [F.desc_nulls_last("start_time"), F.desc("id")]


def in_case(df: DataFrame, case_id: str | None) -> DataFrame:
    return df if case_id is None else df.where(F.col("case_id") == case_id)


def search(columns: list[str], term: str | None) -> Column:
    """Any column contains the term, ignoring case; a blank term matches all."""
    if not (term or "").strip():
        return F.lit(True)
    return reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(term.strip().lower()), F.lit(False)) for c in columns])


def list_records(df: DataFrame, columns: list[str], start=None, end=None, case_id=None, term=None, offset: int = 0, limit: int = 0, **equal) -> DataFrame:
    """Records that meet all given filters, newest first; limit 0: all."""
    out = in_case(df, case_id).where(search(columns, term))
    out = out.where(F.col("start_time") >= F.lit(start)) if start is not None else out
    out = out.where(F.col("start_time") <= F.lit(end)) if end is not None else out
    for c, v in equal.items():
        out = out.where(F.col(c) == v) if v is not None else out
    out = out.orderBy(*newest()).offset(offset)
    return out.limit(limit) if limit else out


def page(cdr: DataFrame, ipdr: DataFrame, case_id=None, term=None, service=None, offset: int = 0, limit: int = 0) -> DataFrame:
    """One list of calls and sessions, newest first; ``service`` is a call type or a protocol."""
    a = in_case(cdr, case_id).where(search(CDR_SEARCH, term))
    b = in_case(ipdr, case_id).where(search(IPDR_SEARCH, term))
    if service is not None:
        a, b = a.where(F.col("call_type") == service), b.where(F.col("protocol") == service)
    both = a.withColumn("rtype", F.lit("cdr")).unionByName(b.withColumn("rtype", F.lit("ipdr")), allowMissingColumns=True)
    out = both.orderBy(*newest(), F.col("rtype")).offset(offset)
    return out.limit(limit) if limit else out


def services(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    both = cdr.select(F.col("call_type").alias("service")).union(ipdr.select("protocol"))
    return both.where("service IS NOT NULL AND service <> ''").distinct().orderBy("service")


def distinct_values(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct().orderBy(name)


def with_position(df: DataFrame, towers: DataFrame) -> DataFrame:
    """latitude and longitude of the row itself or, where either is missing, both of its tower."""
    t = towers.select(F.col("tower_id").alias("__t"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    own = "latitude" in df.columns
    both = df.join(t, df["tower_id"] == t["__t"], "left")
    if own:
        had = df["latitude"].isNotNull() & df["longitude"].isNotNull()
        both = both.withColumn("__lat", F.when(had, df["latitude"]).otherwise(F.col("__lat"))).withColumn("__lon", F.when(had, df["longitude"]).otherwise(F.col("__lon"))).drop("latitude", "longitude")
    return both.withColumnRenamed("__lat", "latitude").withColumnRenamed("__lon", "longitude").drop("__t")


def located(cdr: DataFrame, ipdr: DataFrame, towers: DataFrame, subject: str | None = None) -> DataFrame:
    """Calls and sessions with a position; ``subject`` is part of a party or address."""
    a = with_position(cdr, towers).select("id", F.lit("cdr").alias("rtype"), "start_time", "tower_id", "latitude", "longitude", F.col("a_party_number").alias("subject"), F.col("b_party_number").alias("other"), "msisdn")
    b = with_position(ipdr, towers).select("id", F.lit("ipdr").alias("rtype"), "start_time", "tower_id", "latitude", "longitude", F.col("source_ip").alias("subject"), F.col("destination_ip").alias("other"), "msisdn")
    out = a.unionByName(b).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    if subject:
        part = lambda c: F.coalesce(F.col(c).contains(subject), F.lit(False))
        out = out.where(part("subject") | part("other") | ((F.col("rtype") == "ipdr") & part("msisdn")))
    return out.orderBy(*newest())


def located_subjects(cdr: DataFrame, ipdr: DataFrame, towers: DataFrame) -> DataFrame:
    rows = located(cdr, ipdr, towers)
    return rows.select("subject").union(rows.where("rtype = 'cdr'").select("msisdn")).where("subject IS NOT NULL").distinct()


def find_towers(towers: DataFrame, term: str | None, offset: int = 0, limit: int = 100) -> DataFrame:
    return towers.where(search(["tower_id", "city", "state"], term)).orderBy("tower_id").offset(offset).limit(limit)


def find_subscribers(subscribers: DataFrame, term: str, limit: int = 50) -> DataFrame:
    return subscribers.where(search(["msisdn", "name", "alt_number", "address"], term)).orderBy("msisdn").limit(limit)


def with_subscriber(df: DataFrame, subscribers: DataFrame, key: str) -> DataFrame:
    return df.join(subscribers.select(F.col("msisdn").alias(key), "name", "address"), key, "left")


def case_list(cases: DataFrame, cdr: DataFrame, ipdr: DataFrame, archived: bool = False) -> DataFrame:
    """Cases with their record counts, the last updated first; a case is archived only if it says so."""
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    out = cases if archived else cases.where(~F.coalesce("archived", F.lit(False)))
    out = out.withColumn("case_id", F.col("id").cast("string")).join(n(cdr, "cdr_count"), "case_id", "left").join(n(ipdr, "ipdr_count"), "case_id", "left")
    return out.na.fill(0, ["cdr_count", "ipdr_count"]).orderBy(F.desc_nulls_last("updated_at"), "case_id")


def in_polygon(df: DataFrame, polygon: list[tuple[float, float]], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows whose point lies inside (lat, lon) vertices, by ray casting; a box test comes first and reaches the scan."""
    lats, lons = [p[0] for p in polygon], [p[1] for p in polygon]
    box = F.col(lat).between(min(lats), max(lats)) & F.col(lon).between(min(lons), max(lons))
    crossings = F.lit(0)
    for (y1, x1), (y2, x2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > F.col(lat)) != (F.lit(y2) > F.col(lat))
            crossings = crossings + F.when(spans & (F.col(lon) < (x2 - x1) * (F.col(lat) - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return df.where(box).where(crossings % 2 == 1)


def audit_rows(audit: DataFrame, equal: dict[str, str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Audit rows with these values and times (both ends included), the newest first."""
    for name, value in (equal or {}).items():
        audit = audit.where(F.col(name) == value)
    if since is not None:
        audit = audit.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        audit = audit.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    return audit.orderBy(F.desc("ts"), F.desc("id"))


def watchlist_groups(watch: DataFrame) -> DataFrame:
    """Entries of each group; those without one are in Default."""
    name = F.coalesce(F.nullif(F.trim("group"), F.lit("")), F.lit("Default"))
    return watch.groupBy(name.alias("group")).agg(F.count("*").alias("n"))
