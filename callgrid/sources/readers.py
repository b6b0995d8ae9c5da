"""Feeds: delimited files read as text only, headers mapped to canonical names, values cast, bad rows set aside."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Canonical columns of each feed, the required ones, and other names that headers go by.
COLUMNS = {
    "cdr": ["msisdn", "imsi", "imei", "a_party_number", "b_party_number", "call_type", "direction", "start_time", "end_time", "duration_seconds", "tower_id", "cell_id", "lac", "latitude", "longitude", "technology"],
    "ipdr": ["msisdn", "imsi", "imei", "start_time", "end_time", "duration_seconds", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "bytes_uploaded", "bytes_downloaded", "tower_id", "cell_id", "lac", "latitude", "longitude", "apn", "rat"],
    "dump": ["msisdn", "imsi", "imei", "other_party", "start_time", "end_time", "call_type", "tower_id", "cell_id", "lac", "latitude", "longitude"],
    "sdr": ["msisdn", "imsi", "imei", "name", "address", "alt_number", "id_proof", "activation_date", "operator"],
}
REQUIRED = {"cdr": ["a_party_number", "b_party_number", "start_time", "end_time", "duration_seconds"], "ipdr": ["start_time", "end_time", "source_ip", "destination_ip"], "dump": ["msisdn", "start_time"], "sdr": ["msisdn"]}
# Other names that headers of each feed go by, after normalising; a name counts for the first column that lists it.
ALIASES = {
    "cdr": {
        "a_party_number": "aparty a_party caller calling_number calling_party callingnumber originating_number from_number msisdn_a a_no anumber",
        "b_party_number": "bparty b_party called called_number called_party callednumber terminating_number to_number msisdn_b b_no bnumber",
        "start_time": "starttime call_date call_datetime datetime date_time start start_date call_start event_time timestamp date",
        "end_time": "endtime end call_end stop_time disconnect_time",
        "duration_seconds": "duration call_duration dur duration_sec durationsecs duration_secs call_dur",
        "msisdn": "mobile_number subscriber subscriber_number",
        "imei": "imei_number handset device_id imei_no",
        "imsi": "imsi_number sim imsi_no",
        "call_type": "calltype type event_type service_type",
        "direction": "call_direction in_out io",
        "tower_id": "towerid cgi site_id first_cgi cell_global_id tower",
        "cell_id": "cellid ci cell",
        "lac": "location_area_code tac",
        "latitude": "lat tower_lat latitude_deg",
        "longitude": "long lng lon tower_long tower_lng longitude_deg",
        "technology": "tech rat network_type bearer",
    },
    "ipdr": {
        "start_time": "starttime session_start datetime date_time start start_date event_time timestamp date",
        "end_time": "endtime session_end end stop_time",
        "source_ip": "sourceip src_ip source_ip_address private_ip src source_address",
        "destination_ip": "destinationip dest_ip dst_ip destination_ip_address public_ip dst destination_address",
        "source_port": "sourceport src_port private_port sport",
        "destination_port": "destinationport dest_port dst_port public_port dport",
        "duration_seconds": "duration session_duration dur duration_sec",
        "protocol": "proto ip_protocol l4_protocol",
        "bytes_uploaded": "bytes_up uplink_bytes ul_bytes upload_bytes data_up uplink_volume",
        "bytes_downloaded": "bytes_down downlink_bytes dl_bytes download_bytes data_down downlink_volume",
        "msisdn": "mobile_number subscriber subscriber_number",
        "imei": "imei_number handset device_id",
        "imsi": "imsi_number sim",
        "tower_id": "towerid cgi site_id cell_global_id tower",
        "cell_id": "cellid ci cell",
        "lac": "location_area_code tac",
        "latitude": "lat tower_lat",
        "longitude": "long lng lon tower_long tower_lng",
        "apn": "access_point_name apn_name",
        "rat": "radio_access_technology network_type technology bearer",
    },
    "dump": {
        "msisdn": "mobile_number number a_party aparty calling_number party subscriber subscriber_number caller msisdn_a a_no",
        "other_party": "b_party bparty called called_number b_no called_party to_number",
        "start_time": "starttime call_date datetime date_time start start_date event_time timestamp date first_seen",
        "end_time": "endtime end stop_time last_seen",
        "call_type": "calltype type event_type service_type",
        "imei": "imei_number handset device_id imei_no",
        "imsi": "imsi_number sim imsi_no",
        "tower_id": "towerid cgi site_id cell_global_id tower first_cgi",
        "cell_id": "cellid ci cell",
        "lac": "location_area_code tac",
        "latitude": "lat tower_lat",
        "longitude": "long lng lon tower_long tower_lng",
    },
    "sdr": {
        "msisdn": "mobile_number number phone contact_number target_number mobile msisdn_no subscriber_number",
        "name": "subscriber_name customer_name cust_name sub_name full_name",
        "address": "addr residential_address address1 customer_address current_address",
        "alt_number": "alternate_number alt_no alternate_contact alt_mobile secondary_number alternate_mobile",
        "id_proof": "id idproof id_document poi poa document id_type",
        "activation_date": "activation doa date_of_activation activated_on activation_dt",
        "operator": "provider telco carrier service_provider tsp",
        "imsi": "imsi_number sim",
        "imei": "imei_number handset device_id",
    },
}
# Operators and what in the headers hints at them, in order.
HINTS = [("Airtel", ["airtel"]), ("Jio", ["jio", "ril"]), ("Vi", ["vodafone", "vodafone_idea", "vi_"]), ("BSNL", ["bsnl"])]
# Time formats, tried in this order.
FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm",
]
#: What else is read, day first, where none of those fits.
LATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "dd-MMM-yyyy", "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyyMMddHHmmss", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSS"]
TIMES, WHOLE, REAL = {"start_time", "end_time"}, {"duration_seconds": "int", "source_port": "int", "destination_port": "int", "bytes_uploaded": "bigint", "bytes_downloaded": "bigint"}, {"latitude", "longitude"}


def normal_header(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def resolve(headers: list[str], kind: str, override: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
    """Canonical name -> header, and the required names that no header stands for.

    A user's choice wins where the file has such a header. Otherwise the first header of the file counts that is
    the name itself or one of its aliases; a header that several columns list stands for the first of them.
    """
    stands = {c: c for c in COLUMNS[kind]}
    for c, others in ALIASES[kind].items():
        for alias in others.split():
            stands.setdefault(alias, c)
    found: dict[str, str] = {}
    for h in headers:
        c = stands.get(normal_header(h))
        if c:
            found.setdefault(c, h)
    found |= {c: h for c, h in (override or {}).items() if c in COLUMNS[kind] and h in headers}
    return found, [c for c in REQUIRED[kind] if c not in found]


def operator_hint(headers: list[str]) -> str | None:
    """The operator that the headers speak of, if any."""
    text = " ".join(map(normal_header, headers))
    return next((name for name, parts in HINTS if any(p in text for p in parts)), None)


def delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Every column as text. Without ``sep`` the header line decides between comma, semicolon, tab and bar."""
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        line = first[0][0] if first else ""
        sep = max([",", ";", "\t", "|"], key=line.count)
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def dimension(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A reference table from a user's file, JSON rows (.json) or delimited text with a header: these columns with these types, in the order of the file.

    Headers are normalised; values that don't cast are null; ``ord`` numbers the rows where it is asked for.
    """
    raw = spark.read.json(path) if path.endswith(".json") else delimited(spark, path)
    by = {normal_header(c): c for c in raw.columns}
    missing = [c for c in columns if c != "ord" and c not in by]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[(F.monotonically_increasing_id() if c == "ord" else F.trim(F.col(f"`{by[c]}`").cast("string"))).try_cast(kind).alias(c) for c, kind in columns.items()])


def parse_time(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in FORMATS + LATE_FORMATS]).cast("timestamp_ntz")


def canonical(raw: DataFrame, kind: str, case_id: str | None = None, override: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rejected rows as text: those without a start time that any format reads (sdr: without a number). Nulls stand for what does not cast."""
    found, missing = resolve(raw.columns, kind, override)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")

    def typed(c: str) -> Column:
        if c not in found:
            kindof = "timestamp_ntz" if c in TIMES else WHOLE.get(c, "double" if c in REAL else "string")
            return F.lit(None).cast(kindof).alias(c)
        v = F.col(f"`{found[c]}`")
        if c in TIMES:
            return parse_time(v).alias(c)
        if c in WHOLE:
            return F.expr(f"try_cast(try_cast(trim(`{found[c]}`) as double) as {WHOLE[c]})").alias(c)
        if c in REAL:
            return F.expr(f"try_cast(trim(`{found[c]}`) as double)").alias(c)
        return F.nullif(F.trim(v), F.lit("")).alias(c)

    key = "msisdn" if kind == "sdr" else "start_time"
    ok = (F.nullif(F.trim(F.col(f"`{found[key]}`")), F.lit("")) if kind == "sdr" else parse_time(F.col(f"`{found[key]}`"))).isNotNull()
    return raw.where(ok).select(F.lit(case_id).cast("string").alias("case_id"), *[typed(c) for c in COLUMNS[kind]]), raw.where(~ok)


def _report_columns(raw: DataFrame, kind: str, override: dict[str, str] | None) -> tuple[list[Column], dict[str, str]]:
    """Counts of an import: rows, those with a start time, those without, and times that no format reads by column; a missing time is no failure."""
    found, missing = resolve(raw.columns, kind, override)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    bad = parse_time(F.col(f"`{found['start_time']}`")).isNull()
    failed = lambda c: F.count_if(F.col(f"`{found[c]}`").isNotNull() & parse_time(F.col(f"`{found[c]}`")).isNull()) if c in found else F.lit(0).cast("long")
    counts = [F.count("*").alias("total"), F.count_if(~bad).alias("imported"), F.count_if(bad).alias("dropped"), failed("start_time").alias("start_failed"), failed("end_time").alias("end_failed")]
    return counts, found


def import_report(raw: DataFrame, kind: str, override: dict[str, str] | None = None) -> DataFrame:
    """Rows read, imported and dropped, and unread times of each column and in all, in one pass."""
    counts, _ = _report_columns(raw, kind, override)
    return raw.agg(*counts).withColumn("date_failures", F.col("start_failed") + F.col("end_failed"))


def observed(raw: DataFrame, kind: str, case_id: str | None = None, override: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, Observation]:
    """As ``canonical``, with the counts of ``import_report`` taken by the job that writes the good rows: no pass of their own.

    Where that job runs only in part (a limit), the counts are of what it read.
    """
    counts, _ = _report_columns(raw, kind, override)
    seen = Observation()
    good, _ = canonical(raw.observe(seen, *counts), kind, case_id, override)
    return good, canonical(raw, kind, case_id, override)[1], seen


def examples(rejected: DataFrame, n: int = 5) -> DataFrame:
    """Some rejected rows as a report shows them; tasks stop once they are found."""
    return rejected.limit(n)


def preview(raw: DataFrame, kind: str, n: int = 50, override: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """The first rows, and how the headers are read: mapping, missing required names, the operator they hint at. Nothing is written."""
    found, missing = resolve(raw.columns, kind, override)
    return raw.limit(n), {"mapping": found, "missing": missing, "operator": operator_hint(raw.columns), "required": REQUIRED[kind]}


def merged_networks(networks: DataFrame) -> DataFrame:
    """Overlapping and adjacent address ranges (provider, lo, hi) as one each: gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy("provider").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = networks.withColumn("new", F.when(F.col("lo") <= top + 1, 0).otherwise(1))
    return r.withColumn("g", F.sum("new").over(w)).groupBy("provider", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("g")


