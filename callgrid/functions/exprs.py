"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM, EARTH_KM_ROUND = 6371.0088, 6371.0
#: Upper speeds (km/h) of the travel modes (fixed values); beyond the last a leg is impossible.
SPEEDS = [(3, "stationary"), (12, "walking"), (45, "urban"), (120, "road"), (250, "rail"), (900, "air")]


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Kilometres between two positions; null if any of them is."""
    lat1, lon1, lat2, lon2 = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # least() would take 1 for null


def classify_speed(kmh: Column) -> Column:
    out = None
    for top, name in SPEEDS:
        out = F.when(kmh <= top, name) if out is None else out.when(kmh <= top, name)
    return out.otherwise("impossible")


def epoch(ts: str | Column) -> Column:
    """Seconds since 1970 of a zone-less time, as a double."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def day(ts: str = "start_time") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def when_text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def hour(ts: str = "start_time") -> Column:
    return F.hour(ts).cast("long")


def week_start(ts: str = "start_time") -> Column:
    """The Monday of the week."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s >= 3600, F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s >= 60, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def human_bytes(n: Column, base: int = 1024) -> Column:
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= base**power, F.concat(F.format_number(n / float(base**power), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def is_sms(call_type: str | Column = "call_type") -> Column:
    c = F.lower(F.coalesce(F.col(call_type) if isinstance(call_type, str) else call_type, F.lit("")))
    return c.contains("sms") | c.contains("text")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def looks_foreign(number: Column) -> Column:
    """An international prefix, or fewer than ten digits."""
    return number.startswith("+") | number.startswith("00") | (F.length(digits(number)) < 10)


def national_number(number: Column) -> Column:
    """The ten-digit national number, or null."""
    d = digits(number)
    d = F.when(d.startswith("00"), F.substring(d, 3, 40)).otherwise(d)
    return (
        F.when(d.startswith("91") & (F.length(d) > 10), F.substring(d, -10, 10))
        .when((F.length(d) == 10) & d.rlike("^[6-9]"), d)
        .when((F.length(d) == 11) & d.startswith("0"), F.substring(d, 2, 10))
    )


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    part = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    good = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(good, ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4))


def cidr_bounds(cidr: Column) -> tuple[Column, Column, Column]:
    """Lowest and highest address and prefix length of an IPv4 network."""
    base, plen = ip_number(F.split(cidr, "/")[0]), F.try_element_at(F.split(cidr, "/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2), 32 - plen).cast("long")
    low = F.floor(base / size) * size
    return low.cast("long"), (low + size - 1).cast("long"), plen


def top_per(df: DataFrame, keys: Iterable[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def joined(c: Column) -> Column:
    """A set of strings as sorted text."""
    return F.array_join(F.sort_array(F.collect_set(c)), ",")
