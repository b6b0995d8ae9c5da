"""Traffic classes of reconstructed sessions: ordered rules over what a session's rows say together.

A session has the set of port kinds that it used (bits), its transports, duration, bytes, the share of them that went up, rows and the
hour at which it began. The first rule that holds names the class, with evidence and what it adds to or takes from the confidence of an
attribution. All of it is columns, so a session is classified in the aggregate that builds it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import epoch
from ..functions.services import EPHEMERAL
from .attribution import in_sessions

# Ports of tunnels, remote desktops, file transfer, and voice and video.
KINDS = {
    "vpn": [500, 1194, 1195, 1701, 1723, 4500, 51820, 51821],
    "remote": [3389, 5900, 5901, 5902, 5903],
    "transfer": [20, 21, 139, 445, 989, 990],
    "media": [3478, 3479, 3480, 3481, 16384, 16387, 19302, 19303, 19304, 19305, 8801, 8810, 5004],
}
BIT = {name: 1 << i for i, name in enumerate(KINDS)}
#: Documented: a tunnel lasts over 30 seconds, an upload is over 0.7 of the bytes.
TUNNEL_SECONDS, UPLOAD_SHARE = 30, 0.7


@dataclass(frozen=True)
class Limits:
    """What the words of the documentation mean where it gives no number: seconds, bytes, rows, and shares of the bytes that go up."""

    persistent: int = 120
    sustained: int = 60
    long: int = 300
    moderate_seconds: int = 30
    short: int = 60
    burst: int = 10
    moderate: int = 100_000
    high: int = 5_000_000
    small: int = 20_000
    minimal: int = 2_000
    sync_rows: int = 3
    even_low: float = 0.3
    even_high: float = 0.7
    down_heavy: float = 0.15


def session_features(ipdr: DataFrame, families: DataFrame) -> DataFrame:
    """source_ip, destination_ip, family, session, rows, seconds, up, down, share (up of all bytes, null of none), kinds (bits), udp, tcp and hour.

    A source port speaks only below the ephemeral ones or where there is no destination port. Null bytes count as 0; a session whose rows have no time has no duration and no hour.
    """
    port = lambda c: F.col(c).cast("int")
    since = F.when((port("source_port") < EPHEMERAL) | F.col("destination_port").isNull(), port("source_port"))
    bits = lambda p: reduce(lambda x, y: x.bitwiseOR(y), [F.when(p.isin(ports), BIT[k]).otherwise(0) for k, ports in KINDS.items()])
    end = F.coalesce("end_time", "start_time") if "end_time" in ipdr.columns else F.col("start_time")
    proto = F.upper(F.trim("protocol"))
    rows = in_sessions(ipdr, families).withColumn("__kinds", bits(port("destination_port")).bitwiseOR(bits(since)))
    g = rows.groupBy("source_ip", "destination_ip", "family", "session").agg(
        F.count("*").alias("rows"), F.floor(epoch(F.max(end)) - epoch(F.min("start_time"))).cast("long").alias("seconds"),
        F.sum(F.coalesce("bytes_uploaded", F.lit(0))).cast("long").alias("up"), F.sum(F.coalesce("bytes_downloaded", F.lit(0))).cast("long").alias("down"),
        F.bit_or("__kinds").alias("kinds"), F.coalesce(F.bool_or(proto == "UDP"), F.lit(False)).alias("udp"), F.coalesce(F.bool_or(proto == "TCP"), F.lit(False)).alias("tcp"), F.hour(F.min("start_time")).alias("hour"),
    )
    return g.withColumn("share", F.col("up") / F.when(F.col("up") + F.col("down") > 0, F.col("up") + F.col("down")))


def rules(x: Limits) -> list[tuple[str, Column, int, str]]:
    """class, test, change of confidence and evidence, in order; the last holds always."""
    c = F.col
    kind = lambda name: c("kinds").bitwiseAND(BIT[name]) > 0
    seconds, total, share = F.coalesce("seconds", F.lit(0)), c("up") + c("down"), c("share")
    both = (c("up") > 0) & (c("down") > 0)
    even = share.between(x.even_low, x.even_high)
    moderate = total.between(x.moderate, x.high)
    return [
        ("VPN / Encrypted Tunnel", kind("vpn") & (c("udp") | c("tcp")) & (seconds > TUNNEL_SECONDS), 10, "Tunnel port held open"),
        ("Remote Desktop", kind("remote") & c("tcp"), 10, "Remote desktop port over TCP"),
        ("File Transfer", kind("transfer") & both, 8, "File transfer port, data both ways"),
        ("Cloud Sync", c("tcp") & (seconds >= x.persistent) & (c("rows") >= x.sync_rows) & both & even & moderate, 5, "Persistent TCP, data both ways"),
        ("Video Call", c("udp") & (total > x.high) & (seconds >= x.sustained) & even, 8, "Symmetric UDP of high volume"),
        ("Voice Call", c("udp") & kind("media") & even & (seconds >= x.moderate_seconds), 8, "Symmetric UDP on media ports"),
        ("Conference", c("udp") & (seconds >= x.long) & moderate, 5, "Long UDP session of moderate volume"),
        ("Screen Sharing", c("udp") & (seconds >= x.sustained) & moderate, 5, "Sustained UDP of moderate volume"),
        ("Streaming", c("tcp") & (share < x.down_heavy) & (seconds >= x.long), 6, "Long TCP download"),
        ("Media Upload", share > UPLOAD_SHARE, 5, "Most bytes go up"),
        ("Messaging", c("udp") & (seconds <= x.burst) & (total > x.minimal) & (total <= x.small), 3, "Short burst of little UDP data"),
        ("Browsing / Interactive", c("tcp") & (seconds <= x.short) & (total > x.minimal) & (total <= x.high), 2, "Short TCP session"),
        ("Presence / Keep-alive", (total <= x.minimal) & (seconds <= x.burst), -5, "Minimal traffic"),
        ("Network Traffic", F.lit(True), 0, "No distinct pattern"),
    ]


def traffic_classes(ipdr: DataFrame, families: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The sessions with their features, class, change of confidence and evidence, which notes hours late at night (0 to 4) and of business (9 to 17)."""
    found = session_features(ipdr, families)
    every = rules(limits or Limits())
    number = reduce(lambda out, i: out.when(every[i][1], i + 1), range(1, len(every)), F.when(every[0][1], 1))
    at = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in every]), F.col("__rule"))
    when = F.when(F.col("hour") < 5, "Late-night activity").when(F.col("hour").between(9, 17), "Business hours")
    out = found.withColumn("__rule", number)
    return out.select(*found.columns, at(0).alias("class"), at(2).alias("confidence_change"), F.array_compact(F.array(at(3), when)).alias("evidence"))


def traffic_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count("*").alias("sessions"), F.sum("rows").alias("rows"), F.sum(F.col("up") + F.col("down")).alias("bytes"), F.max("seconds").alias("longest"))
