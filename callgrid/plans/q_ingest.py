"""A, B and S: exports, network merging, time parsing, import reports, number helpers."""

from pyspark.sql import functions as F

from ..functions import addresses
from ..functions import exprs as x
from ..sources import feeds, readers, sinks
from .catalog import register

register(
    "A11_export_rows", lambda t: sinks.export_rows(t.cdr, t.ipdr).select("type", "id", "source", "target", "svc", "tower_id"),
    " SELECT 'cdr' AS type, id, a_party_number AS source, b_party_number AS target, call_type AS svc, tower_id FROM cdr UNION ALL SELECT 'ipdr', id, source_ip, destination_ip, protocol, tower_id FROM ipdr",
)
register(
    "A14_merged_networks", lambda t: readers.merged_networks(t.ipdr.select(F.col("protocol").alias("provider"), F.col("destination_port").cast("long").alias("lo"), (F.col("destination_port") + F.col("id") % 40).cast("long").alias("hi"))),
    ", n AS (SELECT protocol AS provider, CAST(destination_port AS BIGINT) AS lo, CAST(destination_port+id%40 AS BIGINT) AS hi FROM ipdr), m AS (SELECT *, CASE WHEN lo<=max(hi) OVER (PARTITION BY provider ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)+1 THEN 0 ELSE 1 END AS new FROM n), g AS (SELECT *, sum(new) OVER (PARTITION BY provider ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT provider, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY provider, g",
)
_FORMS = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyyMMddHHmmss"]


def _texts(t):
    """Start times as text in four forms, and every tenth row without one."""
    form = F.lit("never")
    for i, f in enumerate(_FORMS):
        form = F.when((F.col("id") / 2) % 5 == i, F.date_format("start_time", f)).otherwise(form)
    return t.cdr.select("id", "b_party_number", F.col("a_party_number"), form.alias("start_time"), form.alias("end_time"), F.col("duration_seconds").cast("string"))


register(
    "B04_parsed_times", lambda t: readers.canonical(_texts(t), "cdr")[0].select("a_party_number", "b_party_number", x.when_text("start_time").alias("at"), F.col("duration_seconds").cast("long").alias("seconds")),
    " SELECT a_party_number, b_party_number, strftime(CASE WHEN (id/2)%5=2 THEN date_trunc('minute',start_time) ELSE start_time END,'%Y-%m-%d %H:%M:%S') AS at, CAST(duration_seconds AS BIGINT) AS seconds FROM cdr WHERE (id/2)%5<4",
)
def _with_end_times(t):
    """As above, every seventh end time missing and every eleventh in a form of its own."""
    n = F.col("id") / 2
    return _texts(t).withColumn("end_time", F.when(n % 7 == 0, None).when(n % 11 == 0, F.lit("31st of May")).otherwise(F.date_format(F.lit("2024-01-01 10:00:00"), "yyyy-MM-dd HH:mm:ss")))


register(
    "B05_import_report", lambda t: readers.import_report(_with_end_times(t), "cdr"),
    " SELECT count(*) AS total, count(*) FILTER (WHERE (id/2)%5<4) AS imported, count(*) FILTER (WHERE (id/2)%5=4) AS dropped, count(*) FILTER (WHERE (id/2)%5=4) AS start_failed, count(*) FILTER (WHERE (id//2)%7<>0 AND (id//2)%11=0) AS end_failed, count(*) FILTER (WHERE (id/2)%5=4) + count(*) FILTER (WHERE (id//2)%7<>0 AND (id//2)%11=0) AS date_failures FROM cdr",
)


def _num():
    """Numbers with a country code, a leading 0 or too few digits among plain ones."""
    return F.when(F.col("id") % 8 == 0, F.concat(F.lit("+91"), "a_party_number")).when(F.col("id") % 8 == 2, F.concat(F.lit("0"), "a_party_number")).when(F.col("id") % 8 == 4, F.lit("12345")).otherwise(F.col("a_party_number"))


register(
    "S10_national_numbers", lambda t: t.cdr.select("id", x.national_number(_num()).alias("number"), x.looks_foreign(_num()).alias("foreign_looking")),
    " SELECT id, CASE WHEN id%8=4 THEN NULL ELSE a_party_number END AS number, id%8 IN (0,4) AS foreign_looking FROM cdr",
)
register("S12_ip_numbers", lambda t: t.ipdr.select("id", x.ip_number(F.col("source_ip")).alias("n")), " SELECT id, CAST(split_part(source_ip,'.',1) AS BIGINT)*16777216+CAST(split_part(source_ip,'.',2) AS BIGINT)*65536+CAST(split_part(source_ip,'.',3) AS BIGINT)*256+CAST(split_part(source_ip,'.',4) AS BIGINT) AS n FROM ipdr")
register("S05_durations", lambda t: t.cdr.select("id", x.hms(F.col("duration_seconds")).alias("text")), " SELECT id, CASE WHEN s>=3600 THEN printf('%dh %dm %ds',s//3600,s%3600//60,s%60) WHEN s>=60 THEN printf('%dm %ds',s//60,s%60) ELSE printf('%ds',s) END AS text FROM (SELECT id, duration_seconds AS s FROM cdr)")


def _feed(t):
    """A feed document for each session: its destination's network of 20 to 32 bits, and an IPv6 network made of its id, under the published keys."""
    four = F.concat("destination_ip", F.lit("/"), (20 + F.col("id") % 13).cast("string"))
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("id") % 4096)), F.lit("::/"), (46 + F.col("id") % 3).cast("string"))
    return t.ipdr.select("case_id", F.to_json(F.struct(F.lit("7").alias("syncToken"), F.array(F.struct(four.alias("ip_prefix"), F.lit("x").alias("region"))).alias("prefixes"), F.array(F.struct(six.alias("ipv6_prefix"))).alias("ipv6_prefixes"))).alias("doc"))


def _merged_feed(t):
    nets = _feed(t).select(F.col("case_id").alias("provider"), F.explode(feeds.networks_of(F.col("doc"), "Amazon")).alias("cidr"))
    out = feeds.merged_networks(nets)
    # IPv6 networks of 46 to 48 bits: the upper half in units of 2 to the 16
    unit = lambda c: F.when(F.col("family") == 4, F.col(f"{c}.low")).otherwise(F.col(f"{c}.high") / 65536).cast("long").alias(c)
    return out.select("provider", "family", unit("start"), unit("end"))


register(
    "A14_provider_feeds", _merged_feed,
    """, n0 AS (SELECT case_id AS provider, 4 AS family, CAST(split_part(destination_ip,'.',1) AS BIGINT)*16777216+CAST(split_part(destination_ip,'.',2) AS BIGINT)*65536+CAST(split_part(destination_ip,'.',3) AS BIGINT)*256+CAST(split_part(destination_ip,'.',4) AS BIGINT) AS a, CAST(1 AS BIGINT) << CAST(12-id%13 AS INT) AS size FROM ipdr
 UNION ALL SELECT case_id, 6, 2306139568115548160//65536+id%4096, CAST(1 AS BIGINT) << CAST(2-id%3 AS INT) FROM ipdr),
 n AS (SELECT DISTINCT provider, family, a-a%size AS lo, a-a%size+size AS hi FROM n0), m AS (SELECT *, CASE WHEN lo<=max(hi) OVER (PARTITION BY provider, family ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM n),
 g AS (SELECT *, sum(new) OVER (PARTITION BY provider, family ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT provider, family, min(lo) AS start, max(hi) AS "end" FROM g GROUP BY provider, family, g""",
)


def _ip6(t):
    """IPv6 addresses of a mapped tail: the id as two groups before the destination's four bytes."""
    group = lambda c: F.lower(F.hex(c))
    return t.ipdr.select("id", F.concat(F.lit("2001:DB8::"), group(F.floor(F.col("id") / 65536) % 65536), F.lit(":"), group(F.col("id") % 65536), F.lit(":"), "destination_ip").alias("ip"))


register(
    "S12_ip6_numbers", lambda t: _ip6(t).select("id", addresses.address(F.col("ip")).alias("a")).select("id", "a.family", F.col("a.high").cast("long").alias("high"), F.col("a.low").cast("long").alias("low")),
    " SELECT id, 6 AS family, CAST(2306139568115548160 AS BIGINT) AS high, (id%65536)*4294967296 + ((id//65536)%65536)*281474976710656 + CAST(split_part(destination_ip,'.',1) AS BIGINT)*16777216+CAST(split_part(destination_ip,'.',2) AS BIGINT)*65536+CAST(split_part(destination_ip,'.',3) AS BIGINT)*256+CAST(split_part(destination_ip,'.',4) AS BIGINT) AS low FROM ipdr",
)
