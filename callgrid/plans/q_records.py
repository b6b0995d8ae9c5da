"""C: record queries."""

from pyspark.sql import functions as F

from ..functions.exprs import when_text
from ..operators import records as r
from .catalog import register

AT = "strftime(start_time,'%Y-%m-%d %H:%M:%S')"


def _plain(df, *columns):
    return df.select("id", when_text("start_time").alias("at"), *columns)


register("A06_case_scan", lambda t: r.in_case(t.cdr, "2").select("id", "a_party_number", "b_party_number"), "SELECT id, a_party_number, b_party_number FROM cdr WHERE case_id='2'")
register(
    "C01_cdr_list", lambda t: _plain(r.list_records(t.cdr, r.CDR_SEARCH, case_id="1", call_type="Voice", direction="MO", limit=200, offset=20), "a_party_number", "tower_id"),
    f"SELECT id, {AT} AS at, a_party_number, tower_id FROM cdr WHERE case_id='1' AND call_type='Voice' AND direction='MO' ORDER BY start_time DESC, id DESC LIMIT 200 OFFSET 20",
)
register(
    "C02_ipdr_list", lambda t: _plain(r.list_records(t.ipdr, r.IPDR_SEARCH, protocol="UDP", rat="LTE"), "source_ip", "destination_ip"),
    f"SELECT id, {AT} AS at, source_ip, destination_ip FROM ipdr WHERE protocol='UDP' AND rat='LTE'",
)
register(
    "C03_search", lambda t: t.cdr.where(r.search(r.CDR_SEARCH, " T00 ")).select("id", "tower_id").union(t.ipdr.where(r.search(r.IPDR_SEARCH, "udp")).select("id", "tower_id")),
    "SELECT id, tower_id FROM cdr WHERE " + " OR ".join(f"coalesce(contains(lower({c}),'t00'),false)" for c in r.CDR_SEARCH)
    + " UNION ALL SELECT id, tower_id FROM ipdr WHERE " + " OR ".join(f"coalesce(contains(lower({c}),'udp'),false)" for c in r.IPDR_SEARCH),
)
register(
    "C04_unified_page", lambda t: _plain(r.page(t.cdr, t.ipdr, case_id="1", limit=500, offset=100), "rtype"),
    f"SELECT id, {AT} AS at, rtype FROM (SELECT id, start_time, 'cdr' AS rtype FROM cdr WHERE case_id='1' UNION ALL SELECT id, start_time, 'ipdr' FROM ipdr WHERE case_id='1') ORDER BY start_time DESC, id DESC LIMIT 500 OFFSET 100",
)
register(
    "C05_service_page", lambda t: _plain(r.page(t.cdr, t.ipdr, service="SMS"), "rtype"),
    f"SELECT id, {AT} AS at, 'cdr' AS rtype FROM cdr WHERE call_type='SMS' UNION ALL SELECT id, {AT}, 'ipdr' FROM ipdr WHERE protocol='SMS'",
)
register("C06_services", lambda t: r.services(t.cdr, t.ipdr), "SELECT call_type AS service FROM cdr UNION SELECT protocol FROM ipdr")
register("C07_cdr_subjects", lambda t: r.distinct_values(t.cdr, "a_party_number", "subject"), "SELECT DISTINCT a_party_number AS subject FROM cdr")
register("C08_ipdr_subjects", lambda t: r.distinct_values(t.ipdr, "source_ip", "subject"), "SELECT DISTINCT source_ip AS subject FROM ipdr")
LOCATED = """, loc AS (SELECT id, 'cdr' AS rtype, tower_id, latitude, longitude, a_party_number AS subject, b_party_number AS other, msisdn FROM cdr JOIN tw USING (tower_id)
 UNION ALL SELECT id, 'ipdr', tower_id, latitude, longitude, source_ip, destination_ip, msisdn FROM ipdr JOIN tw USING (tower_id)) """
register(
    "C09_located", lambda t: r.located(t.cdr, t.ipdr, t.towers, "0000001").select("id", "rtype", "tower_id", "latitude", "longitude"),
    LOCATED + "SELECT id, rtype, tower_id, latitude, longitude FROM loc WHERE contains(subject,'0000001') OR contains(other,'0000001') OR (rtype='ipdr' AND contains(msisdn,'0000001'))",
)
register("C10_located_subjects", lambda t: r.located_subjects(t.cdr, t.ipdr, t.towers), LOCATED + "SELECT subject FROM loc UNION SELECT msisdn FROM loc WHERE rtype='cdr'")
register(
    "C11_tower_search", lambda t: r.find_towers(t.towers, "city3"),
    "SELECT * FROM tw WHERE contains(lower(tower_id),'city3') OR contains(lower(city),'city3') OR coalesce(contains(lower(state),'city3'),false) ORDER BY tower_id LIMIT 100",
)


def subscribers(t):
    c = t.spark.read.parquet(f"{t.dir}/customer.parquet")
    return c.select(
        F.concat(F.lit("98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("msisdn"), F.col("c_name").alias("name"), F.concat(F.lit("Block "), F.col("c_nationkey").cast("string")).alias("address"),
        F.concat(F.lit("97"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("alt_number"),
    )


SUBSCRIBERS = """, sub AS (SELECT concat('98',lpad(CAST(c_custkey AS VARCHAR),8,'0')) AS msisdn, c_name AS name, concat('Block ',CAST(c_nationkey AS VARCHAR)) AS address,
 concat('97',lpad(CAST(c_custkey AS VARCHAR),8,'0')) AS alt_number FROM customer) """
register(
    "C12_subscriber_search", lambda t: r.find_subscribers(subscribers(t), "0000012"),
    SUBSCRIBERS + "SELECT * FROM sub WHERE contains(msisdn,'0000012') OR contains(lower(name),'0000012') OR contains(alt_number,'0000012') OR contains(lower(address),'0000012') ORDER BY msisdn LIMIT 50",
)
register(
    "C13_subscriber_lookup", lambda t: r.with_subscriber(t.cdr.select("id", "a_party_number"), subscribers(t), "a_party_number"),
    SUBSCRIBERS + "SELECT id, a_party_number, name, address FROM cdr LEFT JOIN sub ON a_party_number = sub.msisdn",
)


def cases(t):
    ids = t.cdr.select("case_id").union(t.ipdr.select("case_id")).distinct()
    return ids.select(F.col("case_id").cast("long").alias("id"), F.concat(F.lit("Case "), F.col("case_id")).alias("name"), F.when(F.col("case_id") == "3", True).alias("archived"), F.col("case_id").alias("updated_at"))


register(
    "C15_case_list", lambda t: r.case_list(cases(t), t.cdr, t.ipdr).select("case_id", "name", "cdr_count", "ipdr_count"),
    "SELECT case_id, concat('Case ',case_id) AS name, count(*) FILTER (WHERE k='c') AS cdr_count, count(*) FILTER (WHERE k='i') AS ipdr_count FROM (SELECT case_id,'c' AS k FROM cdr UNION ALL SELECT case_id,'i' FROM ipdr) WHERE case_id<>'3' GROUP BY case_id",
)
POLYGON = [(10.0, 70.0), (10.0, 90.0), (25.0, 95.0), (30.0, 80.0), (20.0, 72.0)]


def _ray(points):
    parts = []
    for (y1, x1), (y2, x2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            parts.append(f"CASE WHEN ({y1} > latitude) <> ({y2} > latitude) AND longitude < ({x2}-{x1})*(latitude-{y1})/({y2}-{y1})+{x1} THEN 1 ELSE 0 END")
    return "(" + "+".join(parts) + ")%2=1"


register(
    "C16_geofence", lambda t: r.in_polygon(r.with_position(t.cdr, t.towers), POLYGON).select("id", "tower_id"),
    "SELECT id, tower_id FROM cdr JOIN tw USING (tower_id) WHERE " + _ray(POLYGON),
)
register(
    "C14_audit_rows",
    lambda t: r.audit_rows(t.cdr.select("id", F.col("start_time").alias("ts"), F.col("a_party_number").alias("username"), F.col("call_type").alias("action")), {"action": "SMS"}, since="2024-01-05").select("id", "username", "action"),
    " SELECT id, a_party_number AS username, call_type AS action FROM cdr WHERE call_type='SMS' AND start_time>=TIMESTAMP '2024-01-05'",
)
register(
    "D33_watchlist_groups", lambda t: r.watchlist_groups(t.cdr.select("a_party_number", F.when(F.col("id") % 3 > 0, F.col("technology")).alias("group")).distinct()),
    " SELECT coalesce(g, 'Default') AS \"group\", count(*) AS n FROM (SELECT DISTINCT a_party_number, CASE WHEN id%3>0 THEN technology END AS g FROM cdr) GROUP BY 1",
)
