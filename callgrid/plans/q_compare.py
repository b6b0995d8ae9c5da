"""F: comparison, cases, dumps, towers."""

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import compare as c
from ..operators.records import with_position
from ..operators.reports import owned
from .catalog import register
from .q_records import SUBSCRIBERS, subscribers

S = ["9800000010", "9800000012", "9800000014"]
IN = "(" + ",".join(f"'{x}'" for x in S) + ")"
TS = "strftime({},'%Y-%m-%d %H:%M:%S')"
INV = ", inv AS (SELECT cdr.*, a_party_number AS subject, b_party_number AS other FROM cdr UNION ALL SELECT cdr.*, b_party_number, a_party_number FROM cdr WHERE a_party_number<>b_party_number) "
_common = lambda rows, v, k: f"SELECT {v} AS value, count(DISTINCT subject) AS subjects, count(*) AS n FROM {rows} WHERE subject IN {IN} AND {v} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT subject)>={k}"
OWN = "(SELECT *, a_party_number AS subject FROM cdr)"
register("F01_common_contacts", lambda t: c.common_contacts(t.cdr, S, 2), INV + f"SELECT * FROM ({_common('inv', 'other', 2)}) WHERE value NOT IN {IN}")
register("F02_common_towers", lambda t: c.common(owned(t.cdr), ["9800000010", "9800000030", "9800000050"], "tower_id"), INV + _common(OWN, "tower_id", 3).replace(IN, "('9800000010','9800000030','9800000050')"))
register("F03_common_cells", lambda t: c.common(owned(t.cdr), S, "technology"), INV + _common(OWN, "technology", 3))
register("F04_common_imeis", lambda t: c.common(owned(t.cdr), ["9800000012", "9800000013"], "imei"), INV + _common(OWN, "imei", 2).replace(IN, "('9800000012','9800000013')"))
LOC = "(SELECT a_party_number AS subject, printf('%.3f',latitude)||','||printf('%.3f',longitude) AS place FROM cdr JOIN tw USING (tower_id))"
register("F05_common_places", lambda t: c.common_places(with_position(owned(t.cdr), t.towers), ["9800000010", "9800000030"]), INV + _common(LOC, "place", 2).replace(IN, "('9800000010','9800000030')"))
MANY = [f"98{n:08d}" for n in range(0, 60)]
register("F06_call_matrix", lambda t: c.call_matrix(t.cdr, MANY), INV + f"SELECT a_party_number, b_party_number, count(*) AS n FROM cdr WHERE a_party_number IN {tuple(MANY)} AND b_party_number IN {tuple(MANY)} GROUP BY 1,2")
IPS = ["10.0.0.0", "10.0.1.1", "10.0.2.2"]
_ips = lambda v: _common("(SELECT *, source_ip AS subject FROM ipdr)", v, 3).replace(IN, f"{tuple(IPS)}")
register(
    "F07_ipdr_common", lambda t: c.common(t.ipdr.withColumn("subject", F.col("source_ip")), IPS, "destination_ip").withColumn("field", F.lit("destination")).union(c.common(t.ipdr.withColumn("subject", F.col("source_ip")), IPS, "apn").withColumn("field", F.lit("apn"))),
    f", z AS (SELECT 1) SELECT *, 'destination' AS field FROM ({_ips('destination_ip')}) UNION ALL SELECT *, 'apn' FROM ({_ips('apn')})",
)
ID = """, idn AS (SELECT DISTINCT case_id, subject, type, value FROM (SELECT case_id, a_party_number AS subject, 'number' AS type, a_party_number AS value FROM cdr
 UNION ALL SELECT case_id, a_party_number, 'imei', imei FROM cdr UNION ALL SELECT case_id, a_party_number, 'imsi', imsi FROM cdr UNION ALL SELECT case_id, msisdn, 'imei', imei FROM ipdr UNION ALL SELECT case_id, msisdn, 'imsi', imsi FROM ipdr)),
 rol AS (SELECT case_id, type, value, max(role) AS role FROM (SELECT case_id, 'number' AS type, a_party_number AS value, 'subject' AS role FROM cdr UNION ALL SELECT case_id, 'number', b_party_number, 'counterpart' FROM cdr
 UNION ALL SELECT case_id, 'imei', imei, 'subject' FROM cdr UNION ALL SELECT case_id, 'imsi', imsi, 'subject' FROM cdr UNION ALL SELECT case_id, 'number', msisdn, 'subject' FROM ipdr UNION ALL SELECT case_id, 'imei', imei, 'subject' FROM ipdr
 UNION ALL SELECT case_id, 'imsi', imsi, 'subject' FROM ipdr) GROUP BY 1,2,3),
 pm AS (SELECT subject, r.case_id, arg_min(type, CASE type WHEN 'number' THEN 0 WHEN 'imei' THEN 1 ELSE 2 END) AS type, max(role) AS role, count(DISTINCT (type, value)) AS matched, 'high' AS confidence
 FROM (SELECT * FROM idn WHERE case_id='1') i JOIN (SELECT * FROM rol WHERE case_id<>'1') r USING (type, value) GROUP BY 1,2),
 im AS (SELECT ip, case_id, max(role) AS role, count(*) AS n, 'low' AS confidence FROM (SELECT case_id, source_ip AS ip, 'subject' AS role FROM ipdr UNION ALL SELECT case_id, destination_ip, 'counterpart' FROM ipdr)
 WHERE case_id<>'1' AND ip IN (SELECT source_ip FROM ipdr WHERE case_id='1') GROUP BY 1,2) """
register("F08_value_cases", lambda t: c.roles(t.cdr, t.ipdr).where("case_id <> '1'").join(c.identifiers(t.cdr, t.ipdr).where("case_id = '1'").select("type", "value").distinct(), ["type", "value"], "left_semi").select("type", "value", "case_id"),
         ID + "SELECT type, value, case_id FROM rol WHERE case_id<>'1' AND (type, value) IN (SELECT (type, value) FROM idn WHERE case_id='1')")
register("F09_identifiers", lambda t: c.identifiers(t.cdr, t.ipdr), ID + "SELECT * FROM idn")
register("F10_phone_matches", lambda t: c.phone_matches(t.cdr, t.ipdr, "1"), ID + "SELECT * FROM pm")
register(
    "F11_match_ranges", lambda t: c.match_ranges(t.cdr, t.ipdr, "1"),
    ID + f""", tg AS (SELECT case_id, id, 'c' AS feed, start_time, unnest(['number','number','imei','imsi']) AS type, unnest([a_party_number,b_party_number,imei,imsi]) AS value FROM cdr WHERE case_id<>'1'
 UNION ALL SELECT case_id, id, 'i', start_time, unnest(['number','imei','imsi']), unnest([msisdn,imei,imsi]) FROM ipdr WHERE case_id<>'1')
 SELECT subject, case_id, count(*) AS records, {TS.format('min(start_time)')} AS first, {TS.format('max(start_time)')} AS last FROM (SELECT DISTINCT i.subject, tg.case_id, feed, id, start_time FROM tg JOIN (SELECT * FROM idn WHERE case_id='1') i USING (type, value)) GROUP BY 1,2""",
)
register("F12_ip_matches", lambda t: c.ip_matches(t.ipdr, "1"), ID + "SELECT * FROM im")
_best = lambda v, a: f"(SELECT case_id, subject, string_agg({v}, ',' ORDER BY {v}) AS {a} FROM (SELECT case_id, subject, {v} FROM inv GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY case_id, subject ORDER BY count(*) DESC, {v})<=3) GROUP BY 1,2)"
register(
    "F13_phone_activity", lambda t: c.phone_activity(t.cdr, t.ipdr),
    INV + f"""SELECT g.*, top_contacts, top_towers, peak_hour, coalesce(sessions,0) AS sessions FROM (SELECT case_id, subject, count(*) FILTER (WHERE call_type='Voice') AS voice, count(*) FILTER (WHERE call_type='SMS') AS sms, CAST(0 AS BIGINT) AS others, count(DISTINCT other) AS contacts FROM inv GROUP BY 1,2) g
 JOIN {_best('other', 'top_contacts')} USING (case_id, subject) JOIN {_best('tower_id', 'top_towers')} USING (case_id, subject)
 JOIN (SELECT case_id, subject, hour(start_time) AS peak_hour FROM inv GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY case_id, subject ORDER BY count(*) DESC, peak_hour)=1) USING (case_id, subject)
 LEFT JOIN (SELECT case_id, msisdn AS subject, count(*) AS sessions FROM ipdr GROUP BY 1,2) USING (case_id, subject)""",
)
register(
    "F14_ip_activity", lambda t: c.ip_activity(t.ipdr),
    "SELECT case_id, source_ip, count(*) AS sessions, count(*) FILTER (WHERE protocol='UDP') AS udp, count(*) FILTER (WHERE protocol='TCP') AS tcp, count(DISTINCT destination_ip) AS destinations, CAST(sum(bytes_uploaded+bytes_downloaded) AS BIGINT) AS bytes, count(DISTINCT tower_id) AS towers FROM ipdr GROUP BY 1,2",
)
register(
    "F15_case_overview", lambda t: c.case_overview(t.cdr, t.ipdr, "1"),
    ID + """, kn AS (SELECT case_id, type, value FROM rol UNION SELECT case_id, 'ip', source_ip FROM ipdr UNION SELECT case_id, 'ip', destination_ip FROM ipdr),
 ow AS (SELECT subject, type, value FROM idn WHERE case_id='1' AND subject IN (SELECT a_party_number FROM cdr WHERE case_id='1') UNION SELECT source_ip, 'ip', source_ip FROM ipdr WHERE case_id='1'),
 o AS (SELECT subject, count(DISTINCT kn.case_id) AS cases, arg_min(type, CASE type WHEN 'number' THEN 0 WHEN 'imei' THEN 1 WHEN 'imsi' THEN 2 ELSE 3 END) AS type FROM ow JOIN (SELECT * FROM kn WHERE case_id<>'1') kn USING (type, value) GROUP BY 1) SELECT *, CASE WHEN type='ip' THEN 'low' ELSE 'high' END AS confidence FROM o""",
)
register("F16_case_report", lambda t: c.case_report(t.cdr, t.ipdr, "1"), ID + "SELECT case_id, count(*) AS subjects, count(*) FILTER (WHERE type='number') AS by_number, count(*) FILTER (WHERE type='imei') AS by_imei, count(*) FILTER (WHERE type='imsi') AS by_imsi, CAST(sum(matched) AS BIGINT) AS matched FROM pm GROUP BY 1")
register("F17_case_graph", lambda t: c.case_graph(t.cdr, t.ipdr, "1"), ID + "SELECT 'subject:'||subject AS src, 'case:'||case_id AS dst, type, confidence FROM pm UNION ALL SELECT 'subject:'||ip, 'case:'||case_id, 'ip', confidence FROM im")


def dumps(t):
    return t.cdr.where(F.col("tower_id").isin("T001", "T003", "T005", "T006", "T008", "T000")).withColumn("dump_label", F.col("tower_id"))


DU = ", du AS (SELECT *, tower_id AS dump_label FROM cdr WHERE tower_id IN ('T001','T003','T005','T006','T008','T000')) "
NU = "SELECT msisdn, count(DISTINCT dump_label) AS dumps, string_agg(DISTINCT dump_label, ',' ORDER BY dump_label) AS labels, string_agg(DISTINCT imei, ',' ORDER BY imei) AS imeis FROM du GROUP BY 1"
register("F18_dump_list", lambda t: c.dump_list(dumps(t)), DU + f"SELECT dump_label, count(*) AS rows, count(DISTINCT msisdn) AS numbers, {TS.format('min(start_time)')} AS first, {TS.format('max(start_time)')} AS last FROM du GROUP BY 1")
register("F19_common_numbers", lambda t: c.common_numbers(dumps(t)), DU + NU + " HAVING count(DISTINCT dump_label)>=2")
register("F20_uncommon_numbers", lambda t: c.uncommon_numbers(dumps(t)), DU + NU + " HAVING count(DISTINCT dump_label)=1")
register("F21_under_tower", lambda t: c.under_tower(dumps(t), "T001"), DU + "SELECT msisdn, count(*) AS n FROM du WHERE dump_label='T001' GROUP BY 1")
_mult = lambda k, o, kind: f"SELECT {k} AS key, count(DISTINCT {o}) AS n, string_agg(DISTINCT {o}, ',' ORDER BY {o}) AS others, '{kind}' AS kind FROM cdr GROUP BY 1 HAVING count(DISTINCT {o})>1"
register("F22_multiplicity", lambda t: c.multiplicity(t.cdr), DU + _mult("msisdn", "imei", "number") + " UNION ALL " + _mult("imei", "msisdn", "handset"))
register(
    "F23_rebuild_towers", lambda t: c.merge_towers(t.towers.where("tower_id < 'T030'").withColumn("latitude", F.when(F.col("city") != "City4", F.col("latitude"))).withColumn("longitude", F.when(F.col("city") != "City4", F.col("longitude"))), c.harvest(with_position(t.cdr, t.towers))),
    " SELECT tower_id, latitude, longitude, CASE WHEN tower_id<'T030' THEN city END AS city, CASE WHEN tower_id<'T030' THEN state END AS state, CASE WHEN tower_id>='T030' THEN 'added' WHEN city='City4' THEN 'updated' ELSE 'same' END AS change FROM tw",
)
HAV = "2*6371.0*asin(least(1.0,sqrt(pow(sin(radians(y-latitude)/2),2)+cos(radians(latitude))*cos(radians(y))*pow(sin(radians(x-longitude)/2),2))))"
CITY = "city_(ord,c,s,y,x) AS (VALUES " + ",".join(f"({i},'{a}','{b}',CAST({y} AS DOUBLE),CAST({x} AS DOUBLE))" for i, (a, b, y, x) in enumerate(dims.CITIES)) + ")"
register(
    "F24_geocode", lambda t: c.geocode(t.towers, dims.cities(t.spark)),
    f", {CITY}, nr AS (SELECT tower_id, arg_min((c, s), (round({HAV},6), ord)) AS b FROM tw CROSS JOIN city_ GROUP BY 1) SELECT tower_id, latitude, longitude, coalesce(city, b[1]) AS city, coalesce(state, b[2]) AS state FROM tw JOIN nr USING (tower_id)",
)
register("F25_colocation", lambda t: c.colocation(t.cdr), INV + "SELECT tower_id, count(DISTINCT subject) AS parties FROM inv GROUP BY 1 HAVING count(DISTINCT subject)>=2")
register(
    "F26_enrich", lambda t: c.enrich(owned(t.cdr).select("id", "subject", F.col("b_party_number").alias("other")), subscribers(t).select(F.col("msisdn").alias("subject"), F.col("address").alias("tag")), subscribers(t).select(F.col("msisdn").alias("subject_a"), F.concat(F.lit("98"), F.lpad((F.substring("msisdn", 3, 8).cast("int") + 1).cast("string"), 8, "0")).alias("subject_b"), F.col("name").alias("label"))),
    SUBSCRIBERS + "SELECT id, a_party_number AS subject, b_party_number AS other, least(a_party_number,b_party_number) AS subject_a, greatest(a_party_number,b_party_number) AS subject_b, s.address AS tag, l.name AS label FROM cdr LEFT JOIN sub s ON s.msisdn=a_party_number LEFT JOIN sub l ON l.msisdn=least(a_party_number,b_party_number) AND concat('98',lpad(CAST(CAST(substr(l.msisdn,3) AS INT)+1 AS VARCHAR),8,'0'))=greatest(a_party_number,b_party_number)",
)


def pairs(t):
    p = t.cdr.where("a_party_number < b_party_number").select(F.col("a_party_number").alias("a"), F.col("b_party_number").alias("b")).distinct()
    return p


_sh = lambda v: f"(SELECT count(*) FROM (SELECT DISTINCT {v} FROM cdr WHERE a_party_number=p.a INTERSECT SELECT DISTINCT {v} FROM cdr WHERE a_party_number=p.b))"
_sets = lambda v, n: f"(SELECT a, b, count(*) AS {n} FROM p JOIN (SELECT DISTINCT a_party_number AS a, {v} AS v FROM cdr) USING (a) JOIN (SELECT DISTINCT a_party_number AS b, {v} AS v FROM cdr) USING (b, v) GROUP BY 1,2)"
register(
    "F27_correlation", lambda t: c.correlation(t.cdr, pairs(t)),
    f""", p AS (SELECT DISTINCT a_party_number AS a, b_party_number AS b FROM cdr WHERE a_party_number<b_party_number), cc AS (SELECT a_party_number AS s, start_time AS t1, start_time+to_seconds(duration_seconds) AS t2 FROM cdr),
 ov AS (SELECT a, b, count(*) AS overlapping FROM p JOIN cc x ON x.s=a JOIN cc y ON y.s=b WHERE x.t1<y.t2 AND y.t1<x.t2 GROUP BY 1,2)
 SELECT a, b, coalesce(contacts,0) AS contacts, coalesce(services,0) AS services, coalesce(towers,0) AS towers, coalesce(overlapping,0) AS overlapping, 5*coalesce(contacts,0)+2*coalesce(services,0)+coalesce(towers,0)+4*coalesce(overlapping,0) AS score
 FROM p LEFT JOIN {_sets('b_party_number', 'contacts')} USING (a,b) LEFT JOIN {_sets('call_type', 'services')} USING (a,b) LEFT JOIN {_sets('tower_id', 'towers')} USING (a,b) LEFT JOIN ov USING (a,b)""",
)
register(
    "F28_highlighted", lambda t: c.highlighted(t.cdr, t.cdr.where("tower_id = 'T001'").select(F.col("imei").alias("value")), ["a_party_number", "b_party_number", "imei", "tower_id"]).select("id"),
    " SELECT id FROM cdr WHERE imei IN (SELECT imei FROM cdr WHERE tower_id='T001')",
)
register(
    "B07_harvest_towers", lambda t: c.harvest(with_position(t.cdr, t.towers)), " SELECT tower_id, latitude, longitude FROM tw",
)
register(
    "B08_replace_towers", lambda t: c.replace_towers(t.towers, t.towers.where("tower_id < 'T010'").withColumn("city", F.lit("New"))),
    " SELECT tower_id, latitude, longitude, CASE WHEN tower_id<'T010' THEN 'New' ELSE city END AS city, state FROM tw",
)
register(
    "B09_upsert_subscribers", lambda t: c.upsert_subscribers(subscribers(t), t.cdr.select("msisdn", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("imei")).alias("name"), F.lit(None).cast("string").alias("address"), F.col("id").alias("seq")), ["name", "address"]),
    SUBSCRIBERS + ", n AS (SELECT msisdn, arg_max(imei, id) FILTER (WHERE id%3<>0) AS name FROM cdr GROUP BY 1) SELECT msisdn, coalesce(n.name, sub.name) AS name, address FROM sub FULL JOIN n USING (msisdn)",
)
