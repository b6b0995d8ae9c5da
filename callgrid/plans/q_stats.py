"""D: statistics and dashboards."""

from pyspark.sql import functions as F

from ..operators import stats as s
from .catalog import register

DAY = "strftime(start_time,'%Y-%m-%d')"
TS = "strftime({}(start_time),'%Y-%m-%d %H:%M:%S')"

CONTACTS = "SELECT contact, count(*) AS n FROM (SELECT a_party_number AS contact FROM cdr UNION ALL SELECT b_party_number FROM cdr) GROUP BY contact ORDER BY n DESC, contact LIMIT 10"
register("D01_top_contacts", lambda t: s.top_contacts(t.cdr), CONTACTS)
register(
    "D02_cdr_totals", lambda t: s.cdr_totals(t.cdr),
    f"SELECT count(*) AS calls, CAST(sum(duration_seconds) AS BIGINT) AS seconds, round(sum(duration_seconds)/count(*),2) AS avg_seconds, count(DISTINCT a_party_number) AS callers, count(DISTINCT b_party_number) AS called, {TS.format('min')} AS first, {TS.format('max')} AS last FROM cdr",
)
register(
    "D03_cdr_distributions", lambda t: s.distributions(t.cdr, ["call_type", "direction", "technology"]),
    " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM cdr WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("call_type", "direction", "technology")),
)
register(
    "D04_ipdr_totals", lambda t: s.ipdr_totals(t.ipdr),
    f"SELECT count(*) AS sessions, CAST(sum(bytes_uploaded) AS BIGINT) AS up, CAST(sum(bytes_downloaded) AS BIGINT) AS down, CAST(sum(bytes_uploaded)+sum(bytes_downloaded) AS BIGINT) AS total, count(DISTINCT msisdn) AS subscribers, {TS.format('min')} AS first, {TS.format('max')} AS last FROM ipdr",
)
register(
    "D05_ipdr_distributions", lambda t: s.distributions(t.ipdr, ["protocol", "apn", "rat"]),
    " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM ipdr WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("protocol", "apn", "rat")),
)
DAILY = f"(SELECT day, count(*) FILTER (WHERE k='c') AS cdr, count(*) FILTER (WHERE k='i') AS ipdr FROM (SELECT {DAY} AS day,'c' AS k FROM cdr UNION ALL SELECT {DAY},'i' FROM ipdr) GROUP BY day)"
register("D06_daily_activity", lambda t: s.daily(t.cdr, t.ipdr), f"SELECT * FROM {DAILY}")
register(
    "D07_weekly_activity", lambda t: s.bucketed(t.cdr, t.ipdr, after=20),
    f"SELECT CASE WHEN (SELECT count(*) FROM {DAILY})>20 THEN strftime(date_trunc('week',CAST(day AS DATE)),'%Y-%m-%d') ELSE day END AS bucket, CAST(sum(cdr) AS BIGINT) AS cdr, CAST(sum(ipdr) AS BIGINT) AS ipdr FROM {DAILY} GROUP BY 1",
)
BOTH = "(SELECT start_time FROM cdr UNION ALL SELECT start_time FROM ipdr)"
register("D08_hourly", lambda t: s.hourly(t.cdr, t.ipdr), f"SELECT h AS hour, count(start_time) AS n FROM range(24) r(h) LEFT JOIN {BOTH} ON hour(start_time)=h GROUP BY h")
register("D09_weekday", lambda t: s.by_weekday(t.cdr, t.ipdr), f"SELECT d AS dow, count(start_time) AS n FROM range(7) r(d) LEFT JOIN {BOTH} ON dayofweek(start_time)=d GROUP BY d")
register("D10_pattern_of_life", lambda t: s.pattern_of_life(t.cdr, t.ipdr), f"SELECT isodow(start_time)-1 AS weekday, hour(start_time) AS hour, count(*) AS n FROM {BOTH} GROUP BY 1,2")
register("D11_contacts_or_destinations", lambda t: s.contacts_or_destinations(t.cdr.where("case_id = 'none'"), t.ipdr), "SELECT destination_ip AS contact, count(*) AS n FROM ipdr GROUP BY 1 ORDER BY n DESC, contact LIMIT 10")
register("D12_active_subjects", lambda t: s.active_subjects(t.cdr, t.ipdr), "SELECT subject, count(*) AS n FROM (SELECT a_party_number AS subject FROM cdr UNION ALL SELECT msisdn FROM ipdr) GROUP BY 1 ORDER BY n DESC, subject LIMIT 10")
register("D13_top_towers", lambda t: s.top_towers(t.cdr, t.ipdr), "SELECT tower, count(*) AS n FROM (SELECT tower_id AS tower FROM cdr UNION ALL SELECT tower_id FROM ipdr) GROUP BY 1 ORDER BY n DESC, tower LIMIT 10")
register("D14_call_types", lambda t: s.call_types(t.cdr, t.ipdr), "SELECT call_type AS kind, count(*) AS n FROM cdr GROUP BY 1")
register("D15_directions", lambda t: s.counted(t.cdr, "direction", "direction"), "SELECT direction, count(*) AS n FROM cdr GROUP BY 1")
CASE = "CASE WHEN d<10 THEN '<10' WHEN d<30 THEN '<30' WHEN d<60 THEN '<60' WHEN d<300 THEN '<300' WHEN d<900 THEN '<900' WHEN d<3600 THEN '<3600' ELSE '>=3600' END"
register(
    "D16_duration_histogram", lambda t: s.duration_histogram(t.cdr),
    f"SELECT b.bin, count(x.bin) AS n FROM (VALUES ('<10'),('<30'),('<60'),('<300'),('<900'),('<3600'),('>=3600')) b(bin) LEFT JOIN (SELECT {CASE} AS bin FROM (SELECT duration_seconds AS d FROM cdr)) x ON b.bin=x.bin GROUP BY 1",
)
register("D17_protocols", lambda t: s.counted(t.ipdr, F.upper("protocol"), "protocol"), "SELECT upper(protocol) AS protocol, count(*) AS n FROM ipdr GROUP BY 1")
register("D18_top_ports", lambda t: s.top_ports(t.ipdr), "SELECT CAST(destination_port AS BIGINT) AS port, count(*) AS n FROM ipdr GROUP BY 1 ORDER BY n DESC, port LIMIT 10")
register("D19_top_volume", lambda t: s.top_volume(t.ipdr), "SELECT destination_ip, CAST(sum(bytes_uploaded)+sum(bytes_downloaded) AS BIGINT) AS bytes FROM ipdr GROUP BY 1 ORDER BY bytes DESC, destination_ip LIMIT 10")
register("D20_by_state", lambda t: s.by_state(t.cdr, t.ipdr, t.towers), "SELECT state, count(*) AS n FROM cdr JOIN tw USING (tower_id) WHERE state IS NOT NULL GROUP BY 1 ORDER BY n DESC, state LIMIT 12")
DIV = f"(SELECT {DAY} AS day, strftime(date_trunc('week',start_time),'%Y-%m-%d') AS week, count(DISTINCT tower_id) AS towers FROM cdr GROUP BY 1,2)"
register("D21_tower_diversity", lambda t: s.tower_diversity(t.cdr, weekly=True), f"SELECT week, max(towers) AS towers FROM {DIV} GROUP BY 1")
register("D21_tower_diversity_daily", lambda t: s.tower_diversity(t.cdr), f"SELECT day, towers FROM {DIV}")
register(
    "D22_new_returning", lambda t: s.new_and_returning(t.cdr),
    f"SELECT day, count(*) FILTER (WHERE day=first) AS new, count(*) FILTER (WHERE day<>first) AS returning FROM (SELECT {DAY} AS day, min({DAY}) OVER (PARTITION BY b_party_number) AS first FROM cdr) GROUP BY 1",
)
register("D23_contact_direction", lambda t: s.contact_direction(t.cdr), "SELECT b_party_number AS contact, count(*) FILTER (WHERE direction='MO') AS mo, count(*) FILTER (WHERE direction='MT') AS mt, count(*) AS total FROM cdr GROUP BY 1 ORDER BY total DESC, contact LIMIT 8")
register("D24_contact_duration", lambda t: s.contact_duration(t.cdr), "SELECT b_party_number AS contact, round(avg(duration_seconds),1) AS avg_seconds FROM cdr GROUP BY 1 ORDER BY avg(duration_seconds) DESC, contact LIMIT 10")
SV = f"sv AS (SELECT {DAY} AS day, call_type AS service FROM cdr UNION ALL SELECT {DAY}, upper(protocol) FROM ipdr)"
register(
    "D25_service_timeline", lambda t: s.service_timeline(t.cdr, t.ipdr),
    f", {SV}, dd AS (SELECT DISTINCT day FROM sv ORDER BY day DESC LIMIT 14), ss AS (SELECT service, count(*) AS c FROM sv GROUP BY 1 ORDER BY c DESC, service LIMIT 6) SELECT dd.day, ss.service, count(sv.day) AS n FROM dd CROSS JOIN ss LEFT JOIN sv ON sv.day=dd.day AND sv.service=ss.service GROUP BY 1,2",
)
register("D26_cumulative", lambda t: s.cumulative(t.cdr, t.ipdr), f"SELECT day, CAST(sum(cdr+ipdr) OVER (ORDER BY day) AS BIGINT) AS total FROM {DAILY}")
register("D27_directed_pairs", lambda t: s.directed_pairs(t.cdr), "SELECT a_party_number, b_party_number, count(*) AS n FROM cdr GROUP BY 1,2")
register("D28_subject_days", lambda t: s.subject_days(t.cdr, "a_party_number").withColumn("kind", F.lit("cdr")).union(s.subject_days(t.ipdr, "source_ip").withColumn("kind", F.lit("ipdr"))),
         f"SELECT a_party_number AS subject, {DAY} AS day, count(*) AS n, 'cdr' AS kind FROM cdr GROUP BY 1,2 UNION ALL SELECT source_ip, {DAY}, count(*), 'ipdr' FROM ipdr GROUP BY 1,2")
register("D29_subject_services", lambda t: s.subject_services(t.cdr), "SELECT a_party_number AS subject, count(*) FILTER (WHERE call_type='Voice') AS calls, count(*) FILTER (WHERE call_type='SMS') AS smss, CAST(0 AS BIGINT) AS datas FROM cdr GROUP BY 1")
register("D30_tower_activity", lambda t: s.tower_activity(t.cdr, t.ipdr, t.towers), "SELECT tower_id, (SELECT count(*) FROM cdr WHERE cdr.tower_id=tw.tower_id) AS cdr, (SELECT count(*) FROM ipdr WHERE ipdr.tower_id=tw.tower_id) AS ipdr FROM tw")
register("D31_tower_stats", lambda t: s.tower_stats(t.towers), "SELECT count(*) AS towers, count(latitude) AS placed, count(DISTINCT state) AS states, count(DISTINCT city) AS cities FROM tw")
register("D31_towers_by_state", lambda t: s.towers_by_state(t.towers), "SELECT coalesce(state,'Unknown') AS state, count(*) AS n FROM tw GROUP BY 1 ORDER BY n DESC, state LIMIT 40")
register("D32_case_counts", lambda t: s.case_counts(t.cdr, t.ipdr), "SELECT case_id, count(*) AS records FROM (SELECT case_id FROM cdr UNION ALL SELECT case_id FROM ipdr) GROUP BY 1")
register("D34_data_quality", lambda t: s.data_quality(t.cdr), "SELECT count(*) AS rows, round(greatest(0.0, 100-(5.0*count(*) FILTER (WHERE technology IS NULL)/count(*))),3) AS score FROM cdr")
A, B = ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20")
_in = lambda c, p: f"{c} IN (SELECT {c} FROM cdr WHERE {DAY} BETWEEN '{p[0]}' AND '{p[1]}')"
_n = lambda c, x, y: f"(SELECT count(DISTINCT {c}) FROM cdr WHERE {x} AND {y})"
_out = []
for _c, _name in (("b_party_number", "contacts"), ("a_party_number", "subjects"), ("tower_id", "towers")):
    ia, ib = _in(_c, A), _in(_c, B)
    _out += [f"{_n(_c, ia, ib)} AS shared_{_name}", f"{_n(_c, ib, 'NOT ' + ia)} AS new_{_name}", f"{_n(_c, ia, 'NOT ' + ib)} AS lost_{_name}"]
register(
    "D35_compare_periods", lambda t: s.compare_periods(t.cdr, A, B),
    f", n AS (SELECT count(*) FILTER (WHERE {DAY} BETWEEN '{A[0]}' AND '{A[1]}') AS rows_a, count(*) FILTER (WHERE {DAY} BETWEEN '{B[0]}' AND '{B[1]}') AS rows_b FROM cdr) SELECT rows_a, rows_b, {', '.join(_out)}, round(100.0*(rows_b-rows_a)/nullif(rows_a,0),2) AS change_pct FROM n",
)
