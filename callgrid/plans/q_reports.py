"""E: reports by subject."""

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import reports as r
from .catalog import register

DAY = "strftime(start_time,'%Y-%m-%d')"
TS = "strftime({},'%Y-%m-%d %H:%M:%S')"
INV = """, inv AS (SELECT cdr.*, a_party_number AS subject, b_party_number AS other, true AS owned FROM cdr UNION ALL SELECT cdr.*, b_party_number, a_party_number, false FROM cdr WHERE a_party_number<>b_party_number),
ses AS (SELECT ipdr.*, source_ip AS subject FROM ipdr UNION ALL SELECT ipdr.*, msisdn FROM ipdr) """


def _both(t):
    return r.involved(t.cdr)


register("E01_volume_by_day", lambda t: r.volume_by_day(_both(t)), INV + f"SELECT subject, {DAY} AS day, count(*) AS n FROM inv GROUP BY 1,2")
register("E02_hourly_pattern", lambda t: r.hourly_pattern(_both(t)), INV + "SELECT subject, hour(start_time) AS hour, count(*) AS n FROM inv GROUP BY 1,2")
register("E03_tower_footprint", lambda t: r.tower_footprint(r.owned(t.cdr)), INV + "SELECT a_party_number AS subject, tower_id, count(*) AS n FROM cdr GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, tower_id)<=20")
GAP = "lag(start_time) OVER (PARTITION BY subject ORDER BY start_time, id)"
register(
    "E04_off_periods", lambda t: r.off_periods(_both(t), 1),
    INV + f"SELECT subject, {TS.format('b')} AS before, {TS.format('start_time')} AS after, CAST(floor((epoch_us(start_time)-epoch_us(b))/1e6/86400) AS BIGINT) AS days FROM (SELECT subject, start_time, {GAP} AS b FROM inv) WHERE epoch_us(start_time)-epoch_us(b)>=86400000000",
)
register("E05_day_first_last", lambda t: r.day_first_last(_both(t)), INV + f"SELECT subject, {DAY} AS day, arg_min(other, (start_time, id)) AS first, arg_max(other, (start_time, id)) AS last, count(*) AS n FROM inv GROUP BY 1,2")
register("E06_single_days", lambda t: r.single_days(_both(t)), INV + f"SELECT subject, {DAY} AS day, min(other) AS other FROM inv GROUP BY 1,2 HAVING count(*)=1")
register(
    "E07_weekdays", lambda t: r.weekday_table(_both(t)),
    INV + "SELECT subject, CAST(dayofweek(start_time) AS VARCHAR) AS part, count(*) AS n FROM inv GROUP BY 1,2 UNION ALL SELECT subject, CASE WHEN dayofweek(start_time) IN (0,6) THEN 'weekend' ELSE 'weekdays' END, count(*) FROM inv GROUP BY 1,2",
)
register("E08_longest_calls", lambda t: r.longest_calls(_both(t)), INV + "SELECT subject, id, other, CAST(duration_seconds AS BIGINT) AS seconds FROM inv WHERE call_type<>'SMS' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY duration_seconds DESC, id)<=30")
PART = "CASE WHEN hour(start_time) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END"
register(
    "E09_day_night", lambda t: r.day_night(_both(t), r.owned(t.cdr)),
    INV + f", n AS (SELECT subject, {PART} AS part, count(*) AS n FROM inv GROUP BY 1,2), tt AS (SELECT a_party_number AS subject, {PART} AS part, tower_id AS tower, count(*) AS c FROM cdr GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY subject, part ORDER BY c DESC, tower)=1) SELECT n.subject, n.part, n.n, tower FROM n LEFT JOIN tt USING (subject, part)",
)
ISD = "isd(prefix,country) AS (VALUES " + ",".join(f"('{a}','{b}')" for a, b in dims.ISD) + ")"
# the adapter's numbers have ten digits: shorten some to make them look foreign
register(
    "E10_isd_calls", lambda t: r.isd_calls(_both(t).withColumn("other", F.when(F.col("id") % 6 == 0, F.substring("other", 1, 8)).otherwise(F.col("other"))), dims.isd(t.spark)),
    INV + f", {ISD}, far AS (SELECT subject, substr(other,1,8) AS other FROM inv WHERE id%6=0) SELECT subject, other, coalesce((SELECT country FROM isd WHERE starts_with(far.other,prefix) ORDER BY length(prefix) DESC LIMIT 1),'Unknown') AS country, count(*) AS n FROM far GROUP BY 1,2,3",
)
SER = "ser(series,operator,circle) AS (VALUES " + ",".join(f"('{a}','{b}','{c}')" for a, b, c in dims.SERIES) + ")"
_circle = lambda c: f"coalesce((SELECT circle FROM ser WHERE series=substr({c},1,5)),(SELECT circle FROM ser WHERE series=substr({c},1,4)))"
# odd rows get another series, so that circles differ
register(
    "E11_other_circle", lambda t: r.other_circle(_both(t).withColumn("other", F.when(F.col("id") % 4 == 0, F.concat(F.lit("9801"), F.substring("other", 5, 6))).otherwise(F.col("other"))), dims.series(t.spark)),
    INV + f", {SER}, x AS (SELECT subject, CASE WHEN id%4=0 THEN concat('9801',substr(other,5,6)) ELSE other END AS other FROM inv), y AS (SELECT subject, {_circle('subject')} AS own_circle, {_circle('other')} AS far_circle FROM x) SELECT subject, own_circle, far_circle, count(*) AS n FROM y WHERE own_circle<>far_circle GROUP BY 1,2,3",
)
TAC = "tac(tac,make,model) AS (VALUES " + ",".join(f"('{a}','{b}','{c}')" for a, b, c in dims.TAC) + ")"
DEV = f"min({{}}) AS x, {TS.format('min(start_time)')} AS first, {TS.format('max(start_time)')} AS last, count(*) AS n"
register(
    "E12_imei_summary", lambda t: r.device_summary(r.owned(t.cdr), "imei", dims.tac(t.spark)),
    INV + f", {TAC} SELECT g.*, make, model FROM (SELECT a_party_number AS subject, imei, {TS.format('min(start_time)')} AS first, {TS.format('max(start_time)')} AS last, count(*) AS n FROM cdr GROUP BY 1,2) g LEFT JOIN tac ON substr(imei,1,8)=tac.tac",
)
register("E13_imsi_summary", lambda t: r.device_summary(r.owned(t.cdr), "imsi"), INV + f"SELECT a_party_number AS subject, imsi, {TS.format('min(start_time)')} AS first, {TS.format('max(start_time)')} AS last, count(*) AS n FROM cdr GROUP BY 1,2")
register(
    "E14_bank_sms", lambda t: r.bank_sms(_both(t).withColumn("other", F.when(F.col("id") % 10 == 0, F.concat(F.lit("VM-BANK"), F.substring("other", 10, 1))).otherwise(F.col("other")))),
    INV + "SELECT subject, concat('VM-BANK',substr(other,10,1)) AS other, count(*) AS n FROM inv WHERE id%10=0 AND call_type='SMS' GROUP BY 1,2",
)
register("E17_traffic_by_day", lambda t: r.traffic_by_day(r.sessions_of(t.ipdr)), INV + f"SELECT subject, {DAY} AS day, count(*) AS sessions, round(sum(bytes_uploaded)/1048576,2) AS up_mb, round(sum(bytes_downloaded)/1048576,2) AS down_mb FROM ses GROUP BY 1,2")
register("E18_ipdr_hourly", lambda t: r.hourly_pattern(r.sessions_of(t.ipdr)), INV + "SELECT subject, hour(start_time) AS hour, count(*) AS n FROM ses GROUP BY 1,2")
register("E19_ipdr_towers", lambda t: r.tower_footprint(r.sessions_of(t.ipdr)), INV + "SELECT subject, tower_id, count(*) AS n FROM ses GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, tower_id)<=20")
register(
    "E20_off_dates", lambda t: r.off_dates(r.sessions_of(t.ipdr), 2),
    INV + "SELECT subject, CAST(b AS VARCHAR) AS before, CAST(d AS VARCHAR) AS after, CAST(d-b AS BIGINT) AS days FROM (SELECT subject, d, lag(d) OVER (PARTITION BY subject ORDER BY d) AS b FROM (SELECT DISTINCT subject, CAST(start_time AS DATE) AS d FROM ses)) WHERE d-b>=2",
)
register(
    "E21_breakdown", lambda t: r.breakdown(r.sessions_of(t.ipdr)),
    INV + " UNION ALL ".join(f"SELECT subject, '{c}' AS field, {c} AS value, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM ses s WHERE s.subject=ses.subject),1) AS pct FROM ses WHERE {c} IS NOT NULL GROUP BY subject, {c}" for c in ("protocol", "apn", "rat")),
)
register("E22_destinations", lambda t: r.destinations(t.ipdr), INV + "SELECT source_ip AS subject, destination_ip, count(*) AS n FROM ipdr GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, destination_ip)<=30")
register("E23_daily_throughput", lambda t: r.traffic_by_day(t.ipdr.withColumn("subject", F.col("source_ip"))), INV + f"SELECT source_ip AS subject, {DAY} AS day, count(*) AS sessions, round(sum(bytes_uploaded)/1048576,2) AS up_mb, round(sum(bytes_downloaded)/1048576,2) AS down_mb FROM ipdr GROUP BY 1,2")
register("E24_port_usage", lambda t: r.port_usage(r.sessions_of(t.ipdr)), INV + "SELECT subject, CAST(destination_port AS BIGINT) AS port, protocol, count(*) AS n FROM ses GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, port, protocol)<=30")
NIGHT = "hour(start_time) IN (23,0,1,2,3,4)"
register(
    "E26_subject_profile", lambda t: r.subject_profile(t.cdr, t.ipdr),
    INV + f""", g AS (SELECT subject, id, start_time, tower_id, b_party_number, (epoch_us(start_time)-epoch_us({GAP}))/1e6 AS gap FROM (SELECT *, a_party_number AS subject FROM cdr)),
 pk AS (SELECT subject, hour(start_time) AS peak_hour FROM g GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, peak_hour)=1),
 nt AS (SELECT subject, tower_id AS night_tower FROM g WHERE {NIGHT} GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, night_tower)=1),
 wt AS (SELECT subject, tower_id AS weekend_tower FROM g WHERE dayofweek(start_time) IN (0,6) GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, weekend_tower)=1)
 SELECT subject, count(DISTINCT b_party_number) AS contacts, count(*) AS records, count(DISTINCT tower_id) AS towers, count(DISTINCT {DAY}) AS days, round(count(*) FILTER (WHERE {NIGHT})/count(*),3) AS night_share,
 round(coalesce(max(gap),0)/86400,2) AS longest_gap_days, count(*) FILTER (WHERE gap>=259200) AS dormant, {TS.format('min(start_time)')} AS first, {TS.format('max(start_time)')} AS last, min(peak_hour) AS peak_hour, min(night_tower) AS night_tower, min(weekend_tower) AS weekend_tower,
 coalesce((SELECT count(*) FROM ipdr WHERE msisdn=subject),0) AS sessions, round(count(*)/count(DISTINCT {DAY}),2) AS per_day FROM g LEFT JOIN pk USING (subject) LEFT JOIN nt USING (subject) LEFT JOIN wt USING (subject) GROUP BY subject""",
)
register(
    "E28_subject_kind", lambda t: r.subject_kind(t.cdr, t.ipdr),
    INV + "SELECT case_id, subject, max(kind) AS kind FROM (SELECT case_id, a_party_number AS subject, 'phone' AS kind FROM cdr UNION SELECT case_id, b_party_number, 'phone' FROM cdr UNION SELECT case_id, source_ip, 'ip' FROM ipdr UNION SELECT case_id, destination_ip, 'ip' FROM ipdr) GROUP BY 1,2",
)
