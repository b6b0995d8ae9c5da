"""P and A15: subject-keyed analytics."""

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import modules as p
from ..operators import movement as m
from ..operators.reports import owned
from .catalog import register
from .q_behaviour import TS
from .q_movement import R, ST
from .q_reports import INV



def _few(cdr):
    """The adapter's contacts never call back: numbers by their last digit do."""
    return cdr.withColumn("a_party_number", F.substring("a_party_number", 10, 1)).withColumn("b_party_number", F.substring("b_party_number", 10, 1))


D = "coalesce(duration_seconds,0)"
register("P01_communication", lambda t: p.communication(t.cdr), INV + f"SELECT subject, count(*) AS calls, count(*) FILTER (WHERE owned) AS outgoing, count(*) FILTER (WHERE NOT owned) AS incoming, CAST(sum({D}) AS BIGINT) AS seconds, round(avg({D}),2) AS avg_seconds, count(DISTINCT other) AS contacts, count(*) FILTER (WHERE {D}>0 AND {D}<5) AS very_short, count(*) FILTER (WHERE {D}>3600) AS very_long FROM inv GROUP BY 1")
register("P01_pattern_contacts", lambda t: p.pattern_contacts(t.cdr), INV + "SELECT subject, other, count(*) AS n FROM inv GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, other)<=10")
register(
    "P02_response_times", lambda t: p.response_times(_few(t.cdr)),
    INV.replace("a_party_number", "substr(a_party_number,10)").replace("b_party_number", "substr(b_party_number,10)") + ", r AS (SELECT subject, other, owned, epoch_us(start_time)/1e6 AS t, lag(owned) OVER w AS before, lag(epoch_us(start_time)/1e6) OVER w AS t0 FROM inv WHERE subject<>other WINDOW w AS (PARTITION BY subject, other ORDER BY start_time, id)), a AS (SELECT subject, t-t0 AS s FROM r WHERE owned AND before=false AND t-t0<=86400) SELECT subject, count(*) AS answers, round(avg(s)/60,2) AS avg_min, round(quantile_cont(s,0.5)/60,2) AS median_min, count(*) FILTER (WHERE s<60) AS under_minute, count(*) FILTER (WHERE s>3600) AS over_hour FROM a GROUP BY 1",
)
_pct = lambda c: f"round(100.0*count(*) FILTER (WHERE {c})/count(*),1)"
H = "hour(start_time)"
register(
    "P03_time_profile", lambda t: p.time_profile(owned(t.cdr)),
    f", g AS (SELECT a_party_number AS subject, count(*) AS n, {_pct(f'{H} BETWEEN 6 AND 11')} AS morning, {_pct(f'{H} BETWEEN 12 AND 17')} AS afternoon, {_pct(f'{H} BETWEEN 18 AND 21')} AS evening, {_pct(f'{H}>=22 OR {H}<6')} AS night FROM cdr GROUP BY 1), pk AS (SELECT a_party_number AS subject, {H} AS peak_hour FROM cdr GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, peak_hour)=1) SELECT g.*, peak_hour, CASE greatest(morning,afternoon,evening,night) WHEN night THEN 'night' WHEN evening THEN 'evening' WHEN afternoon THEN 'afternoon' ELSE 'morning' END AS profile, night>40 AS night_owl FROM g JOIN pk USING (subject)",
)
RN = ", rn AS (SELECT *, a_party_number AS subject, epoch_us(start_time)/1e6 AS t, row_number() OVER (PARTITION BY a_party_number ORDER BY start_time, id) AS i, count(*) OVER (PARTITION BY a_party_number) AS n FROM cdr) "
_rate = lambda c: f"count(*) FILTER (WHERE {c})/greatest(1.0,(max(t) FILTER (WHERE {c})-min(t) FILTER (WHERE {c}))/86400)"
register("P04_trend", lambda t: p.trend(owned(t.cdr)), RN + f"SELECT subject, round(a,3) AS early, round(b,3) AS later, CASE WHEN b>a*1.2 THEN 'increasing' WHEN b<a*0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM (SELECT subject, {_rate('i<=n//2')} AS a, {_rate('i>n//2')} AS b FROM rn WHERE n>=10 GROUP BY 1)")


def _stream(t):
    return m.streams(t.cdr, t.towers)


register("P05_frequent_places", lambda t: p.frequent_places(_stream(t)), ST + "SELECT subject, tower_id, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (PARTITION BY subject),1) AS pct FROM st GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, tower_id)<=10")
register("P06_corridors", lambda t: p.corridors(_stream(t)), ST + "SELECT subject, from_tower AS src, tower_id AS dst, count(*) AS n FROM lg0 WHERE from_tower<>tower_id GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, src, dst)<=10")
register("P07_radius", lambda t: p.radius(_stream(t)), ST + ", d AS (SELECT DISTINCT subject, tower_id, latitude, longitude FROM st) SELECT x.subject, round(max(" + R.replace("6371.0088", "6371.0").format("x.latitude", "y.latitude", "x.longitude", "y.longitude") + "),3) AS km FROM d x JOIN d y ON x.subject=y.subject AND x.tower_id<y.tower_id GROUP BY 1")
register("P08_predictability", lambda t: p.predictability(_stream(t)), ST + ", g AS (SELECT subject, count(*)/sum(count(*)) OVER (PARTITION BY subject) AS p FROM st GROUP BY subject, tower_id), en AS (SELECT subject, round(-sum(p*log2(p)),6) AS entropy FROM g GROUP BY 1) SELECT *, CASE WHEN entropy<2 THEN 'High' WHEN entropy<4 THEN 'Medium' ELSE 'Low' END AS label FROM en")
register("P09_hotspots", lambda t: p.hotspots(_stream(t)), ST + "SELECT tower_id, count(*) AS visits, count(DISTINCT subject) AS subjects FROM st GROUP BY 1 ORDER BY visits DESC, tower_id LIMIT 20")
NI = "CASE WHEN hour(start_time)>=22 OR hour(start_time)<6 THEN 1 ELSE 0 END"
register(
    "P10_shifts", lambda t: p.shifts(owned(t.cdr)),
    RN + f", z AS (SELECT *, i>floor(n*0.6) AS new FROM rn WHERE n>=10), s AS (SELECT subject, b_party_number, max(new) AS in_new, max(NOT new) AS in_old FROM z GROUP BY 1,2), c AS (SELECT subject, count(*) FILTER (WHERE in_new AND NOT in_old) AS gained, count(*) FILTER (WHERE NOT in_new) AS dropped FROM s GROUP BY 1) SELECT z.subject, round(avg({NI}) FILTER (WHERE new)-avg({NI}) FILTER (WHERE NOT new),3) AS night_shift, round(avg(duration_seconds) FILTER (WHERE NOT new),2) AS seconds_before, round(avg(duration_seconds) FILTER (WHERE new),2) AS seconds_after, min(gained) AS gained, min(dropped) AS dropped FROM z JOIN c USING (subject) GROUP BY 1",
)
GP = ", gp AS (SELECT a_party_number AS subject, (epoch_us(start_time)-epoch_us(lag(start_time) OVER (PARTITION BY a_party_number ORDER BY start_time, id)))/1e6/3600 AS h FROM cdr) "
register("P11_silences", lambda t: p.silences(owned(t.cdr)), GP + "SELECT subject, count(*) AS gaps, count(*) FILTER (WHERE h>24) AS over_day, count(*) FILTER (WHERE h>168) AS over_week, round(max(h),3) AS longest, round(avg(h),3) AS average, round(sum(h),3) AS total FROM gp WHERE h>=2 GROUP BY 1")
register("P12_call_details", lambda t: p.call_details(owned(t.cdr)), ", x AS (SELECT *, coalesce(lag(b_party_number) OVER w=b_party_number AND epoch_us(start_time)-epoch_us(lag(start_time) OVER w)<300000000,false) AS again FROM cdr WINDOW w AS (PARTITION BY a_party_number ORDER BY start_time, id)) SELECT a_party_number AS subject, count(*) FILTER (WHERE duration_seconds>0 AND duration_seconds<5) AS short, count(*) FILTER (WHERE duration_seconds>3600) AS long, count(*) FILTER (WHERE hour(start_time)<5) AS small_hours, count(*) FILTER (WHERE again) AS repeats FROM x GROUP BY 1")
register("P13_call_bursts", lambda t: p.call_bursts(owned(t.cdr), 21600, 3), ", u AS (SELECT a_party_number AS subject, epoch_us(start_time) AS us, b_party_number AS b FROM cdr), b AS (SELECT x.subject, x.us AS first, max(y.us) AS last, count(*) AS n, count(DISTINCT y.b) AS contacts FROM u x JOIN u y ON x.subject=y.subject AND y.us>=x.us AND y.us<x.us+21600000000 GROUP BY 1,2) SELECT DISTINCT * FROM b WHERE n>=3")
_per_hour = lambda c: f"count(*) FILTER (WHERE {c})/greatest((max(t) FILTER (WHERE {c})-min(t) FILTER (WHERE {c}))/3600,1.0)"
_avg = lambda x: f"avg({x}) FILTER (WHERE new) AS {x}1, avg({x}) FILTER (WHERE NOT new) AS {x}0"
SHIFTED = RN + f""", z AS (SELECT *, i>floor(n*0.6) AS new, {D} AS d, {NI} AS ni FROM rn WHERE n>=10),
 s AS (SELECT subject, b_party_number, bool_or(new) AS late, bool_or(NOT new) AS early FROM z WHERE b_party_number IS NOT NULL GROUP BY 1,2),
 c AS (SELECT subject, count(*) FILTER (WHERE late AND NOT early) AS gained, count(*) FILTER (WHERE NOT late) AS dropped, count(*) FILTER (WHERE late) AS recent FROM s GROUP BY 1),
 r AS (SELECT subject, {_per_hour('new')} AS r1, {_per_hour('NOT new')} AS r0, {_avg('ni')}, {_avg('d')}, count(*) FILTER (WHERE new) AS n1, count(*) FILTER (WHERE NOT new) AS n0 FROM z GROUP BY 1),
 m AS (SELECT r.*, gained, dropped, recent, round((r1/greatest(r0,0.001)-1)*100,1) AS activity, ni1-ni0 AS night, (d1/greatest(d0,0.001)-1)*100 AS duration FROM r LEFT JOIN c USING (subject)) """
register("P10_shift_marks", lambda t: ev.shift_marks(owned(t.cdr)), SHIFTED + """SELECT subject, 'Activity Level Change' AS type, round(CAST(activity AS DOUBLE),3) AS value, CASE WHEN abs(activity)>200 THEN 'High' ELSE 'Medium' END AS severity FROM m WHERE abs(activity)>75
 UNION ALL SELECT subject, 'New Contact Surge', gained, CASE WHEN gained>=10 AND gained>=0.5*greatest(recent,1) THEN 'High' ELSE 'Medium' END FROM m WHERE gained>=5
 UNION ALL SELECT subject, 'Contact Drop-off', dropped, 'Medium' FROM m WHERE dropped>=3
 UNION ALL SELECT subject, 'Time-of-Day Pattern Shift', round(night,3), 'Medium' FROM m WHERE n0>=5 AND n1>=5 AND abs(night)>0.2
 UNION ALL SELECT subject, 'Call Duration Shift', round(duration,3), 'Low' FROM m WHERE abs(duration)>80""")
FIRST = ", g0 AS (SELECT a_party_number AS subject, id, start_time, epoch_us(start_time)-epoch_us(lag(start_time) OVER w) AS us, lag(b_party_number) OVER w AS before, b_party_number AS after FROM cdr WINDOW w AS (PARTITION BY a_party_number ORDER BY start_time, id)) "
register("P11_first_gaps", lambda t: ev.first_gaps(owned(t.cdr)), FIRST + "SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY start_time, id) AS i, round(us/60e6,1) AS minutes, before, after FROM g0 WHERE us>=7200000000 QUALIFY i<=10")
GAPS = GP + ", gs AS (SELECT subject, count(*) AS gaps, round(max(h),3) AS longest FROM gp WHERE h>=2 GROUP BY 1) SELECT subject, gaps, longest, CASE WHEN round(longest,1)>720 THEN 'away' ELSE 'quiet' END AS kind, CASE WHEN round(longest,1)>720 THEN 'High' ELSE 'Medium' END AS severity FROM gs WHERE round(longest,1)>168 UNION ALL SELECT subject, gaps, longest, 'frequent', 'Medium' FROM gs WHERE gaps>10"
register("P11_gap_findings", lambda t: ev.gap_marks(p.silences(owned(t.cdr))), GAPS)
CALLS = """, cd AS (SELECT a_party_number AS subject, count(*) FILTER (WHERE duration_seconds>0 AND duration_seconds<5) AS short, count(*) FILTER (WHERE hour(start_time)<5) AS odd FROM cdr GROUP BY 1), u AS (SELECT a_party_number AS subject, epoch_us(start_time) AS us FROM cdr),
 w5 AS (SELECT subject, us, count(*) OVER w AS n, max(us) OVER w AS last FROM u WINDOW w AS (PARTITION BY subject ORDER BY us RANGE BETWEEN CURRENT ROW AND 599999999 FOLLOWING)), bu AS (SELECT subject, count(*) AS n FROM (SELECT DISTINCT subject, us, last, n FROM w5 WHERE n>=5) GROUP BY 1)
 SELECT subject, 'short' AS kind, short AS n FROM cd WHERE short>3 UNION ALL SELECT subject, 'odd_hours', odd FROM cd WHERE odd>3 UNION ALL SELECT subject, 'bursts', n FROM bu"""
register("P12_call_findings", lambda t: ev.call_marks(p.call_details(owned(t.cdr)), p.call_bursts(owned(t.cdr))), CALLS)
register("P14_dominance", lambda t: p.dominance(t.cdr), INV + "SELECT *, CASE WHEN ratio>0.6 THEN 'leader' WHEN ratio<0.4 THEN 'follower' ELSE 'peer' END AS role FROM (SELECT subject, count(*) FILTER (WHERE owned) AS made, count(*) FILTER (WHERE NOT owned) AS received, round(count(*) FILTER (WHERE owned)/count(*),3) AS ratio FROM inv GROUP BY 1)")
register("P15_fan_out", lambda t: p.fan_out(t.cdr), " SELECT *, CASE WHEN contacts>=20 THEN 'wide' WHEN contacts>=10 THEN 'medium' ELSE 'narrow' END AS breadth FROM (SELECT a_party_number AS subject, count(DISTINCT b_party_number) AS contacts FROM cdr GROUP BY 1) WHERE contacts>=5")
register("P16_check_ins", lambda t: p.check_ins(t.cdr, 3), " SELECT a_party_number, b_party_number, n, round(mean,3) AS mean_hours, CASE WHEN mean BETWEEN 20 AND 28 THEN 'daily' ELSE 'weekly' END AS kind FROM (SELECT a_party_number, b_party_number, count(*) AS n, (epoch_us(max(start_time))-epoch_us(min(start_time)))/1e6/3600/(count(*)-1) AS mean FROM cdr GROUP BY 1,2 HAVING count(*)>=3) WHERE mean BETWEEN 20 AND 28 OR mean BETWEEN 160 AND 176")
SC = ", ec AS (SELECT DISTINCT a_party_number AS s, b_party_number AS c FROM cdr WHERE a_party_number<>b_party_number), d AS (SELECT s, count(*) AS d FROM ec GROUP BY 1), sc AS (SELECT x.s AS a, y.s AS b, count(*) AS shared, round(count(*)/(min(p.d)+min(q.d)-count(*)),6) AS jaccard FROM ec x JOIN ec y ON x.c=y.c AND x.s<y.s JOIN d p ON p.s=x.s JOIN d q ON q.s=y.s GROUP BY 1,2 HAVING count(*)>=2) "
register("P17_shared_contacts", lambda t: p.shared_contacts(t.cdr), SC + "SELECT * FROM sc ORDER BY shared DESC, jaccard DESC, a, b LIMIT 20")
register("P22_silent_partners", lambda t: p.silent_partners(t.cdr), SC + "SELECT * FROM sc WHERE (a,b) NOT IN (SELECT (least(a_party_number,b_party_number), greatest(a_party_number,b_party_number)) FROM cdr) ORDER BY shared DESC, jaccard DESC, a, b LIMIT 20")
register("P22_first_seen_services", lambda t: p.first_seen(owned(t.cdr)), f" SELECT a_party_number AS subject, call_type, {TS.format('min(start_time)')} AS first FROM cdr GROUP BY 1,2")
register(
    "A15_training_rows", lambda t: p.training_rows(t.cdr),
    ", tc AS (SELECT subject, string_agg(b, ',' ORDER BY c DESC, b) AS top_contacts FROM (SELECT a_party_number AS subject, b_party_number AS b, count(*) AS c FROM cdr GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY c DESC, b)<=5) GROUP BY 1) SELECT a_party_number AS subject, count(*) AS calls, count(DISTINCT b_party_number) AS contacts, count(DISTINCT tower_id) AS towers, round(count(*) FILTER (WHERE hour(start_time)>=23 OR hour(start_time)<5)/count(*),3) AS night_share, min(top_contacts) AS top_contacts FROM cdr JOIN tc ON tc.subject=a_party_number GROUP BY 1",
)
register("P21_leads", lambda t: p.leads(t.cdr))
_TOP = "(SELECT a_party_number AS subject, tower_id, count(*) AS n, {0} AS part FROM cdr GROUP BY 1,2,4)"
_PART = "CASE WHEN hour(start_time)>=19 OR hour(start_time)<8 THEN 'home' WHEN hour(start_time) BETWEEN 9 AND 17 THEN 'work' END"
register(
    "P18_home_and_work", lambda t: p.home_and_work(owned(t.cdr)),
    f", hw AS {_TOP.format(_PART)} SELECT subject, coalesce(arg_min(tower_id, (-n, tower_id)) FILTER (WHERE part='home'), 'Unknown') AS home, coalesce(arg_min(tower_id, (-n, tower_id)) FILTER (WHERE part='work'), 'Unknown') AS work, count(DISTINCT tower_id) AS towers, CASE WHEN count(DISTINCT tower_id)>4 THEN 'High' ELSE 'Low' END AS mobility FROM hw GROUP BY 1",
)
