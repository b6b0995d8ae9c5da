"""G and H: movement and co-presence."""

from pyspark.sql import functions as F

from ..operators import copresence as h
from ..operators import movement as m
from ..operators.compare import common  # noqa: F401
from .catalog import register

_A = "(pow(sin(radians({1}-{0})/2),2)+cos(radians({0}))*cos(radians({1}))*pow(sin(radians({3}-{2})/2),2))"
R = f"(CASE WHEN {_A} IS NOT NULL THEN 2*6371.0088*asin(sqrt(least(1.0,{_A}))) END)"  # least() passes over nulls
KM = R.format("plat", "latitude", "plon", "longitude")
ST = f""", st AS (SELECT id, msisdn AS subject, start_time, tower_id, imei, technology, latitude, longitude, epoch_us(start_time)/1e6 AS t FROM cdr JOIN tw USING (tower_id)),
 lg0 AS (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(t) OVER w AS pt, lag(tower_id) OVER w AS from_tower, lag(imei) OVER w AS from_imei FROM st WINDOW w AS (PARTITION BY subject ORDER BY start_time, id)),
 lg1 AS (SELECT *, {KM} AS km, (t-pt)/3600 AS hours FROM lg0), lg2 AS (SELECT *, CASE WHEN hours>0 THEN km/hours END AS kmh FROM lg1 WHERE km>=1),
 lg AS (SELECT *, CASE WHEN kmh IS NULL THEN true ELSE kmh>900 AND km>=5 END AS impossible, CASE WHEN kmh IS NULL THEN 'impossible' WHEN kmh<=3 THEN 'stationary' WHEN kmh<=12 THEN 'walking' WHEN kmh<=45 THEN 'urban' WHEN kmh<=120 THEN 'road' WHEN kmh<=250 THEN 'rail' WHEN kmh<=900 THEN 'air' ELSE 'impossible' END AS mode FROM lg2 WHERE kmh IS NOT NULL OR km>=5) """


def _stream(t):
    return m.streams(t.cdr, t.towers)


_r = lambda c, n=3: F.round(c, n).alias(c)
register("G01_streams", lambda t: _stream(t).select("id", "subject", "kind", "latitude", "longitude"), ST + "SELECT st.id, subject, CASE WHEN call_type='SMS' THEN 'sms' ELSE 'call' END AS kind, latitude, longitude FROM st JOIN cdr USING (id)")
register("G02_legs", lambda t: m.legs(_stream(t)).select("subject", "id", "from_tower", "tower_id", _r("km"), _r("kmh"), "impossible", "mode"), ST + "SELECT subject, id, from_tower, tower_id, round(km,3) AS km, round(kmh,3) AS kmh, impossible, mode FROM lg")
register("G03_impossible_travel", lambda t: m.first_impossible(_stream(t)).select("subject", "id", "from_imei", "imei", _r("km")), ST + "SELECT subject, id, from_imei, imei, round(km,3) AS km FROM lg WHERE impossible QUALIFY row_number() OVER (PARTITION BY subject ORDER BY start_time, id)=1")
_anchor = lambda cond, name: f"SELECT subject, tower_id, count(*) AS n, '{name}' AS anchor FROM st WHERE {cond} GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, tower_id)=1"
register(
    "G04_anchors", lambda t: m.anchors(_stream(t)).select("subject", "tower_id", "n", "anchor", "latitude"),
    ST + f"SELECT x.*, latitude FROM ({_anchor('hour(start_time)>=22 OR hour(start_time)<6', 'home')} UNION ALL {_anchor('hour(start_time) BETWEEN 9 AND 16 AND isodow(start_time)<=5', 'work')}) x JOIN tw USING (tower_id)",
)
register(
    "G05_profile", lambda t: m.profile(_stream(t)).withColumn("longest_km", F.round("longest_km", 3)),
    ST + "SELECT subject, towers, events, round(coalesce(longest_km,0),3) AS longest_km, " + ", ".join(f"coalesce({x},0) AS {x}" for x in ("walking", "urban", "road", "rail", "air", "impossible"))
    + " FROM (SELECT subject, count(DISTINCT tower_id) AS towers, count(*) AS events FROM st GROUP BY 1) LEFT JOIN (SELECT subject, max(km) AS longest_km, " + ", ".join(f"count(*) FILTER (WHERE mode='{x}') AS {x}" for x in ("walking", "urban", "road", "rail", "air", "impossible")) + " FROM lg GROUP BY 1) USING (subject)",
)
DW = ", dw AS (SELECT *, (lead(t) OVER (PARTITION BY subject ORDER BY start_time, id)-t)/3600 AS gap FROM st) SELECT subject, tower_id, round(sum(gap) FILTER (WHERE gap>0 AND gap<=24),3) AS hours, count(*) AS visits FROM dw GROUP BY 1,2 HAVING hours IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject ORDER BY round(sum(gap) FILTER (WHERE gap>0 AND gap<=24),6) DESC, tower_id)<=6"
register("G06_dwell", lambda t: m.dwell(_stream(t)).withColumn("hours", F.round("hours", 3)), ST + DW)
register("G07_mobility", lambda t: m.mobility(_stream(t)), ST + "SELECT subject, towers, CASE WHEN towers<=1 THEN 'stationary' WHEN towers<=3 AND km<25 THEN 'local' WHEN km>=100 OR towers>=8 THEN 'highly mobile' ELSE 'mobile' END AS mobility FROM (SELECT subject, count(DISTINCT tower_id) AS towers FROM st GROUP BY 1) LEFT JOIN (SELECT subject, max(km) AS km FROM lg GROUP BY 1) USING (subject)")
SHI = """, rn0 AS (SELECT *, lag(tower_id) OVER (PARTITION BY subject ORDER BY start_time, id) AS b FROM st), rn AS (SELECT * FROM rn0 WHERE b IS NULL OR b<>tower_id),
 sh AS (SELECT DISTINCT subject, shingle FROM (SELECT subject, tower_id||'>'||lead(tower_id) OVER w||'>'||lead(tower_id,2) OVER w AS shingle FROM rn WINDOW w AS (PARTITION BY subject ORDER BY start_time, id)) WHERE shingle IS NOT NULL),
 ra AS (SELECT * FROM sh WHERE shingle IN (SELECT shingle FROM sh GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30)) """
register("G08_shared_routes", lambda t: m.shared_routes(_stream(t), least=2), ST + SHI + "SELECT x.subject AS a, y.subject AS b, count(*) AS segments FROM ra x JOIN ra y USING (shingle) WHERE x.subject<y.subject GROUP BY 1,2 HAVING count(*)>=2 ORDER BY segments DESC, a, b LIMIT 15")
register("G09_call_legs", lambda t: m.legs(m.streams(t.cdr.withColumn("msisdn", F.col("a_party_number")), t.towers)).groupBy("subject", "mode").agg(F.count("*").alias("n")), ST + "SELECT subject, mode, count(*) AS n FROM lg GROUP BY 1,2")
register(
    "G10_stays", lambda t: m.stays(_stream(t)).select("subject", "tower_id", "n", "minutes"),
    ST + ", ch AS (SELECT *, CASE WHEN lag(tower_id) OVER (PARTITION BY subject ORDER BY start_time, id)=tower_id THEN 0 ELSE 1 END AS c FROM st), ru AS (SELECT *, sum(c) OVER (PARTITION BY subject ORDER BY start_time, id) AS run FROM ch) SELECT subject, tower_id, count(*) AS n, round((max(t)-min(t))/60,3) AS minutes FROM ru GROUP BY subject, run, tower_id HAVING count(*)>=2",
)
register(
    "G11_position_fixes", lambda t: m.position_fixes(_stream(t), 240),
    ST + ", ww AS (SELECT *, CASE technology WHEN '5G' THEN 1.0 WHEN '4G' THEN 1/9.0 WHEN '3G' THEN 1/25.0 WHEN '2G' THEN 1/225.0 ELSE 1/25.0 END AS w, CAST(floor(t/14400) AS BIGINT) AS slot FROM st) SELECT subject, slot, count(DISTINCT tower_id) AS towers, round(sum(w*latitude)/sum(w),6) AS latitude, round(sum(w*longitude)/sum(w),6) AS longitude FROM ww GROUP BY 1,2 HAVING count(DISTINCT tower_id)>=2",
)
register("G12_lcs_similarity", lambda t: m.lcs_similarity(_stream(t), m.route_pairs(_stream(t), least=1)))
register("G13_zones", lambda t: m.zones(_stream(t)), ST + "SELECT subject, tower_id, count(*) AS visits FROM st GROUP BY 1,2")

CO = ST + """, cp AS (SELECT CASE WHEN x.t<y.t OR (x.t=y.t AND x.id<y.id) THEN x.start_time ELSE y.start_time END AS first, least(x.subject,y.subject) AS a, greatest(x.subject,y.subject) AS b, CASE WHEN x.tower_id=y.tower_id THEN x.tower_id ELSE least(x.tower_id,y.tower_id)||'~'||greatest(x.tower_id,y.tower_id) END AS place
 FROM st x JOIN st y ON x.id<y.id AND x.subject<>y.subject AND abs(x.t-y.t)<=1200 AND (x.tower_id=y.tower_id OR """ + R.format("x.latitude", "y.latitude", "x.longitude", "y.longitude") + """<=1.5)),
 pr AS (SELECT a, b, count(*) AS occurrences, count(DISTINCT CAST(first AS DATE)) AS days, array_to_string(list_slice(list_sort(list_distinct(list(place))),1,8),',') AS places FROM cp GROUP BY 1,2) """  # fmt: skip
register("H01_co_presence", lambda t: h.co_presence(_stream(t)), CO + "SELECT * FROM pr")
register(
    "H02_convoys", lambda t: h.convoys(h.co_presence(_stream(t)), t.cdr).drop("places"),
    CO + ", cl AS (SELECT DISTINCT least(a_party_number,b_party_number) AS a, greatest(a_party_number,b_party_number) AS b, true AS c FROM cdr) SELECT a, b, occurrences, days, coalesce(c,false) AS ever_called, days>=2 AS convoy, days>=2 AND NOT coalesce(c,false) AS hidden_link FROM pr LEFT JOIN cl USING (a,b)",
)
ME = """, mt AS (SELECT x.case_id, x.tower_id, x.a_party_number AS subject_1, y.a_party_number AS subject_2, x.id AS id_1, y.id AS id_2, round((epoch_us(y.start_time)-epoch_us(x.start_time))/1e6/60,1) AS gap_min
 FROM cdr x JOIN cdr y ON x.case_id=y.case_id AND x.tower_id=y.tower_id AND x.a_party_number<>y.a_party_number AND (y.start_time>x.start_time OR (y.start_time=x.start_time AND y.id>x.id)) AND epoch_us(y.start_time)-epoch_us(x.start_time)<=3600000000),
 mm AS (SELECT *, CASE WHEN gap_min<5 THEN 'High' WHEN gap_min<15 THEN 'Medium' ELSE 'Low' END AS confidence FROM mt) """
register("H03_meetings", lambda t: h.meetings(t.cdr), ME + "SELECT * FROM mm")
register("H03_meeting_summary", lambda t: h.meeting_counts(t.cdr), ME + "SELECT count(*) AS total, count(DISTINCT (least(subject_1,subject_2), greatest(subject_1,subject_2))) AS pairs, count(*) FILTER (WHERE confidence='High') AS high, count(*) FILTER (WHERE confidence='Medium') AS medium, count(*) FILTER (WHERE confidence='Low') AS low FROM mm")
HM = "FROM (SELECT *, strftime(start_time,'%Y-%m-%d %H') AS slot FROM cdr) x JOIN (SELECT *, strftime(start_time,'%Y-%m-%d %H') AS slot FROM cdr) y USING (tower_id, slot) WHERE x.a_party_number<y.a_party_number"
register("H04_hour_meetings", lambda t: h.hour_meetings(t.cdr).select("tower_id", "slot", "s1", "s2", "id1", "id2"), f" SELECT tower_id, slot, x.a_party_number AS s1, y.a_party_number AS s2, x.id AS id1, y.id AS id2 {HM}")
register("H05_hour_pairs", lambda t: h.hour_meetings(t.cdr, False).select("tower_id", "slot", "s1", "s2"), f" SELECT DISTINCT tower_id, slot, x.a_party_number AS s1, y.a_party_number AS s2 {HM}")
register("H06_agent_meetings", lambda t: h.meetings(t.cdr).select("tower_id", "subject_1", "subject_2", "gap_min").orderBy("tower_id", "gap_min", "subject_1", "subject_2").limit(50), ME + "SELECT tower_id, subject_1, subject_2, gap_min FROM mm ORDER BY 1,4,2,3 LIMIT 50")
register("H07_colocation_counts", lambda t: h.colocation_counts(t.cdr), " SELECT least(x.a_party_number,y.a_party_number) AS a, greatest(x.a_party_number,y.a_party_number) AS b, tower_id, count(*) AS n FROM cdr x JOIN cdr y USING (tower_id) WHERE x.id<y.id AND x.a_party_number<>y.a_party_number AND abs(epoch_us(x.start_time)-epoch_us(y.start_time))<3600000000 GROUP BY 1,2,3")
