"""J, K and L: behaviour, identity, addresses."""

from pyspark.sql import functions as F

from ..operators import behaviour as b
from ..operators import movement as m
from ..operators.reports import owned
from .catalog import register
from .q_movement import ST

DAY = "strftime(start_time,'%Y-%m-%d')"
TS = "strftime({},'%Y-%m-%d %H:%M:%S')"
DC = f", dc AS (SELECT a_party_number AS subject, {DAY} AS day, count(*) AS n FROM cdr GROUP BY 1,2), mo AS (SELECT *, avg(n) OVER (PARTITION BY subject) AS mean, stddev_pop(n) OVER (PARTITION BY subject) AS sd, count(*) OVER (PARTITION BY subject) AS days FROM dc) "
register("J01_bursts", lambda t: b.bursts(owned(t.cdr)), DC + "SELECT subject, day, n, round(z,3) AS z FROM (SELECT *, (n-mean)/coalesce(nullif(sd,0),1) AS z FROM mo) WHERE days>=3 AND z>=2")
register("J02_odd_hours", lambda t: b.odd_hours(owned(t.cdr)), " SELECT *, round(odd/events,3) AS share FROM (SELECT a_party_number AS subject, count(*) FILTER (WHERE hour(start_time) BETWEEN 1 AND 4) AS odd, count(*) AS events FROM cdr GROUP BY 1) WHERE odd>=3 AND odd/events>=0.2")
_cad = lambda tab, k1, k2, n, h, cv: f"SELECT {k1}, {k2}, n, round(mean,3) AS mean_hours, round(sd/mean,3) AS cv FROM (SELECT {k1}, {k2}, count(*) AS n, (max(t)-min(t))/3600 AS span, avg(gap) AS mean, stddev_pop(gap) AS sd FROM (SELECT *, (t-lag(t) OVER (PARTITION BY {k1}, {k2} ORDER BY start_time, id))/3600 AS gap FROM (SELECT *, epoch_us(start_time)/1e6 AS t FROM {tab})) GROUP BY 1,2) WHERE n>={n} AND span>={h} AND mean>0 AND sd/mean<={cv}"
register("J03_periodic_contacts", lambda t: b.periodic_contacts(t.cdr), " " + _cad("cdr", "a_party_number", "b_party_number", 4, 12, 0.35))
register("J04_baseline", lambda t: b.baseline(owned(t.cdr)), DC + "SELECT subject, count(*) AS days, CAST(sum(n) AS BIGINT) AS events, CAST(max(CAST(day AS DATE))-min(CAST(day AS DATE)) AS BIGINT) AS span, round(avg(n),3) AS mean, round(stddev_pop(n),3) AS sd, arg_min(day, (-n, day)) AS peak_day FROM dc GROUP BY 1 HAVING sum(n)>=5 AND count(*)>=2")
register("J05_escalation", lambda t: b.escalation(owned(t.cdr), factor=1.5, level=2), DC + "SELECT subject, days, quantile_cont(n,0.5) FILTER (WHERE i<=days//2) AS early, quantile_cont(n,0.5) FILTER (WHERE i>days//2) AS late FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day) AS i FROM mo) WHERE days>=5 GROUP BY 1,2 HAVING late>=2 AND late>=1.5*early")
register(
    "J06_dormancy", lambda t: b.dormancy(owned(t.cdr), days=3),
    f", g AS (SELECT a_party_number AS subject, start_time, id, lag(start_time) OVER w AS b, row_number() OVER w AS i, count(*) OVER (PARTITION BY a_party_number) AS n FROM cdr WINDOW w AS (PARTITION BY a_party_number ORDER BY start_time, id)), h AS (SELECT *, CAST(floor((epoch_us(start_time)-epoch_us(b))/86400000000) AS BIGINT) AS days FROM g) SELECT subject, days, {TS.format('b')} AS last, {TS.format('start_time')} AS back, n-i+1 AS after FROM h WHERE n>=4 AND days>=3 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY days DESC, i)=1",
)
register("J07_first_contacts", lambda t: b.first_contacts(t.cdr), f" SELECT a, b, {TS.format('f')} AS first FROM (SELECT least(a_party_number,b_party_number) AS a, greatest(a_party_number,b_party_number) AS b, min(start_time) AS f FROM cdr WHERE a_party_number<>b_party_number GROUP BY 1,2) ORDER BY f DESC, a, b LIMIT 12")
register("J08_spikes", lambda t: b.spikes(owned(t.cdr), z=1.5, least=3), DC + "SELECT subject, day, n, round((n-mean)/sd,3) AS z, round(100*(n-mean)/mean,1) AS excess_pct FROM mo WHERE days>=5 AND n>=3 AND sd>0 AND (n-mean)/sd>1.5")
register("J09_service_bursts", lambda t: b.service_bursts(owned(t.cdr).withColumn("service", F.col("call_type")), factor=2), f", d AS (SELECT a_party_number AS subject, call_type AS service, {DAY} AS day, count(*) AS n FROM cdr GROUP BY 1,2,3) SELECT subject, service, day, n FROM (SELECT *, avg(n) OVER (PARTITION BY subject, service) AS mean, sum(n) OVER (PARTITION BY subject, service) AS total FROM d) WHERE total>=10 AND n>2*mean")

AGG = "string_agg(DISTINCT {0}, ',' ORDER BY {0})"
register("K01_device_anomalies", lambda t: b.device_anomalies(t.cdr), f" SELECT msisdn AS key, count(DISTINCT imei) AS n, {AGG.format('imei')} AS others, {AGG.format('imsi')} AS imsis, 'number' AS kind FROM cdr GROUP BY 1 HAVING count(DISTINCT imei)>1 UNION ALL SELECT imei, count(DISTINCT msisdn), {AGG.format('msisdn')}, NULL, 'handset' FROM cdr GROUP BY 1 HAVING count(DISTINCT msisdn)>1")
register("K02_clone_corroboration", lambda t: b.clone_corroboration(m.legs(m.streams(t.cdr, t.towers)), t.cdr), ST + "SELECT subject, legs, coalesce(h,1) AS handsets, coalesce(h,1)>1 AS cloned FROM (SELECT subject, count(*) AS legs FROM lg WHERE impossible GROUP BY 1) LEFT JOIN (SELECT msisdn AS subject, count(DISTINCT imei) AS h FROM cdr GROUP BY 1 HAVING count(DISTINCT imei)>1) USING (subject)")
RUN = """, r0 AS (SELECT *, a_party_number AS subject, CASE WHEN row_number() OVER w=1 THEN 1 WHEN lag(imei) OVER w IS NOT DISTINCT FROM imei AND lag(imsi) OVER w IS NOT DISTINCT FROM imsi THEN 0 ELSE 1 END AS c FROM cdr WINDOW w AS (PARTITION BY a_party_number ORDER BY start_time, id)),
 r1 AS (SELECT *, CAST(sum(c) OVER (PARTITION BY subject ORDER BY start_time, id) AS BIGINT) AS run FROM r0), sts AS (SELECT subject, run, min(imei) AS imei, min(imsi) AS imsi, count(*) AS n, min(start_time) AS f, max(start_time) AS l FROM r1 GROUP BY 1,2),
 tr AS (SELECT subject, run, CASE WHEN imei<>i0 AND imsi<>s0 THEN 'combined' WHEN imsi<>s0 THEN 'sim_swap' WHEN imei<>i0 THEN 'device_change' ELSE 'same' END AS kind FROM (SELECT *, lag(imei) OVER w AS i0, lag(imsi) OVER w AS s0 FROM sts WINDOW w AS (PARTITION BY subject ORDER BY run)) WHERE i0 IS NOT NULL) """
register("K03_identity_states", lambda t: b.identity_states(owned(t.cdr)).select("subject", "run", "imei", "imsi", "n"), RUN + "SELECT subject, run, imei, imsi, n FROM sts")
register("K04_transitions", lambda t: b.transitions(b.identity_states(owned(t.cdr))), RUN + "SELECT *, CAST(CASE kind WHEN 'combined' THEN 60 WHEN 'sim_swap' THEN 85 WHEN 'device_change' THEN 80 ELSE 0 END AS BIGINT) AS confidence FROM tr")
register(
    "K05_identity_report", lambda t: b.identity_report(owned(t.cdr)),
    RUN + ", n AS (SELECT a_party_number AS subject, count(*) AS rows, count(DISTINCT (imei, imsi)) AS pairs FROM cdr GROUP BY 1), c AS (SELECT subject, count(*) FILTER (WHERE kind='sim_swap') AS swaps, count(*) FILTER (WHERE kind='device_change') AS devices, count(*) FILTER (WHERE kind='combined') AS both FROM tr GROUP BY 1), z AS (SELECT n.*, coalesce(swaps,0) AS swaps, coalesce(devices,0) AS devices, coalesce(both,0) AS both, CASE WHEN rows>5 THEN CAST(floor(100*pairs/rows) AS BIGINT) ELSE 0 END AS burner FROM n LEFT JOIN c USING (subject)) SELECT *, burner>30 OR swaps+devices+both>0 AS suspected FROM z".replace("AS both", 'AS "both"').replace("(both,", '("both",').replace("+both>", '+"both">'),
)
register(
    "K07_deep_identity", lambda t: b.deep_identity(owned(t.cdr)),
    RUN + """, dv AS (SELECT * FROM (SELECT *, lag(imei) OVER (PARTITION BY subject ORDER BY run) AS b FROM sts) WHERE b IS NULL OR b<>imei), bk AS (SELECT *, lag(imei,1) OVER w AS x1, lag(imei,2) OVER w AS x2 FROM dv WINDOW w AS (PARTITION BY subject ORDER BY run)),
 g AS (SELECT subject, count(*) AS steps, count(*) FILTER (WHERE imei=x2 AND imei<>x1) AS returns FROM bk GROUP BY 1), n AS (SELECT a_party_number AS subject, count(*) AS rows, count(DISTINCT (imei,imsi)) AS pairs, count(DISTINCT imei) AS imeis, count(DISTINCT imsi) AS imsis FROM cdr GROUP BY 1),
 y AS (SELECT n.*, steps, CASE WHEN steps-1>=3 THEN CAST(least(100,floor(200*returns/steps)) AS BIGINT) ELSE 0 END AS cycling FROM n JOIN g USING (subject)), z AS (SELECT *, CAST(floor(40*pairs/rows+20*least(imeis,10)/10+20*least(imsis,10)/10+20*cycling/100) AS BIGINT) AS burner FROM y) SELECT subject, rows, pairs, imeis, imsis, cycling, burner, burner>25 OR steps-1>2 AS suspected FROM z""",
)

register(
    "L01_tunnel_use", lambda t: b.tunnel_use(t.ipdr),
    f" SELECT source_ip AS subject, count(*) FILTER (WHERE destination_port IN {tuple(b.VPN_PORTS)}) AS vpn, count(*) FILTER (WHERE destination_port IN {tuple(b.PROXY_PORTS)}) AS proxy, array_to_string(list_sort(list_distinct(list(destination_port))),',') AS ports, array_to_string(list_slice(list_sort(list_distinct(list(destination_ip))),1,6),',') AS servers FROM ipdr WHERE destination_port IN {tuple(b.VPN_PORTS + b.PROXY_PORTS)} GROUP BY 1",
)
register("L02_traffic_volume", lambda t: b.traffic_volume(t.ipdr, mib=1, ratio=1.5), " SELECT *, up>=1048576 AND (down=0 OR up>=1.5*down) AS exfil FROM (SELECT source_ip AS subject, CAST(sum(bytes_uploaded) AS BIGINT) AS up, CAST(sum(bytes_downloaded) AS BIGINT) AS down, count(*) AS sessions FROM ipdr GROUP BY 1) ORDER BY up DESC, subject LIMIT 15")
register(
    "L03_beacons", lambda t: b.beacons(t.ipdr, cv=0.5),
    f", cd AS ({_cad('ipdr', 'source_ip', 'destination_ip', 4, 6, 0.5)}), po AS (SELECT source_ip, destination_ip, CAST(arg_max(destination_port, (start_time, id)) AS BIGINT) AS port FROM ipdr GROUP BY 1,2) SELECT cd.*, port, port NOT IN (80,443) AS non_web FROM cd JOIN po USING (source_ip, destination_ip) ORDER BY cv, source_ip, destination_ip LIMIT 15",
)
register("L04_rare_destinations", lambda t: b.rare_destinations(t.ipdr), ", p AS (SELECT source_ip AS subject, destination_ip, count(*) AS n FROM ipdr GROUP BY 1,2), f AS (SELECT destination_ip, count(*) AS sources FROM p GROUP BY 1 HAVING count(*)<=2) SELECT subject, destination_ip, n, sources FROM p JOIN f USING (destination_ip) WHERE n>=3 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, destination_ip)<=5")
