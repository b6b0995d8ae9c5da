"""M and N: attribution, sessions, timelines."""

from pyspark.sql import functions as F

from ..functions import services as s
from ..operators import attribution as a
from ..operators import traffic as w
from ..operators.reports import owned
from .catalog import register

IPN = "(CAST(split_part({0},'.',1) AS BIGINT)*16777216+CAST(split_part({0},'.',2) AS BIGINT)*65536+CAST(split_part({0},'.',3) AS BIGINT)*256+CAST(split_part({0},'.',4) AS BIGINT))"


def _values(rows) -> str:
    """Rows as SQL VALUES."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "[" + ",".join(map(str, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ",".join("(" + ",".join(map(text, r)) + ")" for r in rows)


_nets = [(c, p, isp) for p, isp, every in s.NETWORKS for c in every.split()]
NW = f", nw0(ord,cidr,provider,is_isp,hosting) AS ({_values([(i, c, p, isp, p in s.HOSTING) for i, (c, p, isp) in enumerate(_nets)])}), nw AS (SELECT *, CAST(split_part(cidr,'/',2) AS INT) AS plen, {IPN.format("split_part(cidr,'/',1)")} AS lo FROM nw0)"
PV = NW + f", ips AS (SELECT ip, {IPN.format('ip')} AS n FROM (SELECT destination_ip AS ip FROM ipdr UNION SELECT source_ip FROM ipdr)), pv AS (SELECT ip, provider, is_isp, hosting, cidr, plen FROM ips JOIN nw ON n>=lo AND n<lo+CAST(pow(2,32-plen) AS BIGINT) QUALIFY row_number() OVER (PARTITION BY ip ORDER BY plen DESC, ord)=1)"
_low = lambda c: sum(int(x) << (24 - 8 * i) for i, x in enumerate(c.split("/")[0].split(".")))
KIND = "CASE " + " ".join(f"WHEN n BETWEEN {_low(c)} AND {_low(c) + 2 ** (32 - int(c.split('/')[1])) - 1} THEN '{k}'" for k, c in s.SPECIAL) + " END"
BP = f""", pt(port,service,family) AS ({_values([(n, "Likely " + x, f) for f, x, every in s.PORTS for n in s.numbers(every)])}), rg(ord,lo,hi,service,family) AS ({_values([(i, a, b, "Likely " + x, f) for i, (a, b, x, f) in enumerate(s.RANGES)])}),
 ru(ord,family,proto,ports,more,fewer,subtype,confidence) AS ({_values([(i, *r[:7]) for i, r in enumerate(s.RULES)])}), al(proto,port,bonus) AS ({_values([(p, n, x) for p, every, x in s.ALIGNED for n in every])}), fb(ord,proto,more,service,subtype,confidence) AS ({_values([(i, *r) for i, r in enumerate(s.FALLBACK)])}),
 b0 AS (SELECT *, upper(coalesce(protocol,'')) AS proto, coalesce(bytes_uploaded,0)+coalesce(bytes_downloaded,0) AS size FROM ipdr),
 ca0 AS (SELECT id, 0 AS side, destination_port AS port, proto, size FROM b0 UNION ALL SELECT id, 1, source_port, proto, size FROM b0),
 ca1 AS (SELECT ca0.*, coalesce(pt.service, rg.service) AS service, coalesce(pt.family, rg.family) AS family FROM ca0 LEFT JOIN pt USING (port) LEFT JOIN rg ON ca0.port BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY rg.ord)=1),
 ca2 AS (SELECT ca1.*, ru.subtype, ru.confidence AS base FROM ca1 JOIN ru ON ru.family=ca1.family AND (more IS NULL OR size>more) AND (fewer IS NULL OR size<fewer)
  AND CASE WHEN ru.proto IS NULL THEN ports IS NULL OR list_contains(ports, port) WHEN ru.family='WhatsApp' THEN ru.proto=ca1.proto AND list_contains(ports, port) ELSE ru.proto=ca1.proto OR list_contains(ports, port) END
  QUALIFY row_number() OVER (PARTITION BY id, side ORDER BY ru.ord)=1),
 ca3 AS (SELECT ca2.*, CASE WHEN bonus IS NULL THEN base ELSE least({s.MOST_SURE}, base+bonus) END AS conf, side=1 AND ca2.port>={s.EPHEMERAL} AS late FROM ca2 LEFT JOIN al ON al.proto=ca2.proto AND al.port=ca2.port),
 ca4 AS (SELECT *, CASE WHEN late THEN greatest(10, conf-25) ELSE conf END AS c FROM ca3 x WHERE NOT (side=1 AND EXISTS (SELECT 1 FROM ca3 y WHERE y.id=x.id AND y.side=0 AND (late OR y.family=x.family)))),
 ca5 AS (SELECT * FROM ca4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, port)=1),
 fb1 AS (SELECT b0.*, fb.service AS fs, coalesce(fb.subtype, 'Protocol '||b0.proto||' session') AS ft, fb.confidence AS fc FROM b0 JOIN fb ON (fb.proto IS NULL OR fb.proto=b0.proto) AND (more IS NULL OR size>more) QUALIFY row_number() OVER (PARTITION BY id ORDER BY fb.ord)=1),
 fb2 AS (SELECT fb1.* EXCLUDE (fs, ft, fc), CASE WHEN probe THEN '{s.PROBE[0]}' ELSE fs END AS fs, CASE WHEN probe THEN '{s.PROBE[1]}' ELSE ft END AS ft, CASE WHEN probe THEN {s.PROBE[2]} ELSE fc END AS fc FROM (SELECT *, size=0 AND coalesce(nullif(destination_port,0), nullif(source_port,0), 0)<>0 AND fc<{s.PROBE[2]} AS probe FROM fb1) fb1),
 bp AS (SELECT fb2.* EXCLUDE (fs, ft, fc), coalesce(ca5.service, fs) AS ps, coalesce(ca5.subtype, ft) AS pt, coalesce(ca5.family, fs) AS pf, CAST(coalesce(ca5.c, fc) AS BIGINT) AS pc, ca5.port AS pp,
  CASE WHEN ca5.id IS NULL THEN 'unknown' WHEN ca5.family='VPN / Tunnel' THEN 'vpn' WHEN ca5.family='Proxy / Tor' THEN 'anonymization' ELSE 'service' END AS pk FROM fb2 LEFT JOIN ca5 USING (id))"""
AT = PV + BP + f""", kd AS (SELECT ip, {KIND} AS kind FROM ips),
 at0 AS (SELECT bp.*, coalesce(d.provider, f.provider) AS provider, coalesce(d.is_isp, f.is_isp) AS is_isp, coalesce(d.hosting, f.hosting) AS hosting, coalesce(d.plen, f.plen) AS plen, kind, pp IS NOT NULL AND pf NOT IN ('Web','Encrypted Web/App') AS telling
  FROM bp LEFT JOIN pv d ON d.ip=destination_ip LEFT JOIN pv f ON f.ip=source_ip AND f.is_isp LEFT JOIN kd ON kd.ip=destination_ip),
 at1 AS (SELECT *, CASE WHEN kind IS NOT NULL THEN CASE WHEN telling THEN 'port' ELSE 'internal' END WHEN provider IS NULL THEN 'port' WHEN NOT is_isp THEN 'content' WHEN telling THEN 'port' ELSE 'access' END AS way FROM at0),
 att AS (SELECT *, CASE way WHEN 'internal' THEN CASE kind {" ".join(f"WHEN '{k}' THEN '{n}'" for k, n in s.SPECIAL_NAMES.items())} END WHEN 'content' THEN 'Likely '||provider WHEN 'access' THEN provider||' (Access Network)' ELSE ps END AS service,
  CASE way WHEN 'internal' THEN 'Internal / non-routable' WHEN 'access' THEN 'Carrier / ISP traffic' ELSE pt END AS subtype, CASE way WHEN 'internal' THEN 'Private' WHEN 'content' THEN provider WHEN 'access' THEN 'Access Network' ELSE pf END AS family,
  CASE WHEN kind IS NOT NULL THEN 'internal' WHEN way='content' THEN CASE WHEN hosting THEN 'hosting' ELSE 'content' END WHEN way='access' THEN 'access_network' ELSE pk END AS category,
  CAST(CASE way WHEN 'internal' THEN 70 WHEN 'content' THEN CASE WHEN plen>=20 THEN 90 WHEN plen>=16 THEN 85 ELSE 78 END WHEN 'access' THEN 30 ELSE pc END AS BIGINT) AS confidence FROM at1) """


def _att(t):
    return a.attribute(t.ipdr, s.networks(t.spark), s.ports(t.spark))


def _by_port(t):
    found = a.by_port(t.ipdr, s.ports(t.spark))
    return found.select("id", "destination_port", "port", *[F.col(f"port_{c}").alias(c) for c in ("service", "family", "subtype", "confidence", "category", "evidence")])


register("M01_providers", lambda t: a.providers(t.ipdr.select(F.col("destination_ip").alias("ip")).union(t.ipdr.select("source_ip")), s.networks(t.spark)).withColumn("plen", F.col("plen").cast("long")), PV + " SELECT ip, provider, is_isp, hosting, cidr, CAST(plen AS BIGINT) AS plen FROM pv")
register("M02_address_kind", lambda t: t.ipdr.select("destination_ip").distinct().withColumn("kind", a.address_kind(F.col("destination_ip"))), PV + f" SELECT DISTINCT destination_ip, {KIND} AS kind FROM ipdr JOIN ips ON ip=destination_ip")
register("M03_by_port", lambda t: _by_port(t).select("id", "service", "family", "subtype", "confidence", "category"), BP + " SELECT id, ps AS service, pf AS family, pt AS subtype, pc AS confidence, pk AS category FROM bp")
register("M04_port_ranges", lambda t: a.ranged(t.ipdr.select("destination_port").distinct()),
         BP + " SELECT destination_port, service, family FROM (SELECT DISTINCT destination_port FROM ipdr) JOIN rg ON destination_port BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY destination_port ORDER BY ord)=1")
register("M05_whatsapp_subtypes", lambda t: _by_port(t).where("family = 'WhatsApp'").groupBy("subtype", "confidence").agg(F.count("*").alias("n")), BP + " SELECT pt AS subtype, pc AS confidence, count(*) AS n FROM bp WHERE pf='WhatsApp' GROUP BY 1,2")
register("M06_family_subtypes", lambda t: _by_port(t).where("category <> 'unknown'").groupBy("family", "subtype").agg(F.count("*").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most")), BP + " SELECT pf AS family, pt AS subtype, count(*) AS n, min(pc) AS least, max(pc) AS most FROM bp WHERE pk<>'unknown' GROUP BY 1,2")
register("M07_aligned", lambda t: _by_port(t).where(F.exists("evidence", lambda x: x.endswith(" aligned"))).groupBy("port").agg(F.count("*").alias("n"), F.max("confidence").alias("most")),
         BP + " SELECT pp AS port, count(*) AS n, max(pc) AS most FROM bp JOIN al ON al.proto=bp.proto AND al.port=bp.pp GROUP BY 1")
register("M08_chosen_side", lambda t: _by_port(t).where("port IS NOT NULL").select("id", "port", F.coalesce(F.col("port") != F.col("destination_port"), F.lit(True)).alias("by_source")), BP + " SELECT id, pp AS port, pp IS DISTINCT FROM destination_port AS by_source FROM bp WHERE pp IS NOT NULL")
register("M09_fallback", lambda t: _by_port(t).where("category = 'unknown'").select("id", "service", "subtype", "confidence"), BP + " SELECT id, ps AS service, pt AS subtype, pc AS confidence FROM bp WHERE pk='unknown'")
register("M10_content", lambda t: _att(t).where("category IN ('content', 'hosting')").groupBy("service", "category", "confidence", "subtype").agg(F.count("*").alias("n")), AT + "SELECT service, category, confidence, subtype, count(*) AS n FROM att WHERE category IN ('content','hosting') GROUP BY 1,2,3,4")
register("M11_access_and_internal", lambda t: _att(t).where("category IN ('access_network', 'internal')").select("id", "service", "subtype", "family", "confidence"), AT + "SELECT id, service, subtype, family, confidence FROM att WHERE category IN ('access_network','internal')")
register("M12_attribution", lambda t: _att(t).select("id", "provider", "service", "subtype", "family", "category", "confidence"), AT + "SELECT id, provider, service, subtype, family, category, confidence FROM att")
register("M13_categories", lambda t: _att(t).groupBy("category").agg(F.count("*").alias("n")), AT + "SELECT category, count(*) AS n FROM att GROUP BY 1")
register("M14_service_summary", lambda t: a.service_summary(_att(t)), AT + "SELECT service, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(confidence) AS confidence, arg_min(id, (-confidence, start_time, id)) AS example, arg_min(subtype, (-confidence, start_time, id)) AS subtype, arg_min(family, (-confidence, start_time, id)) AS family FROM att GROUP BY 1")
PF = f", pf(port,family) AS ({_values([(n, f) for f, every in s.FAMILIES for n in s.numbers(every)])}), pn(port,name) AS ({_values(s.NAMES)}), gp(family,gap) AS ({_values(list(s.GAPS.items()))}), fam AS (SELECT ipdr.*, coalesce(d.family, f.family, 'Other') AS fam FROM ipdr LEFT JOIN pf d ON d.port=destination_port LEFT JOIN pf f ON f.port=source_port)"
register("M16_port_names", lambda t: a.port_names(t.ipdr, s.names(t.spark)).groupBy("port_name").agg(F.count("*").alias("n")), PF + " SELECT name AS port_name, count(*) AS n FROM ipdr LEFT JOIN pn ON port=destination_port GROUP BY 1")


def _sessions(rows: str) -> str:
    return f""", se0 AS (SELECT r.*, epoch_us(r.start_time)/1e6 AS t, fam.fam, gap FROM {rows} r JOIN fam USING (id) JOIN gp ON gp.family=fam.fam),
 se1 AS (SELECT *, CASE WHEN t-lag(t) OVER w>gap THEN 1 ELSE 0 END AS new FROM se0 WINDOW w AS (PARTITION BY source_ip, destination_ip, fam ORDER BY start_time, id)),
 se2 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY source_ip, destination_ip, fam ORDER BY start_time, id) AS BIGINT) AS session FROM se1) """


register(
    "N01_ipdr_sessions", lambda t: a.ipdr_sessions(t.ipdr, s.families(t.spark)).drop("start", "end"),
    PF + _sessions("ipdr") + "SELECT source_ip, destination_ip, fam AS family, session, count(*) AS rows, CAST(floor(max(t)-min(t)) AS BIGINT) AS seconds, CAST(sum(bytes_uploaded) AS BIGINT) AS up, CAST(sum(bytes_downloaded) AS BIGINT) AS down, arg_min(tower_id, (start_time, id)) AS tower FROM se2 GROUP BY 1,2,3,4",
)
register(
    "N02_session_services", lambda t: a.session_services(_att(t), s.families(t.spark)),
    AT.rstrip() + PF + _sessions("att") + "SELECT source_ip, destination_ip, fam AS family, session, count(*) AS rows, arg_min(service, (-confidence, start_time, id)) AS service, arg_min(subtype, (-confidence, start_time, id)) AS subtype, max(confidence) AS confidence, arg_min(family, (-confidence, start_time, id)) AS service_family FROM se2 GROUP BY 1,2,3,4",
)
register("N03_port_family", lambda t: a.port_family(t.ipdr, s.families(t.spark)).select("id", "family"), PF + " SELECT id, fam AS family FROM fam")
register("N07_entities", lambda t: a.entities(t.cdr), " SELECT entity, count(*) AS events, count(DISTINCT call_type) AS types, count(DISTINCT contact) AS contacts, strftime(min(start_time),'%Y-%m-%d %H:%M:%S') AS first, strftime(max(start_time),'%Y-%m-%d %H:%M:%S') AS last FROM (SELECT a_party_number AS entity, b_party_number AS contact, call_type, start_time FROM cdr UNION ALL SELECT b_party_number, a_party_number, call_type, start_time FROM cdr) GROUP BY 1")
register("N08_compressed", lambda t: a.compressed(owned(t.cdr)), ", c0 AS (SELECT *, a_party_number AS subject, strftime(start_time,'%Y-%m-%d') AS day, CASE WHEN lag(call_type) OVER (PARTITION BY a_party_number, strftime(start_time,'%Y-%m-%d') ORDER BY start_time, id)=call_type THEN 0 ELSE 1 END AS c FROM cdr), c1 AS (SELECT *, CAST(sum(c) OVER (PARTITION BY subject, day ORDER BY start_time, id) AS BIGINT) AS block FROM c0) SELECT subject, day, block, call_type, count(*) AS times FROM c1 GROUP BY 1,2,3,4")
TK = ", t0 AS (SELECT *, a_party_number AS subject, (epoch_us(start_time)-epoch_us(lag(start_time) OVER (PARTITION BY a_party_number ORDER BY start_time, id)))/1e6 AS gap FROM cdr), t1 AS (SELECT *, CAST(sum(CASE WHEN gap>1800 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY start_time, id) AS BIGINT) AS session FROM t0) "
register("N09_talk_sessions", lambda t: a.talk_sessions(owned(t.cdr)).drop("start"), TK + "SELECT subject, session, count(*) AS calls, CAST(sum(duration_seconds) AS BIGINT) AS seconds, count(DISTINCT b_party_number) AS others, round(arg_min_null(gap, (start_time, id))/60,2) AS gap_before_min FROM t1 GROUP BY 1,2")
register("N09_session_gaps", lambda t: a.session_gaps(owned(t.cdr)), TK + "SELECT subject, round(avg(gap)/60,2) AS avg_min, round(max(gap)/60,2) AS max_min, round(min(gap)/60,2) AS min_min, count(*) FILTER (WHERE gap>3600) AS over_1h, count(*) FILTER (WHERE gap>21600) AS over_6h, count(*) FILTER (WHERE gap>86400) AS over_24h FROM t0 GROUP BY 1")
AP = f""", ap(ord,app,ports,protos,conf) AS ({_values([(i, x, s.numbers(every), " " + protos + " ", c) for i, (x, every, protos, c) in enumerate(s.APPS)])}),
 ap1 AS (SELECT id, app, CAST(CASE WHEN contains(protos, ' '||upper(protocol)||' ') THEN least({s.APP_SURE}, conf+{s.APP_BONUS}) ELSE conf END AS BIGINT) AS confidence FROM ipdr JOIN ap ON list_contains(ports, destination_port) OR list_contains(ports, source_port) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord)=1) """
register("M15_app_by_port", lambda t: a.app_by_port(t.ipdr, s.apps(t.spark)), AP + "SELECT id, app, confidence FROM ap1")
register("M15_app_summary", lambda t: a.app_summary(a.app_by_port(t.ipdr, s.apps(t.spark))), AP + "SELECT app, count(*) AS n, max(confidence) AS confidence FROM ap1 GROUP BY 1")
TC = PF + """, tp0 AS (SELECT *, coalesce(destination_port, -1) AS dp, CASE WHEN source_port<49152 OR destination_port IS NULL THEN source_port END AS sp FROM ipdr),
 tp AS (SELECT id, dp IN (500,1194,1195,1701,1723,4500,51820,51821) OR coalesce(sp IN (500,1194,1195,1701,1723,4500,51820,51821),false) AS vpn, dp IN (3389,5900,5901,5902,5903) OR coalesce(sp IN (3389,5900,5901,5902,5903),false) AS remote,
  dp IN (20,21,139,445,989,990) OR coalesce(sp IN (20,21,139,445,989,990),false) AS transfer, dp IN (3478,3479,3480,3481,16384,16387,19302,19303,19304,19305,8801,8810,5004) OR coalesce(sp IN (3478,3479,3480,3481,16384,16387,19302,19303,19304,19305,8801,8810,5004),false) AS media FROM tp0)""" + _sessions("ipdr") + """,
 tf AS (SELECT source_ip, destination_ip, fam AS family, session, count(*) AS rows, CAST(floor(max(t)-min(t)) AS BIGINT) AS seconds, CAST(sum(bytes_uploaded) AS BIGINT) AS up, CAST(sum(bytes_downloaded) AS BIGINT) AS down, bool_or(vpn) AS vpn, bool_or(remote) AS remote, bool_or(transfer) AS transfer, bool_or(media) AS media,
  bool_or(protocol='UDP') AS udp, bool_or(protocol='TCP') AS tcp, hour(min(start_time)) AS hour FROM se2 JOIN tp USING (id) GROUP BY 1,2,3,4),
 tg AS (SELECT *, up+down AS b, CASE WHEN up+down>0 THEN up/(up+down) END AS share FROM tf),
 tc AS (SELECT *, CASE WHEN vpn AND (udp OR tcp) AND seconds>30 THEN 'VPN / Encrypted Tunnel' WHEN remote AND tcp THEN 'Remote Desktop' WHEN transfer AND up>0 AND down>0 THEN 'File Transfer'
  WHEN tcp AND seconds>=120 AND rows>=3 AND up>0 AND down>0 AND share BETWEEN 0.3 AND 0.7 AND b BETWEEN 100000 AND 5000000 THEN 'Cloud Sync' WHEN udp AND b>5000000 AND seconds>=60 AND share BETWEEN 0.3 AND 0.7 THEN 'Video Call'
  WHEN udp AND media AND share BETWEEN 0.3 AND 0.7 AND seconds>=30 THEN 'Voice Call' WHEN udp AND seconds>=300 AND b BETWEEN 100000 AND 5000000 THEN 'Conference' WHEN udp AND seconds>=60 AND b BETWEEN 100000 AND 5000000 THEN 'Screen Sharing'
  WHEN tcp AND share<0.15 AND seconds>=300 THEN 'Streaming' WHEN share>0.7 THEN 'Media Upload' WHEN udp AND seconds<=10 AND b>2000 AND b<=20000 THEN 'Messaging' WHEN tcp AND seconds<=60 AND b>2000 AND b<=5000000 THEN 'Browsing / Interactive'
  WHEN b<=2000 AND seconds<=10 THEN 'Presence / Keep-alive' ELSE 'Network Traffic' END AS class FROM tg) """
register("M17_traffic_pattern", lambda t: w.traffic_classes(t.ipdr, s.families(t.spark)).select("source_ip", "destination_ip", "family", "session", "rows", "seconds", "class", "confidence_change", F.array_join("evidence", "; ").alias("evidence")), TC + """SELECT source_ip, destination_ip, family, session, rows, seconds, class,
 CASE class WHEN 'VPN / Encrypted Tunnel' THEN 10 WHEN 'Remote Desktop' THEN 10 WHEN 'File Transfer' THEN 8 WHEN 'Cloud Sync' THEN 5 WHEN 'Video Call' THEN 8 WHEN 'Voice Call' THEN 8 WHEN 'Conference' THEN 5 WHEN 'Screen Sharing' THEN 5 WHEN 'Streaming' THEN 6 WHEN 'Media Upload' THEN 5 WHEN 'Messaging' THEN 3 WHEN 'Browsing / Interactive' THEN 2 WHEN 'Presence / Keep-alive' THEN -5 ELSE 0 END AS confidence_change,
 CASE class WHEN 'VPN / Encrypted Tunnel' THEN 'Tunnel port held open' WHEN 'Remote Desktop' THEN 'Remote desktop port over TCP' WHEN 'File Transfer' THEN 'File transfer port, data both ways' WHEN 'Cloud Sync' THEN 'Persistent TCP, data both ways' WHEN 'Video Call' THEN 'Symmetric UDP of high volume' WHEN 'Voice Call' THEN 'Symmetric UDP on media ports' WHEN 'Conference' THEN 'Long UDP session of moderate volume' WHEN 'Screen Sharing' THEN 'Sustained UDP of moderate volume'
  WHEN 'Streaming' THEN 'Long TCP download' WHEN 'Media Upload' THEN 'Most bytes go up' WHEN 'Messaging' THEN 'Short burst of little UDP data' WHEN 'Browsing / Interactive' THEN 'Short TCP session' WHEN 'Presence / Keep-alive' THEN 'Minimal traffic' ELSE 'No distinct pattern' END || CASE WHEN hour<5 THEN '; Late-night activity' WHEN hour BETWEEN 9 AND 17 THEN '; Business hours' ELSE '' END AS evidence FROM tc""")  # fmt: skip
register("M17_traffic_summary", lambda t: w.traffic_summary(w.traffic_classes(t.ipdr, s.families(t.spark))), TC + "SELECT class, count(*) AS sessions, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(b) AS BIGINT) AS bytes, max(seconds) AS longest FROM tc GROUP BY 1")
