"""O: risk and evidence."""

from pyspark.sql import functions as F

from ..operators import behaviour as b
from ..operators import evidence as ev
from ..operators import risk as r
from ..sources.adapter import CTE
from .catalog import ORACLES, register
from .q_behaviour import _cad

IPF = f""", tn AS (SELECT source_ip AS subject, count(*) FILTER (WHERE destination_port IN {tuple(b.VPN_PORTS)}) AS vpn, count(*) FILTER (WHERE destination_port IN {tuple(b.PROXY_PORTS)}) AS proxy FROM ipdr GROUP BY 1),
 vo AS (SELECT source_ip AS subject, sum(bytes_uploaded) AS up, sum(bytes_downloaded) AS down, count(*) AS sessions FROM ipdr GROUP BY 1 ORDER BY up DESC, subject LIMIT 15),
 cd0 AS ({_cad('ipdr', 'source_ip', 'destination_ip', 4, 6, 0.25)}), po AS (SELECT source_ip, destination_ip, arg_max(destination_port, (start_time, id)) AS port FROM ipdr GROUP BY 1,2), cd AS (SELECT * FROM cd0 JOIN po USING (source_ip, destination_ip) ORDER BY cv, source_ip, destination_ip LIMIT 15),
 fa AS (SELECT subject, 'tor_proxy' AS factor, 18 AS weight, vpn+proxy AS sessions FROM tn WHERE proxy>0 UNION ALL SELECT subject, 'vpn', 12, vpn+proxy FROM tn WHERE vpn>0 UNION ALL SELECT subject, 'exfil', 16, sessions FROM vo WHERE up>=52428800 AND (down=0 OR up>=3*down) UNION ALL SELECT source_ip, 'beaconing', 16, n FROM cd WHERE port NOT IN (80,443)),
 sc AS (SELECT subject, least(100, sum(weight)) AS raw, count(*) AS factors, string_agg(factor, ',' ORDER BY factor) AS why FROM fa GROUP BY 1), ev AS (SELECT subject, max(sessions) AS events FROM fa GROUP BY 1),
 lb AS (SELECT subject, factors, why, events, CAST(CASE WHEN events<3 THEN least(49, raw) ELSE raw END AS BIGINT) AS score FROM sc JOIN ev USING (subject)), lbb AS (SELECT *, CASE WHEN score>=75 THEN 'critical' WHEN score>=50 THEN 'high' WHEN score>=25 THEN 'elevated' ELSE 'low' END AS band FROM lb) """
register("O01_cdr_factors", lambda t: r.cdr_factors(t.cdr, t.towers))
register("O02_leaderboard", lambda t: r.leaderboard(t.cdr, t.towers))
register("O03_ip_leaderboard", lambda t: r.ip_leaderboard(t.ipdr), IPF + "SELECT * FROM lbb")
register(
    "O04_watchlist", lambda t: r.with_watchlist(r.ip_leaderboard(t.ipdr), t.ipdr.where("id % 97 = 1").select(F.col("source_ip").alias("value"))),
    IPF + ", wl AS (SELECT DISTINCT source_ip FROM ipdr WHERE id%97=1) SELECT subject, factors, why, events, CASE WHEN subject IN (SELECT * FROM wl) THEN 100 ELSE score END AS score, CASE WHEN subject IN (SELECT * FROM wl) THEN 'critical' ELSE band END AS band, subject IN (SELECT * FROM wl) AS watched FROM lbb",
)
register("O05_watchlist_kind", lambda t: t.cdr.select(F.explode(F.array("msisdn", "imei")).alias("value")).union(t.ipdr.select("source_ip")).distinct().withColumn("kind", r.watchlist_kind(F.col("value"))),
         " SELECT DISTINCT value, CASE WHEN regexp_full_match(value,'\\d{1,3}(\\.\\d{1,3}){3}') THEN 'ip' WHEN regexp_full_match(value,'\\d{15}') THEN 'imei' ELSE 'phone' END AS kind FROM (SELECT msisdn AS value FROM cdr UNION ALL SELECT imei FROM cdr UNION ALL SELECT source_ip FROM ipdr)")
register("O07_manifest", lambda t: r.manifest(r.ip_leaderboard(t.ipdr)), IPF + "SELECT band, count(*) AS n FROM lbb GROUP BY 1")
register("O08_findings", lambda t: ev.findings(t.cdr, t.towers))
register("O08_factor_findings", lambda t: r.findings(t.cdr, t.towers))


def _rule(i, query, category, title, severity, where="true"):
    """One part of the findings in SQL, over the SQL of the query that it rests on."""
    return f"SELECT {i} AS part, '{category}' AS category, {title} AS title, subject, {severity} AS severity FROM ({ORACLES[query] if query in ORACLES else query}) WHERE {where}"


_t = lambda text: f"concat('{text}', subject)"
_grave = lambda c, over: f"CASE WHEN {c}>{over} THEN 'High' ELSE 'Medium' END"
_SIMS = CTE + "SELECT a_party_number AS subject FROM cdr GROUP BY a_party_number, imei HAVING count(DISTINCT imsi)>1"
FOUND = "WITH fa AS (" + " UNION ALL ".join([
    _rule(0, "K07_deep_identity", "Identity", _t("Suspected burner identity: "), _grave("burner", 50), "suspected"),
    _rule(1, "K05_identity_report", "Identity", _t("SIM swap detected for "), "'High'", "swaps>0"),
    _rule(2, "K05_identity_report", "Identity", _t("Device change for "), "'Medium'", "devices>0"),
    _rule(3, _SIMS, "Identity", _t("Multi-SIM usage: "), "'Medium'"),
    _rule(4, "K07_deep_identity", "Identity", _t("Device cycling: "), _grave("cycling", 60), "cycling>30"),
    _rule(5, "P10_shift_marks", "Behavioral Shift", "concat(type, ': ', subject)", "severity"),
    _rule(6, "P11_gap_findings", "Network Gap", _t("Network disappearance: "), "severity"),
    _rule(7, "P12_call_findings", "Call Pattern", _t("Suspicious calling: "), "'Medium'"),
    _rule(8, "P14_dominance", "Organization", _t("Potential leader identified: "), "'High'", "role='leader'"),
    _rule(9, f"SELECT *, a AS subject FROM ({ORACLES['P17_shared_contacts']})", "Correlation", "concat('Linked subjects: ', a, ' & ', b)", "'Medium'"),
    _rule(10, "P07_radius", "Movement", _t("Wide operational range: "), "'Medium'", "km>100"),
    _rule(11, "N09_session_gaps", "Session Pattern", _t("Gap-rich communication: "), "'Medium'", "over_24h>3"),
    _rule(12, "P03_time_profile", "Behavioral", _t("Night-dominant activity: "), "'Low'", "night_owl"),
]) + "), fw AS (SELECT *, CAST(CASE severity WHEN 'High' THEN 75 WHEN 'Medium' THEN 50 ELSE 25 END AS BIGINT) AS weight FROM fa), ff AS (SELECT category, title, subject, severity, weight FROM fw QUALIFY row_number() OVER (PARTITION BY title ORDER BY weight DESC, part)=1) "
register("O08_record_findings", lambda t: ev.ranked(ev.record_parts(t.cdr, t.towers)).drop("detail"), FOUND + "SELECT * FROM ff", cte="")
register("O08_counts", lambda t: ev.counts(ev.ranked(ev.record_parts(t.cdr, t.towers))), FOUND + "SELECT severity, category, count(*) AS n FROM ff GROUP BY GROUPING SETS ((severity), (category), ())", cte="")


def _chain(t):
    """An audit chain over the calls, in which each hundredth row was altered later."""
    row = t.cdr.select((F.col("id") / 2).cast("long").alias("id"), F.col("a_party_number").alias("username"), F.col("tower_id").alias("action"))
    row = row.withColumn("prev_hash", F.sha2((F.col("id") - 1).cast("string"), 256)).withColumn("entry_hash", F.sha2(F.concat_ws("\u001f", "prev_hash", "username", "action"), 256))
    return row.withColumn("action", F.when(F.col("id") % 100 == 7, F.lit("X")).otherwise(F.col("action")))


register("O09_audit_breaks", lambda t: r.audit_breaks(_chain(t), ["username", "action"]),
         " SELECT CAST(id/2 AS BIGINT) AS id, CASE WHEN CAST(id/2 AS BIGINT)%100=7 THEN 'content' ELSE 'prev_hash' END AS kind FROM cdr WHERE id>(SELECT min(id) FROM cdr) OR CAST(id/2 AS BIGINT)%100=7")
