"""E15, E25, O06, O07, P20, R03, A12: reports in one call, and their tables in a store."""

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import assembly, evidence, risk
from ..sources import store
from ..sources.adapter import CTE
from ..sources.scratch import place, saved
from .catalog import ORACLES, register
from .q_reports import GAP, INV, SER, _circle
from .q_risk import FOUND, IPF

VERSION = 1
CDR_SECTIONS = ["daily_volume", "hourly", "towers", "off_periods", "first_last", "single_days", "weekdays", "longest_calls", "day_night", "isd", "other_circle", "imei", "imsi", "bank_sms"]
IPDR_SECTIONS = ["daily_traffic", "hourly", "towers", "off_periods", "breakdown", "destinations", "throughput", "ports"]


def _report_counts(t):
    routes = saved(assembly.routed(t.cdr, t.ipdr), "routes")
    report = assembly.subject_reports(t.cdr, t.ipdr, dims.isd(t.spark), dims.series(t.spark), dims.tac(t.spark))
    return assembly.section_counts(report, routes, {"cdr": CDR_SECTIONS, "ipdr": IPDR_SECTIONS})


def _counted(kind, section, sql):
    return f"SELECT '{kind}' AS kind, '{section}' AS section, subject, count(*) AS n FROM ({sql}) GROUP BY 3"


_off = CTE + INV + f"SELECT subject FROM (SELECT subject, start_time, {GAP} AS b FROM inv) WHERE epoch_us(start_time)-epoch_us(b)>=3*86400000000"
_isd = CTE + INV + "SELECT DISTINCT subject, other FROM inv WHERE other LIKE '+%' OR other LIKE '00%' OR length(other)<10"
_far = CTE + INV + f", {SER}, y AS (SELECT subject, {_circle('subject')} AS own_circle, {_circle('other')} AS far_circle FROM inv) SELECT DISTINCT subject, own_circle, far_circle FROM y WHERE own_circle<>far_circle"
_sms = CTE + INV + "SELECT DISTINCT subject, other FROM inv WHERE call_type='SMS' AND regexp_matches(other, '[A-Za-z]')"
_dates = ORACLES["E20_off_dates"].replace("d-b>=2", "d-b>=3")
_cdr = dict(zip(CDR_SECTIONS, ["E01_volume_by_day", "E02_hourly_pattern", "E03_tower_footprint", _off, "E05_day_first_last", "E06_single_days", "E07_weekdays", "E08_longest_calls", "E09_day_night", _isd, _far, "E12_imei_summary", "E13_imsi_summary", _sms], strict=True))
_ipdr = dict(zip(IPDR_SECTIONS, ["E17_traffic_by_day", "E18_ipdr_hourly", "E19_ipdr_towers", _dates, "E21_breakdown", "E22_destinations", "E23_daily_throughput", "E24_port_usage"], strict=True))
REPORTS = CTE + INV + f""", ro AS (SELECT DISTINCT subject, 'cdr' AS kind FROM inv UNION ALL SELECT DISTINCT subject, 'ipdr' FROM ses WHERE subject NOT IN (SELECT subject FROM inv)),
 se AS (SELECT 'cdr' AS kind, unnest({CDR_SECTIONS}) AS section UNION ALL SELECT 'ipdr', unnest({IPDR_SECTIONS})),
 co AS ({" UNION ALL ".join(_counted(k, s, ORACLES.get(q, q)) for k, d in (("cdr", _cdr), ("ipdr", _ipdr)) for s, q in d.items())})
 SELECT kind, section, ro.subject, coalesce(n,0) AS n FROM ro JOIN se USING (kind) LEFT JOIN co USING (kind, section, subject)"""
register("E15_report_sections", _report_counts, REPORTS, cte="")
register("E25_report_routes", lambda t: assembly.routed(t.cdr, t.ipdr), INV + "SELECT DISTINCT subject, 'cdr' AS kind FROM inv UNION ALL SELECT DISTINCT subject, 'ipdr' FROM ses WHERE subject NOT IN (SELECT subject FROM inv)")


def _watch(t):
    """A list of each 97th session's address and each 97th call's number."""
    return t.ipdr.where("id % 97 = 1").select(F.col("source_ip").alias("value")).union(t.cdr.where("id % 97 = 1").select("a_party_number"))


def _hits(t):
    return risk.watchlist_hits(t.cdr.select(F.col("a_party_number").alias("subject")), risk.ip_leaderboard(t.ipdr), _watch(t))


def _inferences(t):
    report = assembly.inferences(t.cdr, t.ipdr, t.towers)
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in report.items()]
    out = rows[0]
    for df in rows[1:]:
        out = out.union(df)
    return out


def _manifest(t):
    report = assembly.inferences(t.cdr, t.ipdr, t.towers)
    report |= {k: saved(report[k], "board") for k in ("cdr.risk", "ipdr.risk")}
    return assembly.export_manifest(report, t.cdr, t.ipdr, risk.watchlist_hits(report["cdr.risk"], report["ipdr.risk"], _watch(t)))


register("O04_watchlist_hits", _hits, IPF + ", wl AS (SELECT source_ip AS subject, 'ip' AS kind FROM ipdr WHERE id%97=1 UNION SELECT a_party_number, 'phone' FROM cdr WHERE id%97=1) SELECT * FROM wl WHERE kind='phone' OR subject IN (SELECT subject FROM lbb)")
register(
    "O04_raised_board", lambda t: risk.raised(risk.ip_leaderboard(t.ipdr), _hits(t), "ip"),
    IPF + ", wl AS (SELECT DISTINCT source_ip FROM ipdr WHERE id%97=1), hb AS (SELECT *, subject IN (SELECT * FROM wl) AS hit FROM lbb) SELECT subject, events, CAST(CASE WHEN hit THEN 100 ELSE score END AS BIGINT) AS score, CASE WHEN hit THEN 'critical' ELSE band END AS band, factors+CASE WHEN hit THEN 1 ELSE 0 END AS factors, CASE WHEN hit THEN concat('watchlist_match,', why) ELSE why END AS why FROM hb",
)
register("O06_inference_report", _inferences)
register("O07_export_manifest", _manifest)
register(
    "P20_summary", lambda t: assembly.summary(t.cdr, t.ipdr, t.towers, evidence.ranked(evidence.record_parts(t.cdr, t.towers))),
    FOUND + f"SELECT * FROM ({CTE} SELECT count(*) AS cdr_count, count(DISTINCT a_party_number) AS subjects, strftime(min(start_time),'%Y-%m-%d') AS first_day, strftime(max(start_time),'%Y-%m-%d') AS last_day FROM cdr), ({CTE} SELECT count(*) AS ipdr_count FROM ipdr), ({CTE} SELECT count(*) AS towers FROM tw), (SELECT count(*) AS findings, count(*) FILTER (WHERE severity='High') AS high_priority FROM ff)", cte="",
)


def _stored(t):
    """All analytics of all cases, published in one run to a new store."""
    path = place(t.cdr, "store")
    cases = t.cdr.select("case_id").union(t.ipdr.select("case_id"))
    store.publish(t.spark, path, "first", VERSION, assembly.case_analytics(t.cdr, t.ipdr), cases)
    return path


_cs = "concat(case_id,'|',{0}) AS {0}"
CASED = f"WITH cdr AS (SELECT * REPLACE ({_cs.format('a_party_number')}, {_cs.format('b_party_number')}) FROM ({CTE} SELECT * FROM cdr)), ipdr AS (SELECT * REPLACE ({_cs.format('source_ip')}, {_cs.format('msisdn')}) FROM ({CTE} SELECT * FROM ipdr)) "
_KEYS = {
    "daily_volume": "E01_volume_by_day", "hourly": "E02_hourly_pattern", "towers": "E03_tower_footprint", "weekdays": "E07_weekdays", "time_profile": "P03_time_profile", "bursts": "J01_bursts", "odd_hours": "J02_odd_hours",
    "silences": "P11_silences", "identity": "K05_identity_report", "traffic": "E17_traffic_by_day", "ports": "E24_port_usage",
}
_parts = [f"SELECT '{key}' AS key, split_part(subject,'|',1) AS case_id, count(*) AS n FROM ({ORACLES[q].replace(CTE, CASED)}) GROUP BY 2" for key, q in _KEYS.items()]
_parts += [f"SELECT 'subjects', split_part(s,'|',1), count(*) FROM ({CASED} SELECT DISTINCT a_party_number AS s FROM cdr UNION ALL SELECT DISTINCT source_ip FROM ipdr) GROUP BY 2", f"SELECT 'watermark', case_id, count(*) FROM ({CTE} SELECT DISTINCT case_id, 1 FROM cdr UNION ALL SELECT DISTINCT case_id, 2 FROM ipdr) GROUP BY 2"]
register(
    "R03_materialised", lambda t: store.manifest(t.spark, _stored(t)).select("key", "case_id", "rows", "version"),
    f" , co AS ({' UNION ALL '.join(_parts)}), ca AS (SELECT case_id FROM cdr UNION SELECT case_id FROM ipdr), ke AS (SELECT unnest({[*_KEYS, 'subjects', 'watermark']}) AS key) SELECT key, case_id, coalesce(n,0) AS rows, 1 AS version FROM ca CROSS JOIN ke LEFT JOIN co USING (key, case_id)",
)
register("R03_stored_volume", lambda t: store.read(t.spark, _stored(t), "daily_volume", VERSION), f"SELECT split_part(subject,'|',1) AS case_id, split_part(subject,'|',2) AS subject, day, n FROM ({ORACLES['E01_volume_by_day'].replace(CTE, CASED)})", cte="")
