"""N04 to N06: timelines."""

from pyspark.sql import functions as F

from ..functions import services as s
from ..functions.exprs import when_text
from ..operators import attribution as a
from ..operators import movement as m
from ..operators import timelines as tl
from .catalog import register
from .q_attribution import AT, PF, _sessions
from .q_behaviour import DC, TS
from .q_movement import ST

AT_TIME = TS.format("start_time")
MOVE = ("from_tower", "km", "minutes", "kmh", "mode", "impossible")
MOVE_SQL = "lg.from_tower, round(lg.km,2) AS km, round(lg.hours*60,1) AS minutes, round(lg.kmh,1) AS kmh, lg.mode, lg.impossible"
NO_MOVE = "NULL, NULL, NULL, NULL, NULL, NULL"


def _attributed(t):
    return a.attribute(t.ipdr, s.networks(t.spark), s.ports(t.spark))


def _stream(t):
    return m.streams(t.cdr, t.towers)


def _unified(t):
    rows = tl.unified(t.cdr, _attributed(t), t.towers, s.families(t.spark))
    own = [when_text("time").alias("at"), "event_type", "service", "confidence", "subject", "peer", "tower_id", "seconds"]
    return rows.select(*own, *[F.col(f"move.{c}").alias(c) for c in MOVE], *[F.col(f"session.{c}").alias(c) for c in ("subtype", "family", "rows", "up", "down")], F.col("tower.city").alias("city"))


BEST = "arg_min({}, (-confidence, start_time, id))"
register(
    "N04_timeline", _unified,
    AT.rstrip() + PF + _sessions("att").rstrip() + ST + f"""SELECT {TS.format("cdr.start_time")} AS at, 'Voice Call' AS event_type, 'Voice' AS service, CAST(NULL AS BIGINT) AS confidence, a_party_number AS subject, b_party_number AS peer, cdr.tower_id,
  CAST(duration_seconds AS BIGINT) AS seconds, {MOVE_SQL}, CAST(NULL AS VARCHAR) AS subtype, CAST(NULL AS VARCHAR) AS family, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS BIGINT) AS up, CAST(NULL AS BIGINT) AS down, CAST(NULL AS VARCHAR) AS city FROM cdr LEFT JOIN lg USING (id)
 UNION ALL SELECT strftime(min(start_time),'%Y-%m-%d %H:%M:%S'), 'IP Session', {BEST.format("service")}, max(confidence), source_ip, destination_ip, arg_min(tower_id, (start_time, id)), CAST(floor(max(t)-min(t)) AS BIGINT), {NO_MOVE},
  {BEST.format("subtype")}, {BEST.format("family")}, count(*), CAST(sum(bytes_uploaded) AS BIGINT), CAST(sum(bytes_downloaded) AS BIGINT), NULL FROM se2 GROUP BY source_ip, destination_ip, fam, session
 UNION ALL SELECT NULL, 'Tower Known', 'Tower Registry', NULL, tower_id, NULL, tower_id, NULL, {NO_MOVE}, NULL, NULL, NULL, NULL, NULL, city FROM tw""",
)
register(
    "N05_attributed_timeline", lambda t: tl.simple(t.cdr, _attributed(t), t.towers).select(when_text("time").alias("at"), "event_type", "event", "subject", "peer", "seconds", "service", "confidence", "tower_id"),
    AT + f"""SELECT {AT_TIME} AS at, 'Voice Call' AS event_type, a_party_number||' called '||b_party_number AS event, a_party_number AS subject, b_party_number AS peer, CAST(duration_seconds AS BIGINT) AS seconds, CAST(NULL AS VARCHAR) AS service, CAST(NULL AS BIGINT) AS confidence, tower_id FROM cdr
 UNION ALL SELECT {AT_TIME}, 'IP Session', source_ip||' -> '||destination_ip, source_ip, destination_ip, NULL, service, confidence, tower_id FROM att
 UNION ALL SELECT NULL, 'Tower Registry', 'Tower '||tower_id||' registered', tower_id, NULL, NULL, NULL, NULL, tower_id FROM tw""",
)
register(
    "N06_subject_events",
    lambda t: tl.annotated(_stream(t)).select("subject", "id", when_text("start_time").alias("at"), "kind", F.col("b_party_number").alias("peer"), "direction", "tower_id", "imei", "imsi", *[F.col(f"move.{c}").alias(c) for c in MOVE]),
    ST + f"SELECT msisdn AS subject, cdr.id, {TS.format('cdr.start_time')} AS at, CASE WHEN call_type='SMS' THEN 'sms' ELSE 'call' END AS kind, b_party_number AS peer, direction, cdr.tower_id, cdr.imei, cdr.imsi, {MOVE_SQL} FROM cdr LEFT JOIN lg ON lg.id=cdr.id",
)
register(
    "N06_subject_summary",
    lambda t: tl.summaries(_stream(t)).select(
        "subject", "event_count", "movement.towers", F.round("movement.longest_km", 3).alias("longest_km"), "movement.impossible", "baseline.days", "baseline.mean", "baseline.sd", "baseline.peak_day",
        "escalation.early", "escalation.late", F.col("dormancy.days").alias("silent_days"), "dormancy.last", "dormancy.back", "dormancy.after",
    ),
    ST.rstrip() + DC.rstrip() + f""", ba AS (SELECT subject, count(*) AS days, round(avg(n),3) AS mean, round(stddev_pop(n),3) AS sd, arg_min(day, (-n, day)) AS peak_day FROM dc GROUP BY 1 HAVING sum(n)>=5 AND count(*)>=2),
 es AS (SELECT subject, quantile_cont(n,0.5) FILTER (WHERE i<=days//2) AS early, quantile_cont(n,0.5) FILTER (WHERE i>days//2) AS late FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day) AS i FROM mo) WHERE days>=5 GROUP BY subject, days HAVING late>=3 AND late>=2*early),
 g AS (SELECT msisdn AS subject, start_time, id, lag(start_time) OVER w AS b, row_number() OVER w AS i, count(*) OVER (PARTITION BY msisdn) AS n FROM cdr WINDOW w AS (PARTITION BY msisdn ORDER BY start_time, id)),
 h AS (SELECT *, CAST(floor((epoch_us(start_time)-epoch_us(b))/86400000000) AS BIGINT) AS days FROM g),
 dm AS (SELECT subject, days AS silent_days, {TS.format('b')} AS last, {AT_TIME} AS back, n-i+1 AS after FROM h WHERE n>=4 AND days>=14 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY days DESC, i)=1),
 mv AS (SELECT subject, max(km) AS km, count(*) FILTER (WHERE mode='impossible') AS impossible FROM lg GROUP BY 1), ev AS (SELECT subject, count(*) AS event_count, count(DISTINCT tower_id) AS towers FROM st GROUP BY 1)
 SELECT subject, event_count, towers, round(coalesce(km,0),3) AS longest_km, coalesce(impossible,0) AS impossible, days, mean, sd, peak_day, early, late, silent_days, last, back, after
 FROM ev LEFT JOIN mv USING (subject) LEFT JOIN ba USING (subject) LEFT JOIN es USING (subject) LEFT JOIN dm USING (subject)""",
)
