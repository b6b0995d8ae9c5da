"""Call, session, tower and subscriber tables derived from the ``events`` and ``customer`` tables.

``Tables`` gives the frames that the operators take; ``CTE`` gives the same tables to DuckDB. Both use integer
arithmetic on event ids, users and the number in ``props`` only, so the two engines agree.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CTE = """WITH e AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props,'[0-9]+',0) AS BIGINT) AS k FROM events),
cdr AS (SELECT event_id AS id, CAST(CAST(floor((day(ts)-1)/10.0) AS INT)+1 AS VARCHAR) AS case_id,
 concat('98',lpad(CAST(user_id AS VARCHAR),8,'0')) AS a_party_number, concat('98',lpad(CAST((user_id+1+k%8)%150 AS VARCHAR),8,'0')) AS b_party_number,
 concat('98',lpad(CAST(user_id AS VARCHAR),8,'0')) AS msisdn,
 CASE WHEN event_type='click' THEN 'SMS' ELSE 'Voice' END AS call_type, CASE WHEN k%2=0 THEN 'MO' ELSE 'MT' END AS direction, ts AS start_time,
 CASE WHEN event_type='click' THEN 0 ELSE CAST(floor(value*10) AS INT) END AS duration_seconds,
 concat('T',lpad(CAST(((user_id%20)*2 + CASE WHEN hour(ts)<6 OR hour(ts)>=22 THEN 0 WHEN k%10=0 THEN 7 ELSE 1 END)%40 AS VARCHAR),3,'0')) AS tower_id,
 CASE k%3 WHEN 0 THEN '2G' WHEN 1 THEN '4G' ELSE NULL END AS technology,
 concat('35',lpad(CAST(CASE WHEN user_id%12=0 AND day(ts)>15 THEN user_id+1 ELSE user_id END AS VARCHAR),13,'0')) AS imei,
 concat('404',lpad(CAST(CASE WHEN user_id%10=0 AND day(ts)>20 THEN user_id+500 ELSE user_id END AS VARCHAR),12,'0')) AS imsi
 FROM e WHERE event_id%2=0),
ipdr AS (SELECT event_id AS id, CAST(CAST(floor((day(ts)-1)/10.0) AS INT)+1 AS VARCHAR) AS case_id,
 concat('98',lpad(CAST(user_id AS VARCHAR),8,'0')) AS msisdn,
 concat('10.0.',CAST(user_id%4 AS VARCHAR),'.',CAST(user_id%250 AS VARCHAR)) AS source_ip,
 CASE k%8 WHEN 0 THEN '157.240.1.1' WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '142.250.1.9' WHEN 3 THEN '45.76.1.7' WHEN 4 THEN '49.40.1.2' WHEN 5 THEN '192.168.1.5' WHEN 6 THEN '100.70.1.1' ELSE concat('93.184.216.',CAST(user_id%200 AS VARCHAR)) END AS destination_ip,
 CASE k%10 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 3478 WHEN 3 THEN 1194 WHEN 4 THEN 9050 WHEN 5 THEN 80 WHEN 6 THEN 5222 WHEN 7 THEN 443 WHEN 8 THEN 27017 ELSE CAST((event_id*37)%65536 AS INT) END AS destination_port,
 CASE k%5 WHEN 0 THEN NULL WHEN 1 THEN 5060 WHEN 2 THEN CAST((event_id*41)%49152 AS INT) ELSE CAST(49152+(event_id*43)%16384 AS INT) END AS source_port,
 CASE WHEN k%3=0 THEN 'UDP' WHEN k%11=1 THEN 'TLS' WHEN k%13=1 THEN 'GRE' ELSE 'TCP' END AS protocol, CASE k%4 WHEN 0 THEN 'internet' WHEN 1 THEN 'ims' ELSE NULL END AS apn, CASE k%3 WHEN 0 THEN 'LTE' WHEN 1 THEN 'NR' ELSE NULL END AS rat,
 concat('T',lpad(CAST((user_id%20)*2 AS VARCHAR),3,'0')) AS tower_id,
 concat('35',lpad(CAST(user_id AS VARCHAR),13,'0')) AS imei, concat('404',lpad(CAST(user_id AS VARCHAR),12,'0')) AS imsi,
 CAST(floor(value*10000*(k%7)) AS BIGINT) AS bytes_uploaded, CAST(floor(value*20000) AS BIGINT) AS bytes_downloaded, ts AS start_time
 FROM e WHERE event_id%2=1),
tw AS (SELECT DISTINCT tower_id, CAST(8.0 + (CAST(substr(tower_id,2) AS INT)*37 % 280)/10.0 AS DOUBLE) AS latitude, CAST(69.0 + (CAST(substr(tower_id,2) AS INT)*53 % 270)/10.0 AS DOUBLE) AS longitude,
 concat('City',CAST(CAST(substr(tower_id,2) AS INT)%9 AS VARCHAR)) AS city, CASE WHEN CAST(substr(tower_id,2) AS INT)%8=7 THEN NULL ELSE concat('State',CAST(CAST(substr(tower_id,2) AS INT)%8 AS VARCHAR)) END AS state FROM cdr)
"""


class Tables:
    """The frames of one data folder, built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def _events(self) -> DataFrame:
        e = self.spark.read.parquet(f"{self.dir}/events.parquet")
        return e.select("event_id", "ts", "user_id", "event_type", "value", F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))

    @staticmethod
    def _padded(c, width: int):
        return F.lpad(c.cast("string"), width, "0")

    @property
    def _case(self):
        return F.expr("cast(floor((day(ts) - 1) / 10.0) as int) + 1").cast("string")

    @cached_property
    def cdr(self) -> DataFrame:
        u, k, p = F.col("user_id"), F.col("k"), self._padded
        night = (F.hour("ts") < 6) | (F.hour("ts") >= 22)
        step = F.when(night, 0).when(k % 10 == 0, 7).otherwise(1)
        return self._events.where("event_id % 2 = 0").select(
            F.col("event_id").alias("id"), self._case.alias("case_id"),
            F.concat(F.lit("98"), p(u, 8)).alias("a_party_number"), F.concat(F.lit("98"), p((u + 1 + k % 8) % 150, 8)).alias("b_party_number"),
            F.concat(F.lit("98"), p(u, 8)).alias("msisdn"),
            F.when(F.col("event_type") == "click", "SMS").otherwise("Voice").alias("call_type"),
            F.when(k % 2 == 0, "MO").otherwise("MT").alias("direction"), F.col("ts").alias("start_time"),
            F.when(F.col("event_type") == "click", 0).otherwise(F.floor(F.col("value") * 10).cast("int")).alias("duration_seconds"),
            F.concat(F.lit("T"), p(((u % 20) * 2 + step) % 40, 3)).alias("tower_id"),
            F.when(k % 3 == 0, "2G").when(k % 3 == 1, "4G").alias("technology"),
            F.concat(F.lit("35"), p(F.when((u % 12 == 0) & (F.dayofmonth("ts") > 15), u + 1).otherwise(u), 13)).alias("imei"),
            F.concat(F.lit("404"), p(F.when((u % 10 == 0) & (F.dayofmonth("ts") > 20), u + 500).otherwise(u), 12)).alias("imsi"),
        )

    @cached_property
    def ipdr(self) -> DataFrame:
        u, k, p = F.col("user_id"), F.col("k"), self._padded
        hosts = ["157.240.1.1", "8.8.8.8", "142.250.1.9", "45.76.1.7", "49.40.1.2", "192.168.1.5", "100.70.1.1"]
        ports = [443, 53, 3478, 1194, 9050, 80, 5222, 443, 27017]
        to = F.concat(F.lit("93.184.216."), (u % 200).cast("string"))
        for i, host in reversed(list(enumerate(hosts))):
            to = F.when(k % 8 == i, host).otherwise(to)
        e = F.col("event_id")
        port = (e * 37 % 65536).cast("int")
        for i, n in reversed(list(enumerate(ports))):
            port = F.when(k % 10 == i, F.lit(n)).otherwise(port)
        return self._events.where("event_id % 2 = 1").select(
            F.col("event_id").alias("id"), self._case.alias("case_id"), F.concat(F.lit("98"), p(u, 8)).alias("msisdn"),
            F.concat(F.lit("10.0."), (u % 4).cast("string"), F.lit("."), (u % 250).cast("string")).alias("source_ip"),
            to.alias("destination_ip"), port.alias("destination_port"), 
            F.when(k % 5 == 0, F.lit(None).cast("int")).when(k % 5 == 1, 5060).when(k % 5 == 2, (e * 41 % 49152).cast("int")).otherwise((49152 + e * 43 % 16384).cast("int")).alias("source_port"),
            F.when(k % 3 == 0, "UDP").when(k % 11 == 1, "TLS").when(k % 13 == 1, "GRE").otherwise("TCP").alias("protocol"),
            F.when(k % 4 == 0, "internet").when(k % 4 == 1, "ims").alias("apn"), F.when(k % 3 == 0, "LTE").when(k % 3 == 1, "NR").alias("rat"),
            F.concat(F.lit("T"), p((u % 20) * 2, 3)).alias("tower_id"), F.concat(F.lit("35"), p(u, 13)).alias("imei"), F.concat(F.lit("404"), p(u, 12)).alias("imsi"),
            F.floor(F.col("value") * 10000 * (k % 7)).cast("long").alias("bytes_uploaded"), F.floor(F.col("value") * 20000).cast("long").alias("bytes_downloaded"),
            F.col("ts").alias("start_time"),
        )

    @cached_property
    def towers(self) -> DataFrame:
        n = F.expr("cast(substr(tower_id, 2) as int)")
        return self.cdr.select("tower_id").distinct().select(
            "tower_id", (F.lit(8.0) + (n * 37 % 280) / 10.0).alias("latitude"), (F.lit(69.0) + (n * 53 % 270) / 10.0).alias("longitude"),
            F.concat(F.lit("City"), (n % 9).cast("string")).alias("city"), F.when(n % 8 != 7, F.concat(F.lit("State"), (n % 8).cast("string"))).alias("state"),
        )
