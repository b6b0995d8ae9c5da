"""Tables on disk: loads that replace or add a case, exports, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import is_sms


def load(df: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ("case_id",)) -> None:
    """``replace`` swaps the partitions that the rows belong to and no others."""
    w = df.sortWithinPartitions("start_time") if "start_time" in df.columns else df
    if mode == "append":
        w.write.mode("append").partitionBy(*by).parquet(path)
    else:
        w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert_analytic(df: DataFrame, path: str, schema_version: int) -> None:
    """The rows of the cases in ``df`` replace those on disk."""
    load(df.withColumn("schema_version", F.lit(schema_version)), path, "replace")


def read_analytic(spark: SparkSession, path: str, schema_version: int) -> DataFrame:
    """Rows of another version count as absent."""
    return spark.read.parquet(path).where(F.col("schema_version") == schema_version)


def read_through(spark: SparkSession, path: str, schema_version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The analytic on disk, built and written first where it is missing or of another version."""
    try:
        found = read_analytic(spark, path, schema_version)
        if found.head(1):
            return found
    except AnalysisException:  # nothing there yet
        pass
    build().withColumn("schema_version", F.lit(schema_version)).write.mode("overwrite").parquet(path)
    return read_analytic(spark, path, schema_version)


def reset(spark: SparkSession, path: str, case_id: str | None = None) -> None:
    """Removes the rows of one case, or of all, from a table that ``load`` wrote; other cases are not rewritten."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path if case_id is None else f"{path}/case_id={case_id}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def export_rows(cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """The export form of calls and sessions, without a cap."""
    a = cdr.select(F.lit("cdr").alias("type"), "id", "start_time", F.col("a_party_number").alias("source"), F.col("b_party_number").alias("target"), F.when(is_sms(), "SMS").otherwise("Voice").alias("svc"), "tower_id", "imei", "imsi")
    b = ipdr.select(F.lit("ipdr").alias("type"), "id", "start_time", F.col("source_ip").alias("source"), F.col("destination_ip").alias("target"), F.col("protocol").alias("svc"), "tower_id", "imei", "imsi")
    return a.unionByName(b)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Copies tables under ``path`` and returns their row counts."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.parquet(f"{path}/{name}").count() for name, df in tables.items()}


def restore(spark: SparkSession, path: str, names: list[str], target: str) -> dict[str, int]:
    """Copies the tables of a snapshot to ``target``, replacing those of their names, and returns their row counts."""
    return snapshot({name: spark.read.parquet(f"{path}/{name}") for name in names}, target)
