"""Materialised analytics by case and key, in versions that readers see whole or not at all.

``runs/<run>/<key>`` holds what one run wrote; ``manifests/<number>`` is a table that says, for each key and case, which
run is valid. A run writes its tables, then the next manifest, and at last gives that its number by one rename: a run
that fails before leaves the state before it, and one that comes again under its name changes nothing. A store has one
writer at a time and any number of readers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ENTRY = "key string, case_id string, run string, version int, rows long, build_ms long, fields string"
#: The column of the folders that rows lie in; its values start with a letter, as folders named by numbers are read as numbers.
FOLDER = "__case"


def _folder(case: Column) -> Column:
    return F.concat(F.lit("c"), case)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    where, fs = _files(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """key, case_id, run, version, rows, build_ms, fields of each valid table; the newest state, or that of ``number``."""
    found = _numbers(spark, path)
    if not found:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/manifests/{number if number is not None else found[-1]:012d}")


def publish(spark: SparkSession, path: str, run: str, version: int, tables: dict[str, Callable[[], DataFrame]], cases: DataFrame) -> bool:
    """Makes ``tables`` (key: what builds a frame with case_id) the valid ones of ``cases`` (case_id), all at once.

    Other cases and keys stay as they are; a case of ``cases`` without rows gets an empty table; rows of other cases
    are left out. A null case_id counts as ''. False, and nothing written, if ``run`` is published already.
    """
    if not run.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a name of a run: {run!r}")
    number = (_numbers(spark, path) or [0])[-1]
    before = manifest(spark, path)
    if before.where(F.col("run") == run).head(1):
        return False
    named = cases.select(F.coalesce(F.col("case_id").cast("string"), F.lit("")).alias("case_id")).distinct()
    named.write.mode("overwrite").parquet(f"{path}/runs/{run}/.cases")
    named = spark.read.schema("case_id string").parquet(f"{path}/runs/{run}/.cases")
    entries = []
    for key, build in tables.items():
        started, df = time.monotonic(), build()
        df = df.withColumn("case_id", F.coalesce(F.col("case_id").cast("string"), F.lit(""))).join(named, "case_id", "left_semi")
        df.withColumn(FOLDER, _folder(F.col("case_id"))).write.mode("overwrite").partitionBy(FOLDER).parquet(f"{path}/runs/{run}/{key}")
        fields = StructType([StructField(f.name, f.dataType) for f in df.schema])
        ms = int((time.monotonic() - started) * 1000)
        n = _read(spark, path, run, key, fields.json()).groupBy("case_id").agg(F.count("*").alias("rows"))
        here = named.join(n, "case_id", "left").select(F.lit(key).alias("key"), "case_id", F.lit(run).alias("run"), F.lit(version).alias("version"), F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(ms).cast("long").alias("build_ms"), F.lit(fields.json()).alias("fields"))
        entries.append(here)
    new = reduce(DataFrame.union, entries)
    staged = f"{path}/runs/{run}/.manifest"
    before.join(new.select("key", "case_id"), ["key", "case_id"], "left_anti").select(*new.columns).union(new).write.mode("overwrite").parquet(staged)
    source, fs = _files(spark, staged)
    target, _ = _files(spark, f"{path}/manifests/{number + 1:012d}")
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"another run published state {number + 1} of {path}")
    return True


def _read(spark: SparkSession, path: str, run: str, key: str, fields: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(fields)).add(FOLDER, StringType())
    return spark.read.schema(schema).parquet(f"{path}/runs/{run}/{key}")


def read(spark: SparkSession, path: str, key: str, version: int, case_id: str | None = None) -> DataFrame | None:
    """The valid rows of a key, of one case (its folders only) or all; None if there is none of this version."""
    valid = manifest(spark, path).where((F.col("key") == key) & (F.col("version") == version))
    if case_id is not None:
        valid = valid.where(F.col("case_id") == case_id)
    # one row for each run that still counts, not for each case
    runs = valid.select("run", "fields").distinct().orderBy("run").collect()
    parts = []
    for run, fields in runs:
        rows = _read(spark, path, run, key, fields)
        if case_id is not None:
            rows = rows.where(F.col(FOLDER) == f"c{case_id}")
        parts.append(rows.join(valid.where(F.col("run") == run).select(_folder(F.col("case_id")).alias(FOLDER)), FOLDER, "left_semi").drop(FOLDER))
    return reduce(DataFrame.unionByName, parts) if parts else None


def read_through(spark: SparkSession, path: str, run: str, version: int, key: str, build: Callable[[], DataFrame], case_id: str) -> DataFrame:
    """The valid rows of a key and case; made and published as ``run`` where there are none of this version."""
    found = read(spark, path, key, version, case_id)
    if found is None:
        publish(spark, path, run, version, {key: build}, spark.createDataFrame([(case_id,)], "case_id string"))
        found = read(spark, path, key, version, case_id)
    return found


def tidy(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Removes all but the newest ``keep`` states and the runs that none of these needs, failed ones among them; their names.

    Readers of a removed state fail, so keep as many states as published while the longest reader runs; no run may be writing.
    """
    numbers = _numbers(spark, path)
    kept = numbers[-keep:]
    needed = {r["run"] for n in kept for r in manifest(spark, path, n).select("run").distinct().collect()}
    where, fs = _files(spark, f"{path}/runs")
    runs = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    gone = sorted(set(runs) - needed)
    for n in numbers[:-keep]:
        fs.delete(_files(spark, f"{path}/manifests/{n:012d}")[0], True)
    for run in gone:
        fs.delete(_files(spark, f"{path}/runs/{run}")[0], True)
    return gone
