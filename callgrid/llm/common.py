"""Shared helpers: scratch tables in the cluster's shared folder and table readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PATHS: dict[int, tuple[DataFrame, str]] = {}

#: What separates words: exactly these six characters.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java class, for Spark's regular expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset and Spark runs in one process (tests,
    notebooks) a temporary folder takes its place; on a cluster the setting is required.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="callgrid-")
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return _OWN[sc.applicationId]


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A query within leaves no shuffle files behind once it has ended; the user's own setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, name: str, instead_of: Iterable[DataFrame] = (), random: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation.

    Tables of this kind that the new one stands ``instead_of`` are removed once it is written; nothing that is
    still to be read may rest on them. Columns of ``random`` values get no dictionaries. The other tables stay below ``callgrid/`` until the job's owner clears the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/callgrid/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("parquet.enable.dictionary", str(not random).lower()).parquet(path)
    for old in instead_of:
        where = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(id(old))[1])
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (table, path)
    return table


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches small in rows and bytes, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def split_skew(spark: SparkSession) -> None:
    """Let adaptive execution split the hot keys of a join even where that costs another shuffle."""
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


#: A key is hot that has over 1 / HOT of all rows, so fewer than HOT keys are; its rows go to SALTS tasks.
HOT, SALTS = 2048, 64


def salted_join(big: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """``big`` joined with ``side``, which has each ``key`` once with the ``count`` of its rows in ``big``.

    Hot keys are salted: fewer than HOT of them are broadcast to find their rows, and their row of ``side`` is
    given once for each salt. A row's salt comes from all its columns, so it's the same in a repeated task.
    """
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = side.where(F.col(count) > total / HOT).select(F.col(key).alias("__hot"))
    dealt = big.join(F.broadcast(hot), big[key] == hot["__hot"], "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))).drop("__hot")
    salts = F.when(F.col(count) > total / HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(side.withColumn("__salt", F.explode(salts)), [key, "__salt"]).drop("__salt")
