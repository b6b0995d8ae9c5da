"""Tables in the cluster's shared folder, to cut lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def folder(df: DataFrame) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in one process."""
    sc = df.sparkSession.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="callgrid-"))


def place(df: DataFrame, name: str) -> str:
    """A new folder for tables that are written part by part."""
    return f"{folder(df)}/callgrid/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    path = place(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
