"""All registered queries: an operator with its production arguments, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import CTE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, cte: str = CTE) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = cte + sql


from . import q_attribution, q_behaviour, q_compare, q_graph, q_ingest, q_modules, q_movement, q_records, q_reports, q_risk, q_stats, q_timelines, q_assembly  # noqa: E402,F401,I001  each module registers its queries
