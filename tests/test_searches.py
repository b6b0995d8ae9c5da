"""Queries that need betweenness search graphs of like nodes as arrays, never by a join for each level."""

import pytest

from callgrid.operators import graph
from callgrid.plans import catalog


@pytest.mark.parametrize("name", ["I09_brokers", "I14_roles", "I19_structural_roles", "O01_cdr_factors", "O02_leaderboard", "O06_inference_report", "O07_export_manifest", "O08_factor_findings", "O08_findings"])
def test_no_searches_by_joins(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "dependencies", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").columns
