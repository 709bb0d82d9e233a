"""The materialized stage boundary must not change any result."""

import pytest

from riskflow.plans import queries as Q
from tools.oracle_check import canon

SF = "/root/testdata/sf0.001"
NAMES = ["transition_matrix", "latest_snapshot", "within_term_watchlist", "scored_snapshot",
         "watchlist_page", "class_report", "model_comparison", "portfolio_evolution", "risk_trend",
         "time_split", "horizon_risk"]


@pytest.fixture(scope="module")
def both(spark):
    lazy = Q.Portfolio(spark, SF)
    mat = lazy.materialize()
    return lazy, mat


@pytest.mark.parametrize("name", NAMES)
def test_same_results(spark, both, name):
    lazy, mat = both
    key = (id(spark), SF)
    saved = Q._PORTFOLIOS.get(key)
    try:
        Q._PORTFOLIOS[key] = lazy
        a = Q.QUERIES[name](spark, SF)
        ra = canon([tuple(r) for r in a.collect()], a.columns)
        Q._PORTFOLIOS[key] = mat
        b = Q.QUERIES[name](spark, SF)
        rb = canon([tuple(r) for r in b.collect()], b.columns)
    finally:
        if saved is None:
            Q._PORTFOLIOS.pop(key, None)
        else:
            Q._PORTFOLIOS[key] = saved
    assert sorted(a.columns) == sorted(b.columns)
    assert ra == rb
