"""Bars and index bars come from one pass over the ticks, and the queries over contexts read it."""

from __future__ import annotations

import pytest
from oracle import DATA

from fathomline.plans import fixtures, registry


def test_market_is_bars_and_index_bars(spark):
    daily, index = fixtures.market(spark, DATA)
    for made, want in ((daily, fixtures.bars(spark, DATA)), (index, fixtures.index_bars(spark, DATA))):
        assert made.columns == want.columns and want.count() > 0
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))


def test_market_of_odd_ticks(spark, tmp_path):
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"
    from datetime import datetime

    day = datetime(1996, 3, 4)
    rows = [(5, 1, 1, 1, 2.0, 1.0, day), (3, 2, 1, 1, None, 1.0, day), (4, 3, 1, 1, 1.0, 1.0, day), (9, 4, 1, 1, 1.0, 1.0, day), (1, 99, 1, 1, 1.0, 1.0, day), (7, 2, 1, 2, None, 1.0, None)]
    spark.createDataFrame(rows, lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1", 10.0), (2, "Brand#24", None), (3, None, 30.0), (4, "Brand#2", 40.0)], "p_partkey long, p_brand string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    daily, index = fixtures.market(spark, str(tmp_path))
    for made, want in ((daily, fixtures.bars(spark, str(tmp_path))), (index, fixtures.index_bars(spark, str(tmp_path)))):
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("name", ["agent_context", "compact_signals_all", "compact_signals", "percentile_signals", "decision_signals", "proposed_weights", "position_action_all", "indicator_verdicts", "qubo_quadratic", "portfolio_overlay_all", "score_context", "daily_plan", "score_context_all", "candidate_pool_all", "signal_rationale", "qubo_linear"])
def test_ticks_are_read_once(spark, monkeypatch, name):
    read = []
    monkeypatch.setattr(fixtures, "_ticks", lambda *args, whole=fixtures._ticks: read.append(args) or whole(*args))
    made = registry.queries()[name](spark, DATA)
    assert len(read) == 1 and "l_partkey" not in made._jdf.queryExecution().optimizedPlan().toString()
