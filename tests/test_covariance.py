"""Covariances of pairs against pandas."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pandas as pd
import pytest

from fathomline.operators.aggregates import covariance_pairs

RETURNS = "symbol string, trading_date date, log_return_1d double"


def test_same_as_pandas(spark):
    rng = random.Random(2)
    days = [date(2024, 1, 1) + timedelta(i) for i in range(90)]
    rows = [(f"s{k}", d, None if rng.random() < 0.1 else rng.gauss(0.5 * k, 0.02)) for k in range(9) for d in days if rng.random() < 0.8]
    rows += [("still", d, 0.1) for d in days[:30]] + [("early", days[0], 0.1), (None, days[1], 0.2), ("s1", None, 0.3)]
    made = {(r["i"], r["j"]): (r["cov"], r["n"]) for r in covariance_pairs(spark.createDataFrame(rows, RETURNS), 50, 20).collect()}
    frame = pd.DataFrame([r for r in rows if None not in r], columns=["s", "d", "x"]).sort_values("d").groupby("s").tail(50).pivot(index="d", columns="s", values="x")
    want = {}
    for a, i in enumerate(frame.columns):
        for j in frame.columns[a:]:
            both = frame[[i]].assign(y=frame[j]).dropna()
            if len(both):
                want[i, j] = (252 * both[i].cov(both["y"]) if len(both) >= 20 else 0.0, len(both))
    usual = pd.Series([c for (i, j), (c, _) in want.items() if i == j and c > 1e-12]).median()
    assert set(made) == set(want) and ("early", "early") in made
    for pair, (cov, n) in want.items():
        flat = pair[0] == pair[1] and cov < 1e-12
        assert made[pair] == (pytest.approx(usual if flat else cov, rel=1e-9, abs=1e-12), n)


def test_empty(spark):
    assert covariance_pairs(spark.createDataFrame([], RETURNS)).count() == 0
