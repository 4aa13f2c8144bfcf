"""Ordered work over parts of keys against pandas and plain walks: parts of a few rows, and one key of many rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import blocks, indicators_mart, joins, ledger, windows
from fathomline.operators import indicators_chart as chart
from fathomline.streaming import events

DAY = date(2020, 1, 1)
LONG = 1_000_000


def keyed(seed: int, sizes: dict) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(k, DAY + timedelta(2 * i), rng.uniform(1, 9) if rng.random() < 0.85 else None) for k, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    return rows


SIZES = {"a": 61, "b": 1, "c": 7, "d": 40, None: 9}
SCHEMA = "symbol string, trading_date date, x double"


@pytest.mark.parametrize(("rows", "block"), [(10_000, 512), (10_000, 3), (9, 4), (1, 1)])
def test_recurrences_over_blocks(spark, rows, block):
    data = keyed(1, SIZES)
    made = chart.linear_recurrence(spark.createDataFrame(data, SCHEMA), {"y": ("x", 0.3, 5), "z": ("x", 0.1, 0)}, rows=rows, block=block).toPandas()
    assert len(made) == len(data)
    for key in SIZES:
        got = made[made.symbol.isna() if key is None else made.symbol == key].sort_values("trading_date").reset_index(drop=True)
        own = got.x.astype(float)
        pd.testing.assert_series_equal(got.y.astype(float), own.ewm(alpha=0.3, min_periods=5, adjust=False).mean(), check_names=False)
        pd.testing.assert_series_equal(got.z.astype(float), own.ewm(alpha=0.1, min_periods=0, adjust=False).mean(), check_names=False)


def test_a_key_of_a_million_rows(spark):
    """The largest array of the plan is a block, and the key is in several parts."""
    one = spark.range(LONG).select(F.lit("a").alias("symbol"), F.col("id").alias("at"), F.when(F.col("id") % 7 != 3, F.sin(F.col("id").cast("double"))).alias("x"))
    parts = blocks.parts_of(one, ["symbol"], ["at"], 150_000)
    assert parts.rows.groupBy(blocks.PART).count().agg(F.max("count")).first()[0] < LONG / 3
    made = chart.recurred(parts, {"y": ("x", 2 / 13, 5)}).done().orderBy("at").select("y").toPandas().y
    ids = np.arange(LONG, dtype=float)
    want = pd.Series(np.where(ids % 7 != 3, np.sin(ids), np.nan)).ewm(alpha=2 / 13, min_periods=5, adjust=False).mean()
    pd.testing.assert_series_equal(made.astype(float), want, check_names=False, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("rows", [10_000, 8, 1])
def test_asof_over_parts(spark, rows):
    rng = random.Random(2)
    left = [(rng.choice(["a", "b", "c"]), i, rng.randint(0, 300)) for i in range(120)]
    right = [(k, t, float(t)) for k in ("a", "b") for t in rng.sample(range(40, 300), 20)]
    made = joins.asof_join(spark.createDataFrame(left, "k string, id long, t int"), spark.createDataFrame(right, "k string, at int, v double"), "k", "t", "at", ["at", "v"], rows).collect()
    want = {i: max((at for key, at, _ in right if key == k and at <= t), default=None) for k, i, t in left}
    assert {r["id"]: r["asof_at"] for r in made} == want and len(made) == len(left)
    assert all(r["asof_v"] == r["asof_at"] for r in made)


def test_asof_of_one_long_key(spark):
    left = spark.range(300_000).select(F.lit(1).alias("k"), (F.col("id") * 3 + 1).alias("t"))
    right = spark.range(10).select(F.lit(1).alias("k"), (F.col("id") * 90_000).alias("at"))
    made = joins.asof_join(left, right, "k", "t", "at", ["at"], 20_000)
    assert made.where(F.col("asof_at") != F.floor(F.col("t") / 90_000) * 90_000).count() == 0 and made.count() == 300_000


@pytest.mark.parametrize("rows", [10_000, 13, 2])
@pytest.mark.parametrize(("before", "after"), [(5, 0), (5, 3), (0, 4)])
def test_frames_over_parts(spark, rows, before, after):
    data = spark.createDataFrame(keyed(3, SIZES), SCHEMA)

    def columns(spec):
        frame = spec.rowsBetween(-before, after)
        return {"s": F.sum("x").over(frame), "n": F.count("*").over(frame), "first": F.first("x").over(frame), "q": F.percentile("x", 0.3).over(frame)}

    made = blocks.framed(data, "symbol", "trading_date", before, after, lambda p, keys: p.rows.withColumns(columns(Window.partitionBy(*keys).orderBy("trading_date"))), rows)
    want = data.withColumns(columns(Window.partitionBy("symbol").orderBy("trading_date")))
    order = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
    assert order(made) == order(want)


@pytest.mark.parametrize("rows", [60, 300])
def test_returns_over_parts(spark, rows):
    rng = random.Random(4)
    data = [(k, DAY + timedelta(i), *[rng.uniform(5, 9) for _ in range(4)], 10.0) for k, n in {"a": 700, "b": 3, "c": 80}.items() for i in range(n)]
    df = spark.createDataFrame(data, "symbol string, trading_date date, open double, high double, low double, close double, volume double")
    both = [indicators_mart.symbol_daily_returns(df, rows=n).orderBy("symbol", "trading_date").toPandas() for n in (rows, 10_000)]
    pd.testing.assert_frame_equal(*both, rtol=1e-9)
    assert both[0].sma_200.iloc[650] == pytest.approx(np.mean([r[5] for r in data[451:651]]))


LEDGER = "order_id long, account_id long, symbol string, action string, quantity long, price double, trade_date date"


def orders(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(i, rng.randint(0, 2), "S", rng.choice(["BUY", "BUY", "SELL", "SELL"]), 100 * rng.randint(1, 9), rng.uniform(5, 9), DAY + timedelta(i // 3)) for i in range(n)]


@pytest.mark.parametrize("rows", [17, 4])
def test_ledger_over_parts(spark, rows):
    costed = ledger.apply_costs(spark.createDataFrame(orders(6, 150), LEDGER))
    cash = [{r["order_id"]: round(r["cash"], 6) for r in ledger.cash_balance(costed, 100.0, rows=n).collect()} for n in (rows, 10_000)]
    assert cash[0] == cash[1] and len(cash[0]) == 150
    total: dict = {}
    for r in costed.orderBy("trade_date", "order_id").collect():
        total[r["account_id"]] = total.get(r["account_id"], 100.0) + r["net_cash"]
        assert cash[0][r["order_id"]] == pytest.approx(total[r["account_id"]], abs=1e-5)
    matches = [sorted((str(r["buy_id"]), r["sell_id"], r["qty"], round(r["pnl"] or 0, 6)) for r in ledger.fifo_match(costed, rows=n).collect()) for n in (rows, 10_000)]
    assert matches[0] == matches[1] and any(m[0] == "None" for m in matches[0]) and len(matches[0]) > 40


def test_carried_values_of_short_and_long_keys(spark):
    """One row for each part is carried at most, whatever the number of keys."""
    df = spark.range(400).select((F.col("id") % 90).alias("k"), "id").unionByName(spark.range(1000, 1300).select(F.lit(7).cast("long").alias("k"), "id"))
    parts = blocks.parts_of(df, ["k"], ["id"], 40)
    made = parts.carried(n=(F.count("*"), F.sum), last=(F.max("id"), lambda c: F.last(c, True))).rows
    own = made.withColumn("before", F.row_number().over(Window.partitionBy("k").orderBy("id")) - F.row_number().over(Window.partitionBy("k", blocks.PART).orderBy("id")))
    assert own.where("coalesce(n, 0) <> before").count() == 0 and own.where("last >= id").count() == 0
    assert own.where("n is not null").select("k", blocks.PART).distinct().count() < parts.n and parts.n > 10


def test_the_fold_of_states_that_dont_compose(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(40)], "k string, i int, x double")
    start = F.struct(F.lit(0.0).alias("top"))
    made = windows.scanned(df, "k", "i", {"x": F.col("x")}, start, lambda s, r: F.struct(F.when(r["x"] == 0, 0.0).otherwise(s["top"] + r["x"]).alias("top")), ["top"], 7)
    assert [r["top"] for r in made.orderBy("i").collect()] == [0.0, 1.0, 3.0, 6.0, 10.0] * 8


@pytest.mark.parametrize("rows", [10_000, 9, 1])
def test_gaps_of_slots(spark, rows):
    rng = random.Random(7)
    slots = [(i,) for i in range(0, 60, 2)]
    seen = [(k, t) for k, share in {"a": 0.9, "b": 0.1, "c": 0.5}.items() for (t,) in slots if rng.random() < share] * 2 + [("one", 30), ("all", 0)] + [("all", t) for (t,) in slots]
    made = events.missing_slots(spark.createDataFrame(slots * 2, "t int"), spark.createDataFrame(seen, "k string, t int"), "k", "t", rows).collect()
    want = {(k, t) for k in {k for k, _ in seen} for (t,) in slots} - set(seen)
    assert len(made) == len(want) and {tuple(r) for r in made} == want
    none = spark.createDataFrame([], "k string, t int")
    assert events.missing_slots(none, none, "k", "t").count() == 0
