"""Edge frames and cross-checks in pandas and plain Python."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime, timedelta
from functools import cache
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import exprs as x
from fathomline.operators import indicators_chart as chart
from fathomline.operators import aggregates, ledger, merge, quality, scoring, text, windows
from fathomline.operators import indicators_mart as mart
from fathomline.sources import tables as src
from fathomline.streaming import events as ev
from fathomline.streaming.bars import build_bars

BAR = "symbol string, trading_date date, open double, high double, low double, close double, volume double"


def walk(symbol: str, n: int, seed: int) -> list[tuple]:
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        first, price = price, price * (1 + rng.uniform(-0.03, 0.03))
        out.append((symbol, date(2024, 1, 1) + timedelta(i), first, max(first, price) + rng.random(), min(first, price) - rng.random(), price, float(rng.randint(0, 900))))
    return out


def test_edge_bars_make_nulls_not_errors(spark):
    rows = [("one", date(2024, 1, 1), 5.0, 5.0, 5.0, 5.0, 0.0)] + [("flat", date(2024, 1, 1) + timedelta(i), 5.0, 5.0, 5.0, 5.0, 0.0) for i in range(30)]
    made = mart.indicator_suite(spark.createDataFrame(rows, BAR)).where("symbol = 'one'").first()
    assert made["rsi_14"] is None and made["stochastic_k"] is None and made["sma_20"] == 5.0
    assert spark.createDataFrame([], BAR).transform(mart.indicator_suite).count() == 0
    assert chart.indicator_suite(spark.createDataFrame(rows, BAR)).count() == 31


def test_rsi_stays_in_bounds_and_matches_pandas(spark):
    rows = walk("a", 80, 1)
    got = chart.rsi(spark.createDataFrame(rows, BAR)).orderBy("trading_date").toPandas()["rsi"]
    change = pd.Series([r[5] for r in rows]).diff()
    up, down = (s.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for s in (change.clip(lower=0), -change.clip(upper=0)))
    pd.testing.assert_series_equal(got, 100 - 100 / (1 + up / down), check_names=False)
    assert got.dropna().between(0, 100).all()


def test_supertrend_against_its_definition(spark):
    """Each row anew: a band is the extreme of the basic ones since the close last broke it; the last close beyond the
    band of the row before says which way the trend goes."""
    rows = walk("a", 60, 2)
    got = chart.supertrend(spark.createDataFrame(rows, BAR)).orderBy("trading_date").toPandas()["supertrend"]
    high, low, close = (pd.Series([r[i] for r in rows]) for i in (3, 4, 5))
    reach = pd.concat([high - low, (high - close.shift()).abs(), (low - close.shift()).abs()], axis=1).max(axis=1)
    width = 3 * reach.ewm(alpha=0.1, min_periods=10, adjust=False).mean()
    first = int(width.first_valid_index())
    basic = {1: ((high + low) / 2 + width).tolist(), -1: ((high + low) / 2 - width).tolist()}

    @cache
    def band(side: int, i: int) -> float:
        since = max([first, *(j for j in range(first + 1, i + 1) if side * close[j - 1] > side * band(side, j - 1))])
        return side * min(side * x for x in basic[side][since : i + 1])

    def trend(i: int) -> int:
        for j in range(i, first - 1, -1):
            for side in (1, -1):
                if side * close[j] > side * (band(side, j - 1) if j > first else basic[side][j]):
                    return side
        return 1

    want = [None if i < max(first, 1) else band(-trend(i), i) for i in range(60)]
    pd.testing.assert_series_equal(got, pd.Series(want, dtype=float), check_names=False)
    assert len({trend(i) for i in range(first, 60)}) == 2


@pytest.mark.parametrize("block", [1, 7, 256])
def test_recurrences_against_pandas(spark, block):
    """Gaps keep the value and let its weight fade, as ewm() without adjusting does."""
    rng = random.Random(5)
    xs = [None, None, *[rng.uniform(-1, 1) if rng.random() < 0.8 else None for _ in range(60)]]
    rows = [(k, date(2024, 1, 1) + timedelta(i), x) for k in ("a", "b") for i, x in enumerate(xs if k == "a" else xs[::-1])]
    made = chart.linear_recurrence(spark.createDataFrame(rows, "symbol string, trading_date date, x double"), {"y": ("x", 0.3, 5), "z": ("x", 0.1, 0)}, block=block).orderBy("trading_date").toPandas()
    for key in ("a", "b"):
        own = pd.Series([r[2] for r in rows if r[0] == key], dtype=float)
        got = made[made.symbol == key].reset_index(drop=True)
        pd.testing.assert_series_equal(got.y.astype(float), own.ewm(alpha=0.3, min_periods=5, adjust=False).mean(), check_names=False)
        pd.testing.assert_series_equal(got.z.astype(float), own.ewm(alpha=0.1, min_periods=0, adjust=False).mean(), check_names=False)


def test_replace_slices_is_idempotent_and_deletes(spark):
    base = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 1, 1.0)], "symbol string, bar_time int, close double")
    batch = spark.createDataFrame([("a", 3, 9.0), ("a", 6, 9.0)], base.schema)
    once = merge.replace_slices(base, batch, "symbol", "bar_time")
    assert sorted(r["bar_time"] for r in once.where("symbol = 'a'").collect()) == [0, 1, 2, 3, 6, 7, 8, 9]
    assert sorted(once.collect()) == sorted(merge.replace_slices(once, batch, "symbol", "bar_time").collect())


def test_a_table_without_versions_is_the_first_and_unfinished_ones_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "k string, v int")
    flat, split, odd = (str(tmp_path / n) for n in ("flat", "split", "odd"))
    rows.write.parquet(flat)
    rows.write.partitionBy("k").parquet(split)
    for at in (flat, split):
        rows.limit(1).write.parquet(f"{at}/version=0")
        (Path(at) / "version=0" / "_SUCCESS").unlink()
        for schema in (None, rows.schema):
            assert sorted((r["k"], r["v"]) for r in ev.current(spark, at, schema).collect()) == [("A", 1), ("A", 2), ("B", 3)]
    rows.write.parquet(f"{odd}/version=0")
    (Path(odd) / "version=0" / "_SUCCESS").unlink()
    assert ev.current(spark, odd, rows.schema).count() == 0 and ev.current(spark, str(tmp_path / "none"), rows.schema).count() == 0
    with pytest.raises(ValueError, match="no table"):
        ev.current(spark, odd)
    # an upsert keeps what was there
    new = spark.createDataFrame([("B", 30), ("C", 4)], "k string, v int")
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    ev.upsert_stream(stream, flat, ["k"], lambda: [F.desc("v")], str(tmp_path / "c")).awaitTermination(60)
    assert sorted((r["k"], r["v"]) for r in ev.current(spark, flat).collect()) == [("A", 1), ("A", 2), ("B", 30), ("C", 4)]


LEDGER = "order_id long, account_id long, symbol string, action string, quantity long, price double, trade_date date"


def settles(day: date) -> date:
    left = 2
    while left:
        day += timedelta(1)
        left -= day.weekday() < 5
    return day


def test_fifo_match_against_a_walk_along_time(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 2), "S", rng.choice(["BUY", "BUY", "SELL"]), 100 * rng.randint(1, 9), rng.uniform(5, 9), date(2024, 1, 1) + timedelta(i // 3)) for i in range(200)]
    got = {(r["buy_id"], r["sell_id"]): r["qty"] for r in ledger.fifo_match(ledger.apply_costs(spark.createDataFrame(rows, LEDGER))).collect()}
    want: dict = {}
    lots: dict = {}
    for i, account, _, action, left, _, day in sorted(rows, key=lambda r: (r[6], r[3] != "BUY", r[0])):
        if action == "BUY":
            lots.setdefault(account, []).append([i, left, settles(day)])
            continue
        for lot in lots.get(account, []):
            if lot[2] <= day and lot[1] and left:
                n = min(left, lot[1])
                want[lot[0], i] = n
                left, lot[1] = left - n, lot[1] - n
        if left:
            want[None, i] = left
    assert got == want and any(buy is None for buy, _ in want)


def test_sales_before_purchase_or_settlement_find_nothing(spark):
    rows = [(1, 1, "S", "SELL", 100, 9.0, date(2024, 1, 1)), (2, 1, "S", "BUY", 300, 5.0, date(2024, 2, 1)), (3, 1, "S", "SELL", 100, 9.0, date(2024, 2, 2)), (4, 1, "S", "SELL", 250, 9.0, date(2024, 2, 5)), (5, 1, "S", "SELL", 100, 9.0, date(2024, 2, 6))]
    made = ledger.fifo_match(ledger.apply_costs(spark.createDataFrame(rows, LEDGER))).orderBy("sell_id", F.asc_nulls_last("buy_id")).collect()
    assert [(r["buy_id"], r["sell_id"], r["qty"], r["pnl"] is None) for r in made] == [(None, 1, 100, True), (None, 3, 100, True), (2, 4, 250, False), (2, 5, 50, False), (None, 5, 50, True)]
    early = ledger.fifo_match(ledger.apply_costs(spark.createDataFrame(rows[1:2] + rows[3:4], LEDGER)), moment=F.to_timestamp_ntz(F.concat(F.col("trade_date").cast("string"), F.lit(" 12:59:00"))))
    assert [(r["buy_id"], r["qty"]) for r in early.collect()] == [(None, 250)]


def test_cash_comes_from_what_was_sold_only(spark):
    rows = [(1, 1, "S", "SELL", 100, 10.0, date(2024, 1, 1)), (2, 1, "S", "BUY", 300, 5.0, date(2024, 2, 1)), (3, 1, "S", "SELL", 200, 8.0, date(2024, 2, 6)), (4, 1, "S", "SELL", 400, 9.0, date(2024, 2, 7)), (5, 2, "S", "SELL", 100, 10.0, date(2024, 1, 1))]
    costed = ledger.apply_costs(spark.createDataFrame(rows, LEDGER))
    done = ledger.filled(costed, ledger.fifo_match(costed))
    assert {r["order_id"]: (r["asked"], r["quantity"]) for r in done.collect()} == {1: (100, 0), 2: (300, 300), 3: (200, 200), 4: (400, 100), 5: (100, 0)}
    cash = {r["order_id"]: r["cash"] for r in ledger.cash_balance(done).collect()}
    want = {1: 0.0, 2: -1500 * 1.0015, 3: -1500 * 1.0015 + 1600 * 0.9975, 4: -1500 * 1.0015 + 2500 * 0.9975, 5: 0.0}
    assert cash == pytest.approx(want)
    # realised profits are the cash of what was bought and sold again
    assert sum(r["pnl"] or 0 for r in ledger.fifo_match(costed).collect()) == pytest.approx(want[4])
    none = costed.limit(0)
    assert ledger.filled(none, ledger.fifo_match(none)).count() == 0


def test_settlement_buckets_turn_at_one_o_clock(spark):
    lots = spark.createDataFrame([(1, "S", date(2024, 2, 1), 10), (1, "S", date(2024, 2, 2), 20), (1, "S", date(2024, 2, 5), 40), (1, "S", date(2024, 1, 31), 0)], "account_id long, symbol string, trade_date date, remaining_quantity long")
    at = lambda t: ledger.settlement_buckets(lots, F.lit(t).cast("timestamp_ntz")).select("sellable", "t0", "t1", "t2").first()
    assert tuple(at("2024-02-05 12:00:00")) == (0, 40, 20, 10) and tuple(at("2024-02-05 13:00:00")) == (10, 40, 20, 0)


def test_subset_scan_against_all_subsets(spark):
    rng = random.Random(4)
    lin = [(date(2024, 1, 1), f"s{i}", i, 3, rng.uniform(-1, 1)) for i in range(1, 7)]
    quad = [(date(2024, 1, 1), i, j, rng.uniform(-1, 1)) for i, j in itertools.combinations(range(1, 7), 2)]
    best = scoring.subset_scan(spark.createDataFrame(lin, "trading_date date, symbol string, rank int, target int, linear double"), spark.createDataFrame(quad, "trading_date date, ri int, rj int, quadratic double")).first()
    energy = lambda s: sum(v[4] for v in lin if v[2] in s) + sum(q[3] for q in quad if q[1] in s and q[2] in s) + 0.05 * 9
    want = min((c for n in (1, 2, 3) for c in itertools.combinations(range(1, 7), n)), key=energy)
    assert best["selected"] == [f"s{i}" for i in want] and best["energy"] == pytest.approx(energy(want))


def test_weights_sum_to_one_at_most(spark):
    picks = spark.createDataFrame([(date(2024, 1, 1), f"s{i}", 0.3) for i in range(9)], "as_of_date date, symbol string, weight double")
    made = scoring.sanitize_weights(picks, picks, cap=0.5, max_positions=6).toPandas()
    assert made.clean_weight.sum() == pytest.approx(1.0) and (made.clean_weight > 0).sum() == 6


def test_daily_plan_spends_cash_in_rank_order(spark):
    rows = [("A", 1, "x", "candidate_long", 10.0, 0, 0, 3000.0, 4000.0), ("A", 2, "y", "candidate_long", 10.0, 0, 0, 3000.0, 4000.0), ("A", 3, "z", "avoid_or_reduce", 10.0, 200, 0, 0.0, 4000.0)]
    made = scoring.daily_plan(spark.createDataFrame(rows, "account_id string, rank int, symbol string, recommendation string, price double, quantity int, sellable int, target_value double, cash double"))
    assert [(r["proposed_action"], r["suggested_quantity"]) for r in made.orderBy("rank").collect()] == [("BUY", 300), ("WATCH", 0), ("HOLD_LOCKED", 0)]


def test_chunks(spark):
    long = "\n\n".join("p%d " % i + "x" * 500 for i in range(20))
    docs = spark.createDataFrame([(1, "a" * 2400), (2, "b" * 2401), (3, ""), (4, None), (5, "c\r\nd"), (6, long)], "doc_id long, text string")
    made = text.chunk_ids(text.chunk_documents(docs)).toPandas()
    assert made.groupby("doc_id").size().to_dict()[1] == 1 and set(made.doc_id) == {1, 2, 5, 6}
    assert made[made.doc_id == 2].char_count.tolist() == [2400, 241] and made[made.doc_id == 5].content.iloc[0] == "c\nd"
    assert made.char_count.max() <= 2400 and made.chunk_id.is_unique
    assert all(f"p{i} " in "".join(made[made.doc_id == 6].content) for i in range(20))


def test_retrieval_sees_whole_documents(spark, tmp_path):
    from fathomline.plans import selection

    rows = [(1, "filler words here " * 400 + "zebra", "src"), (2, "nothing of note", "src")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "zebra")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = selection.QUERIES["retrieval_scores_all"](spark, str(tmp_path)).collect()
    assert [(r["query_id"], r["overlap"], r["score"]) for r in found] == [(7, 1, 2.0)]
    assert [r["chunk_id"] for r in selection.QUERIES["select_chunks"](spark, str(tmp_path)).collect()] == [found[0]["chunk_id"]]


def test_select_chunks_walks_the_whole_list(spark):
    scored = spark.createDataFrame([(q, i, 1000.0 - i) for q in (1, 2) for i in range(400)], "query_id long, doc_id long, score double")
    sizes = spark.createDataFrame([(i, 100 if i in (0, 150, 399) else 20000) for i in range(400)], "doc_id long, char_count int")
    made = text.select_chunks(scored, sizes).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"]) for r in made) == [(q, i + 1, i) for q in (1, 2) for i in (0, 150, 399)]


def test_range_join_takes_every_bar(spark):
    from oracle import DATA

    from fathomline.plans import fixtures, relational

    closes: dict = {}
    for row in fixtures.bars(spark, DATA).orderBy("symbol", "trading_date").collect():
        closes.setdefault(row["symbol"], []).append(row["close"])
    made = {(r["symbol"], r["at"]): (r["n"], r["total"]) for r in relational.QUERIES["range_join"](spark, DATA).collect()}
    assert len(made) == sum(map(len, closes.values()))
    for (symbol, at), (n, total) in made.items():
        own = closes[symbol][max(0, at - 10) : at]
        assert n == len(own) and total == pytest.approx(sum(own), abs=1e-3)


def test_selection_queries_take_every_date(spark):
    from oracle import DATA

    from fathomline.plans import features, selection

    days = {(r["symbol"], r["trading_date"]) for r in features.context(spark, DATA).select("symbol", "trading_date").collect()}
    for name in ("score_context", "score_context_all", "indicator_verdicts"):
        assert {(r["symbol"], r["trading_date"]) for r in selection.QUERIES[name](spark, DATA).select("symbol", "trading_date").distinct().collect()} == days


def test_select_chunks_passes_over_what_exceeds(spark):
    scored = spark.createDataFrame([(1, 1, 9.0), (1, 2, 8.0), (1, 3, 7.0)], "query_id long, doc_id long, score double")
    sizes = spark.createDataFrame([(1, 20_000), (2, 10), (3, 10)], "doc_id long, char_count int")
    assert [r["doc_id"] for r in text.select_chunks(scored, sizes).collect()] == [1]
    assert sorted(r["doc_id"] for r in text.select_chunks(scored, sizes.withColumn("char_count", F.col("char_count") / 2)).collect()) == [1, 2, 3]


def test_calendar(spark):
    days = [date(2024, 1, 1) + timedelta(i) for i in range(20)]
    made = spark.createDataFrame([(d,) for d in days], "d date").select("d", x.add_trading_days(F.col("d"), 2).alias("plus"), x.previous_trading_day(F.col("d")).alias("prev"), x.trading_day_gap(F.col("d"), F.lit(date(2024, 2, 1))).alias("gap"))
    for row in made.collect():
        after = [d for d in (row["d"] + timedelta(i) for i in range(1, 9)) if d.weekday() < 5]
        assert row["plus"] == after[1] and row["prev"] == max(d for d in (row["d"] - timedelta(i) for i in range(1, 5)) if d.weekday() < 5)
        assert row["gap"] == sum(1 for i in range(1, 60) if row["d"] + timedelta(i) <= date(2024, 2, 1) and (row["d"] + timedelta(i)).weekday() < 5)


def test_holdings_and_legacy_rows(spark):
    held = src.read_holdings(spark.createDataFrame([("abc", "1,250", "25.5"), ("", "100", "1"), ("def", "50", "9"), ("ghi", "x", "9")], "Ticker string, Qty string, Cost string")).collect()
    assert [tuple(r) for r in held] == [("ABC", 1200, 25500.0)]
    old = spark.createDataFrame([("a", "05/02/2024", "1,000", "1,200", "900", "1,100", "1,500", None), ("b", "bad", "1", "1", "1", "1", "1", "1"), ("c", "05/02/2024", "x", "1", "1", "1", "1", "1")], "symbol string, date string, open string, high string, low string, close string, matched_volume string, negotiated_volume string")
    made = src.standardize_legacy(old, "old").where("symbol = 'a'").first()
    assert (made["trading_date"], made["open"], made["volume"]) == (date(2024, 2, 5), 1000.0, 1500.0)
    assert src.standardize_legacy(old, "old").where("symbol = 'c'").count() == 0


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, v int")
    src.materialize_by_key(df, "symbol", str(tmp_path / "k"))
    src.materialize_by_key(df.where("symbol = 'a'").withColumn("v", F.lit(9)), "symbol", str(tmp_path / "k"))
    assert sorted((r["symbol"], r["v"]) for r in spark.read.parquet(str(tmp_path / "k")).collect()) == [("a", 9), ("b", 2)]
    src.append_raw(df, str(tmp_path / "r"))
    src.append_raw(df, str(tmp_path / "r"))
    assert src.read_bars(spark, str(tmp_path / "r")).count() == 4
    src.write_table(df, str(tmp_path / "w"))
    assert src.run_sql(spark, "SELECT * FROM t WHERE v > 1", {"t": df}).count() == 1
    with pytest.raises(ValueError):
        src.run_sql(spark, "DROP TABLE t", {})


def test_event_lines_and_dead_letters(spark, tmp_path):
    lines = ['{"event_id": "1", "event_ts": "2024-01-01T00:00:00", "event_type": "x"}', "[1]", "{bad", '{"event_id": "2"}']
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.jsonl").write_text("\n".join(lines))
    good, dead = src.read_events(spark, str(tmp_path / "e"))
    assert {r["source_file"].rsplit("/", 1)[1] for r in dead.collect()} == {"a.jsonl"}
    assert good.count() == 1 and sorted(r["error"] for r in dead.collect()) == ["missing event_ts, event_type", "not a JSON object", "not a JSON object"]
    query = src.stream_events(spark, str(tmp_path / "e"), str(tmp_path / "m"))[0].writeStream.format("memory").queryName("good_events").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("good_events").count() == 1


def test_a_batch_rewrites_its_keys_buckets_only(spark, tmp_path):
    at, memory = str(tmp_path / "t"), str(tmp_path / "c")

    def put(batch_id, rows, checkpoint=memory):
        batch = spark.createDataFrame(rows, "k string, v int")
        ev._replace_touched(batch, batch_id, at, checkpoint, ["k"], lambda base, new: merge.upsert(base, new, ["k"], [F.desc("v")]), 16)

    def files():
        return {p.relative_to(at).as_posix(): p.stat().st_mtime_ns for p in Path(at).rglob("part-*.parquet")}

    def rows():
        return sorted((r["k"], r["v"]) for r in ev.current(spark, at).collect())

    first = [(f"k{i}", i) for i in range(200)]
    put(0, first)
    before = files()
    assert rows() == sorted(first) and len({f.split("/")[0] for f in before}) == 16
    put(1, [("k7", 700), ("new", 1)])
    touched = {f.split("/")[0] for f in set(before) ^ set(files())}
    assert len(touched) <= 2 and all(files()[f] == t for f, t in before.items() if f.split("/")[0] not in touched)
    want = sorted([(k, 700 if k == "k7" else v) for k, v in first] + [("new", 1)])
    assert rows() == want
    # the same batch again, also when it was stopped between the buckets: old files gone, new ones not there yet
    put(1, [("k7", 700), ("new", 1)])
    assert rows() == want
    for part in (Path(at) / min(touched)).iterdir():
        part.unlink()
    (Path(at) / min(touched)).rmdir()
    assert len(rows()) < len(want)
    put(1, [("k7", 700), ("new", 1)])
    assert rows() == want
    # another query's first batch isn't mistaken for one that was merged before; the number of buckets stays
    put(0, [("k8", 800)], str(tmp_path / "other"))
    assert dict(rows())["k8"] == 800 and len(rows()) == 201
    assert [p.name for p in Path(at).glob("_buckets-*")] == ["_buckets-16"]


def test_an_old_table_is_read_until_all_its_buckets_are_in_place(spark, tmp_path):
    at = tmp_path / "t"
    old = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "k string, v int")
    for place in (at, at / "version=3"):
        old.write.mode("append").parquet(str(place))
    (at / "key_bucket=9").mkdir()
    (at / "key_bucket=9" / "part-0.parquet").write_bytes(b"of a first batch that was stopped")
    assert ev.current(spark, str(at)).count() == 20
    new = spark.createDataFrame([("k3", 30), ("x", 1)], old.schema)
    new.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(old.schema).parquet(str(tmp_path / "in"))
    ev.upsert_stream(stream, str(at), ["k"], lambda: [F.desc("v")], str(tmp_path / "c"), 4).awaitTermination(60)
    found = {r["k"]: r["v"] for r in ev.current(spark, str(at)).collect()}
    assert found == {**{f"k{i}": i for i in range(20)}, "k3": 30, "x": 1}
    assert not list(at.glob("version=*")) and not list(at.glob("part-*"))


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 9)
    rows = [(i, f"s{i % 2}", t0 + timedelta(minutes=i), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, symbol string, event_ts timestamp_ntz, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build_bars(stream, "symbol", "event_ts", "value").writeStream.outputMode("complete").format("memory").queryName("bars_stream").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert sorted(map(tuple, spark.table("bars_stream").collect())) == sorted(map(tuple, build_bars(df, "symbol", "event_ts", "value").collect()))
    bars = spark.createDataFrame([(f"s{i % 2}", t0 + timedelta(minutes=15 * i), float(i)) for i in range(8)], "symbol string, bar_time timestamp_ntz, close double")
    bars.write.parquet(str(tmp_path / "d1"))
    source = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "d1"))
    ev.delta_stream(source, str(tmp_path / "delta"), str(tmp_path / "c2")).awaitTermination(90)
    bars.where("close > 5").withColumn("close", F.col("close") + 100).write.mode("append").parquet(str(tmp_path / "d1"))
    ev.delta_stream(source, str(tmp_path / "delta"), str(tmp_path / "c2")).awaitTermination(90)
    assert sorted(r["close"] for r in ev.current(spark, str(tmp_path / "delta")).collect()) == [0, 1, 2, 3, 4, 5, 106, 107]


def test_a_writer_that_fails_half_way_loses_nothing(spark, tmp_path):
    t0 = datetime(2024, 1, 1, 9)
    bars = spark.createDataFrame([(f"s{i % 2}", t0 + timedelta(minutes=15 * i), float(i)) for i in range(8)], "symbol string, bar_time timestamp_ntz, close double")
    bars.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))
    last = {"upsert": lambda stream, at: ev.upsert_stream(stream, at, ["symbol"], lambda: [F.desc("bar_time")], at + "-c"), "delta": lambda stream, at: ev.delta_stream(stream, at, at + "-c")}
    for name, start in last.items():
        start(source, str(tmp_path / name)).awaitTermination(90)
    spark.createDataFrame([("s0", t0 + timedelta(minutes=15 * i), close) for i, close in ((8, 8.0), (10, 99.0))], bars.schema).write.mode("append").parquet(str(tmp_path / "in"))
    broken = source.withColumn("close", F.when(F.col("close") == 99, F.raise_error(F.lit("half-way")).cast("double")).otherwise(F.col("close")))
    want = {"upsert": ([6, 7], [7, 99]), "delta": ([0, 1, 2, 3, 4, 5, 6, 7], [0, 1, 2, 3, 4, 5, 6, 7, 8, 99])}
    for name, start in last.items():
        at = str(tmp_path / name)
        with pytest.raises(Exception, match="half-way"):
            start(broken, at).awaitTermination(90)
        (tmp_path / name / "version=1").mkdir(exist_ok=True)
        (tmp_path / name / "version=1" / "part-0.parquet").write_bytes(b"half a file")
        assert sorted(r["close"] for r in ev.current(spark, at).collect()) == want[name][0]
        start(source, at).awaitTermination(90)
        assert sorted(r["close"] for r in ev.current(spark, at).collect()) == want[name][1]


def test_alert_state_and_transitions(spark):
    t = datetime(2024, 1, 1)
    rows = [("k", i, t + timedelta(minutes=i), s) for i, s in enumerate(["open", "acknowledged", "resolved"])] + [("m", 9, t, "open"), ("m", 10, t, "acknowledged"), ("m", 11, t + timedelta(1), "open")]
    state = {r["alert_key"]: r for r in ev.alert_state(spark.createDataFrame(rows, "alert_key string, event_id long, event_ts timestamp_ntz, status string")).collect()}
    assert state["k"]["acknowledged_at"] and state["k"]["resolved_at"] and state["m"]["acknowledged_at"] is None and state["m"]["status"] == "open"
    firing = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False)], "alert_key string, firing boolean")
    was = spark.createDataFrame([("a", "open"), ("b", "acknowledged"), ("c", "acknowledged"), ("d", "resolved")], "alert_key string, status string")
    assert sorted(map(tuple, ev.evaluate_rules(firing, was).collect())) == [("b", "open"), ("c", "resolved")]


def test_failing_rows_of_rules(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "symbol string, v double")
    clean, invalid, counts = quality.validate(df, quality.load_rules([{"name": "s", "check": "symbol IS NOT NULL"}, {"name": "v", "check": "v > 0"}]), ["symbol"], [F.col("v")])
    assert clean.count() == 1 and invalid.count() == 2 and {r["rule"]: r["n"] for r in counts.collect()} == {"s": 1, "v": 1}


def test_appending_reads_only_the_batch_range(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 9)], "k string, t int")
    new = spark.createDataFrame([("a", 2), ("a", 3), ("a", 3), ("b", 4)], "k string, t int")
    for time in (None, "t"):
        assert sorted(map(tuple, merge.append_new_rows(old, new, ["k", "t"], time).collect())) == [("a", 3), ("b", 4)]
    assert merge.append_new_rows(old, new.limit(0), ["k", "t"], "t").count() == 0
    with pytest.raises(AssertionError):
        merge.append_new_rows(old, new, ["k"], "t")


def test_warnings_do_not_reject(spark):
    rules = [quality.Rule("known", "v IS NOT NULL"), quality.Rule("large", "v > 5", "warning")]
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 9)], "k string, v int")
    clean, invalid, counts = quality.validate(df, rules, ["k"], [F.col("v")])
    assert sorted(r["k"] for r in clean.collect()) == ["a", "c"] and [r["k"] for r in invalid.collect()] == ["b"]
    assert {r["rule"]: r["n"] for r in counts.collect()} == {"known": 1, "large": 2}
    assert sorted(map(tuple, quality.severity_report(df.limit(0), rules).collect())) == [("known", "error", 0), ("large", "warning", 0)]


def test_signals_of_a_bare_row(spark):
    """Missing numbers count as 0 and missing states as unknown; what cannot be sold is blocked."""
    names = "liquidity_state ta_action_bias trend_state market_regime data_quality_status risk_level ta_risk_flag".split()
    numbers = "suggested_weight score rsi_14 macd_histogram relative_strength_20d traded_value_cross_section_percentile drawdown_from_peak ta_composite_score atr_pct_14 sellable".split()
    df = spark.createDataFrame([("a", 1, "SELL", *[None] * 17), ("b", 1, "WATCH", *[None] * 17)], ", ".join(["symbol string", "trading_date int", "action string", *[f"{c} string" for c in names], *[f"{c} double" for c in numbers]]))
    said = {(r["symbol"], r["signal"]): r["verdict"] for r in scoring.decision_signals(df).collect()}
    assert said["a", "decision"] == "risk" and said["a", "settlement"] == "blocked" and ("b", "settlement") not in said
    assert said["b", "decision"] == "neutral" and said["b", "rsi_14"] == "bearish" and said["b", "market_regime"] == "blocked" and said["b", "liquidity"] == "risk"


def test_symbols_of_interest(spark):
    rows = [("a", 0.0, "watch", 0.5, 0.5), ("b", 0.3, "candidate_long", 0.9, 0.5), ("c", 0.0, "avoid_or_reduce", 0.1, 0.5), ("d", 0.0, "blocked_data_quality", 0.05, 0.5)]
    df = spark.createDataFrame([(1, *r) for r in rows], "trading_date int, symbol string, suggested_weight double, recommendation string, score double, confidence double")
    listed = lambda **kw: [r["symbol"] for r in scoring.signal_symbols(df, **kw).orderBy("place").collect()]
    assert listed() == ["b", "a", "d", "c"] and listed(limit=3) == ["b", "a", "d"] and listed(n=1) == ["b", "d"]


def test_metrics_from_initial_cash(spark):
    nav = spark.createDataFrame([(1, 1, 110.0, 0.0, 0.2, ["x"], ["x", "y"]), (1, 2, 121.0, 0.0, 0.1, [], [])], "run_id int, trade_date int, nav double, market_value double, turnover double, a array<string>, b array<string>")
    got = aggregates.nav_metrics(aggregates.nav_series(nav, choices=("a", "b")), initial_cash=100.0).first()
    assert got["total_return"] == pytest.approx(0.21) and got["turnover"] == pytest.approx(0.3) and got["mean_agreement"] == pytest.approx(0.75)
