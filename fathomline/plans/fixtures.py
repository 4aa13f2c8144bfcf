"""Bars, universes, ledgers and event logs derived from the given tables, for Spark and as DuckDB CTEs."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources.shared import stored

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
CORE = [f"Brand#{i}" for i in range(1, 11)]
DELTA_FROM = date(2024, 1, 25)

_BARS = """SELECT symbol, trading_date, max(CASE WHEN seq = 1 THEN px END) AS open, max(px) AS high, min(px) AS low, max(CASE WHEN seq = n THEN px END) AS close, sum(qty) AS volume
  FROM (SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS trading_date, p_retailprice AS px, l_quantity AS qty,
          row_number() OVER (PARTITION BY {symbol}, CAST(l_shipdate AS DATE) ORDER BY {order}) AS seq, count(*) OVER (PARTITION BY {symbol}, CAST(l_shipdate AS DATE)) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey {where}) t GROUP BY symbol, trading_date"""

#: Common table expressions for the DuckDB side, in order of use.
CTES = {
    "bars": _BARS.format(symbol="p_brand", order=_ORDER, where=""),
    "idx": _BARS.format(symbol="'IDX_ALL'", order=_ORDER, where="") + " UNION ALL " + _BARS.format(symbol="'IDX_CORE'", order=_ORDER, where="WHERE p_brand IN (" + ", ".join(f"'{b}'" for b in CORE) + ")"),
    "upto": "SELECT max(trading_date) AS as_of FROM bars",
    "uni": "SELECT DISTINCT 'CORE' AS universe_name, p_brand AS symbol, CASE WHEN p_brand IN ('Brand#23', 'Brand#24', 'Brand#25') THEN (SELECT as_of FROM upto) - 30 WHEN p_brand = 'Brand#22' THEN (SELECT as_of FROM upto) + 30 END AS end_date FROM part",
    "intra": "SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS bar_time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(time_bucket(INTERVAL 15 MINUTE, ts) AS DATE) AS session_date FROM events GROUP BY ALL",
    "base": "SELECT * FROM intra WHERE session_date < DATE '2024-01-25'",
    "delta": "SELECT symbol, bar_time, open, high, low, close + 1 AS close, volume, session_date FROM intra WHERE session_date >= DATE '2024-01-24'",
    "raw": """SELECT symbol, trading_date, open, high, low, close, volume, 'a' AS source FROM bars
      UNION ALL SELECT symbol, trading_date, open + 1, high + 1, low + 1, close + 1, volume, 'b' FROM bars WHERE day(trading_date) % 7 = 0
      UNION ALL SELECT symbol, trading_date, open, high, low, close, -volume, 'c' FROM bars WHERE day(trading_date) = 1
      UNION ALL SELECT symbol, trading_date, open, low - 1, high, close, volume, 'c' FROM bars WHERE day(trading_date) = 2
      UNION ALL SELECT NULL, trading_date, open, high, low, close, volume, 'c' FROM bars WHERE day(trading_date) = 3
      UNION ALL SELECT symbol, trading_date, 0.0, high, low, close, volume, 'c' FROM bars WHERE day(trading_date) = 4
      UNION ALL SELECT symbol, trading_date + 10000, open, high, low, close, volume, 'c' FROM bars WHERE day(trading_date) = 5""",
    "ledger": "SELECT o_orderkey AS order_id, o_custkey % 50 AS account_id, 'S' || CAST(o_custkey % 9 AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 3 <> 0 THEN 'BUY' ELSE 'SELL' END AS action, 100 * (1 + o_orderkey % 9) AS quantity, round(o_totalprice / 1000 + 1e-9, 2) AS price, CAST(o_orderdate AS DATE) AS trade_date FROM orders",
    "elog": """SELECT event_id, ts AS event_ts, CASE event_type WHEN 'error' THEN 'pipeline_run' WHEN 'click' THEN 'source_request' WHEN 'view' THEN 'checkpoint_updated' WHEN 'signup' THEN 'scheduler_heartbeat' ELSE 'alert_state_change' END AS event_type,
      CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, 'U' || CAST(user_id % 30 AS VARCHAR) AS symbol, value, props AS payload_json FROM events""",
}
_NEEDS = {"idx": [], "upto": ["bars"], "uni": ["bars", "upto"], "base": ["intra"], "delta": ["intra"], "raw": ["bars"]}


def ctes(*names: str, **more: str) -> str:
    """WITH clause of the named CTEs, what they need, and more of one's own."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join([f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]) + "\n"


def _build(ticks: DataFrame, **more: Column) -> DataFrame:
    """First and last prices by the ticks' order, in one aggregation, with more of one's own."""
    order = F.struct(*_ORDER.split(", "))
    return ticks.groupBy("symbol", "trading_date").agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume"), *[c.alias(name) for name, c in more.items()])


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("p_brand", F.to_date("l_shipdate").alias("trading_date"), F.col("p_retailprice").alias("px"), *_ORDER.split(", "))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return _build(_ticks(spark, sf).withColumn("symbol", F.col("p_brand")))


def index_bars(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.when(F.col("p_brand").isin(CORE), F.array(F.lit("IDX_ALL"), F.lit("IDX_CORE"))).otherwise(F.array(F.lit("IDX_ALL")))
    return _build(_ticks(spark, sf).withColumn("symbol", F.explode(marked)))


class Market(NamedTuple):
    """Daily bars of the symbols and of the indexes over them, as read from a written table."""

    daily: DataFrame
    index: DataFrame


def market(spark: SparkSession, sf: str) -> Market:
    """Bars and index bars from one pass over the ticks: a row a symbol and date is written, with the places of its first
    and last ticks, by which the indexes' first and last prices are found."""
    order = F.struct(*_ORDER.split(", "))
    ticks = _ticks(spark, sf).withColumn("symbol", F.col("p_brand"))
    made = _build(ticks, first=F.min(order), last=F.max(order))
    held = stored(made, "bars")
    marked = F.when(F.col("symbol").isin(CORE), F.array(F.lit("IDX_ALL"), F.lit("IDX_CORE"))).otherwise(F.array(F.lit("IDX_ALL")))
    index = held.withColumn("symbol", F.explode(marked)).groupBy("symbol", "trading_date").agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("volume").alias("volume"),
    )
    return Market(held.drop("first", "last"), index)


def as_of(frame: DataFrame) -> DataFrame:
    """One row."""
    return frame.agg(F.max("trading_date").alias("as_of"))


def universe(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    last = F.broadcast(as_of(bars(spark, sf) if daily is None else daily))
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).distinct()
    ended = F.when(F.col("symbol").isin("Brand#23", "Brand#24", "Brand#25"), F.date_sub("as_of", 30)).when(F.col("symbol") == "Brand#22", F.date_add("as_of", 30))
    return brands.join(last, F.lit(True)).select(F.lit("CORE").alias("universe_name"), "symbol", ended.alias("end_date"))


def intraday(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.bars import build_bars

    made = build_bars(table(spark, sf, "events"), "event_type", "ts", "value", every="15 minutes")
    return made.withColumnRenamed("event_type", "symbol").withColumn("session_date", F.to_date("bar_time"))


def base(spark: SparkSession, sf: str) -> DataFrame:
    return intraday(spark, sf).where(F.col("session_date") < F.lit(DELTA_FROM))


def delta(spark: SparkSession, sf: str) -> DataFrame:
    return intraday(spark, sf).where(F.col("session_date") >= F.date_sub(F.lit(DELTA_FROM), 1)).withColumn("close", F.col("close") + 1)


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of row is made from a bar in one pass, instead of reading the bars once for each kind."""
    b = bars(spark, sf)
    day = F.dayofmonth("trading_date")

    def row(source: str, **changed):
        cols = {c: F.col(c) for c in ("symbol", "trading_date", "open", "high", "low", "close", "volume")} | changed
        return F.struct(*[v.alias(k) for k, v in cols.items()], F.lit(source).alias("source"))

    kinds = F.array(
        row("a"),
        F.when(day % 7 == 0, row("b", **{c: F.col(c) + 1 for c in ("open", "high", "low", "close")})),
        F.when(day == 1, row("c", volume=-F.col("volume"))),
        F.when(day == 2, row("c", high=F.col("low") - 1, low=F.col("high"))),
        F.when(day == 3, row("c", symbol=F.lit(None).cast("string"))),
        F.when(day == 4, row("c", open=F.lit(0.0))),
        F.when(day == 5, row("c", trading_date=F.date_add("trading_date", 10000))),
    )
    return b.select(F.explode(F.array_compact(kinds)).alias("r")).select("r.*")


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 50).alias("account_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 9).cast("string")).alias("symbol"),
        F.when(F.col("o_orderkey") % 3 != 0, "BUY").otherwise("SELL").alias("action"), (100 * (1 + F.col("o_orderkey") % 9)).alias("quantity"),
        F.round(F.col("o_totalprice") / 1000 + F.lit(1e-9), 2).alias("price"), F.to_date("o_orderdate").alias("trade_date"),
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    mapped = F.when(kind == "error", "pipeline_run").when(kind == "click", "source_request").when(kind == "view", "checkpoint_updated").when(kind == "signup", "scheduler_heartbeat").otherwise("alert_state_change")
    return e.select("event_id", F.col("ts").alias("event_ts"), mapped.alias("event_type"), F.when(kind == "error", "failed").otherwise("ok").alias("status"), F.concat(F.lit("U"), (F.col("user_id") % 30).cast("string")).alias("symbol"), "value", F.col("props").alias("payload_json"))
