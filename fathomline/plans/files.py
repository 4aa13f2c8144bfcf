"""Queries that write derived tables as files and read them again: JSON lines, files by key, texts of vendors."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as src
from ..sources.key_files import write_key_files
from ..sources.shared import shared_dir
from . import fixtures as fx
from .common import r, rounded
from .fixtures import ctes


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/fathomline-{name}-{uuid.uuid4().hex}"


def event_lines(s: SparkSession, d: str) -> DataFrame:
    """The event log as JSON lines and back: every 13th line is cut short, every 11th lacks its type."""
    log = fx.event_log(s, d)
    event = F.struct(F.col("event_id").cast("string").alias("event_id"), F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), "status", "symbol")
    text = F.to_json(event)
    path = _folder(s, "lines")
    log.select(F.when(F.col("event_id") % 13 == 0, F.left(text, F.length(text) - 1)).otherwise(text).alias("value")).write.text(path)
    good, dead = src.read_events(s, path)
    kept = good.select("event_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), "event_type", F.lit(None).cast("string").alias("error"))
    lost = dead.where("line > 0").select(F.regexp_extract("raw_line", r'"event_id":"(\d+)"', 1).alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("event_ts"), F.lit(None).cast("string").alias("event_type"), "error")
    return kept.unionByName(lost)


EVENT_LINES = ctes("elog") + """SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN error IS NULL THEN event_ts END AS event_ts, CASE WHEN error IS NULL THEN event_type END AS event_type, error
  FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'not a JSON object' WHEN event_id % 11 = 0 THEN 'missing event_type' END AS error FROM elog)"""


def key_files(s: SparkSession, d: str) -> DataFrame:
    """Bars by symbol in files, written on one day with other prices and on the next as they are."""
    path = _folder(s, "keys")
    bars = fx.bars(s, d)
    write_key_files(bars.withColumn("close", F.col("close") + 1), path, "symbol", "trading_date", date(2024, 1, 1))
    write_key_files(bars, path, "symbol", "trading_date", date(2024, 1, 2))
    return rounded(s.read.schema(bars.schema).parquet(path))


KEY_FILES = ctes("bars") + f"SELECT symbol, trading_date, {r('open high low close volume')} FROM bars"


def holdings(s: SparkSession, d: str) -> DataFrame:
    """Orders as a table of texts under other column names; every tenth without symbol, every 17th without number."""
    o = fx.ledger(s, d)
    texts = o.select(
        F.when(F.col("order_id") % 10 == 0, " ").otherwise(F.concat(F.lit(" "), F.lower("symbol"))).alias("Ticker"),
        F.when(F.col("order_id") % 17 == 0, "x").otherwise(F.format_number(F.col("quantity") * 13 + 50, 0)).alias(" QTY"),
        F.col("price").cast("string").alias("Cost"),
    )
    return rounded(src.read_holdings(texts))


HOLDINGS = ctes("ledger") + f"""SELECT symbol, CAST(quantity AS BIGINT) AS quantity, {r('avg_cost')}
  FROM (SELECT symbol, (quantity * 13 + 50) // 100 * 100 AS quantity, CASE WHEN price < 1000 THEN price * 1000 ELSE price END AS avg_cost FROM ledger WHERE order_id % 10 <> 0 AND order_id % 17 <> 0 AND price > 0)"""


def legacy(s: SparkSession, d: str) -> DataFrame:
    """Bars as a vendor's texts: day first, thousands with commas, volume in two columns of which one is often empty."""
    b, third = fx.bars(s, d), F.dayofmonth("trading_date") % 3 == 0
    texts = b.select(
        "symbol", F.date_format("trading_date", "dd/MM/yyyy").alias("date"), *[F.format_number(c, 2).alias(c) for c in src.PRICES],
        F.format_number("volume", 2).alias("matched_volume"), F.when(third, F.format_number(F.col("volume") * 1000, 2)).otherwise("-").alias("negotiated_volume"),
    )
    return rounded(src.standardize_legacy(texts, "made"))


LEGACY = ctes("bars") + f"""SELECT symbol, trading_date, {r('open high low close volume')}, 'made' AS source
  FROM (SELECT symbol, trading_date, open, high, low, close, CASE WHEN day(trading_date) % 3 = 0 THEN volume * 1001 ELSE volume END AS volume FROM bars)"""

QUERIES = {"event_lines": event_lines, "key_files": key_files, "holdings": holdings, "standardize_legacy": legacy}
ORACLES = {"event_lines": EVENT_LINES, "key_files": KEY_FILES, "holdings": HOLDINGS, "standardize_legacy": LEGACY}
