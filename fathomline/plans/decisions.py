"""Queries over decisions and what explains them, agreement of choices, and reconciliation of stored tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import merge, quality
from ..operators import scoring as sc
from ..session import table
from . import features as ft
from . import fixtures as fx
from .common import r, rounded
from .fixtures import ctes
from .relational import COMPACTED
from .selection import _CX, _CXD, _SRC, OVERLAY, SCORE, overlay, scored

_MORE = ["liquidity_state", "ta_action_bias", "macd_histogram", "atr_pct_14"]
_DOUBLES = [*_CXD, "macd_histogram", "atr_pct_14"]


def decided(s: SparkSession, d: str) -> DataFrame:
    """Weighted recommendations with all context columns, holdings and actions made from the symbol's number."""
    rows = sc.portfolio_overlay(sc.score_context(rounded(ft.context(s, d).select(*_CX, *_MORE))))
    sellable = F.regexp_extract("symbol", r"(\d+)$", 1).cast("int") % 3 * 100
    sells = F.col("recommendation").isin("avoid_or_reduce", "blocked_data_quality")
    action = F.when(F.col("recommendation") == "candidate_long", "BUY").when(sells & (F.dayofmonth("trading_date") % 2 == 0), "HOLD_LOCKED").when(sells, "SELL").otherwise("WATCH")
    return rows.withColumns({"sellable": sellable, "action": action})


def signals(s: SparkSession, d: str) -> DataFrame:
    return rounded(sc.decision_signals(decided(s, d)))


_WIDE = {**ft.CONTEXT_CTES, "c": "SELECT " + ", ".join(r(c) if c in _DOUBLES else c for c in (*_CX, *_MORE)) + " FROM cx", "sc": SCORE, "ov": OVERLAY}
_WIDE["dc"] = """SELECT *, CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INT) % 3 * 100 AS sellable, CASE WHEN recommendation = 'candidate_long' THEN 'BUY'
  WHEN recommendation IN ('avoid_or_reduce', 'blocked_data_quality') THEN CASE WHEN day(trading_date) % 2 = 0 THEN 'HOLD_LOCKED' ELSE 'SELL' END ELSE 'WATCH' END AS action FROM ov"""
#: Signal, what it says and its value, as SQL.
_SAID = {
    "decision": (
        "CASE WHEN action IN ('BUY', 'HOLD') AND (coalesce(suggested_weight, 0) > 0 OR coalesce(ta_action_bias = 'bullish', false) OR coalesce(trend_state = 'uptrend', false)) THEN 'bullish' WHEN action IN ('SELL', 'TRIM') AND sellable <= 0 THEN 'risk' WHEN action IN ('SELL', 'TRIM') THEN 'bearish' ELSE 'neutral' END",
        "score",
    ),
    "trend": ("CASE trend_state WHEN 'uptrend' THEN 'bullish' WHEN 'downtrend' THEN 'bearish' ELSE 'neutral' END", None),
    "rsi_14": ("CASE WHEN coalesce(rsi_14, 0) >= 70 THEN 'risk' WHEN coalesce(rsi_14, 0) <= 30 THEN 'bearish' WHEN rsi_14 >= 55 THEN 'bullish' ELSE 'neutral' END", "rsi_14"),
    "macd_histogram": ("CASE WHEN macd_histogram > 0 THEN 'bullish' WHEN macd_histogram < 0 THEN 'bearish' ELSE 'neutral' END", "macd_histogram"),
    "relative_strength_20d": ("CASE WHEN relative_strength_20d > 0.02 THEN 'bullish' WHEN relative_strength_20d < -0.02 THEN 'bearish' ELSE 'neutral' END", "relative_strength_20d"),
    "liquidity": ("CASE liquidity_state WHEN 'high_liquidity' THEN 'bullish' WHEN 'normal_liquidity' THEN 'neutral' ELSE 'risk' END", "traded_value_cross_section_percentile"),
    "risk": ("CASE WHEN risk_level = 'high' OR ta_risk_flag = 'high' OR atr_pct_14 > 0.04 OR drawdown_from_peak < -0.15 THEN 'risk' ELSE 'neutral' END", "drawdown_from_peak"),
    "ta_composite": ("CASE ta_action_bias WHEN 'bullish' THEN 'bullish' WHEN 'bearish' THEN 'bearish' ELSE 'neutral' END", "ta_composite_score"),
    "optimizer": ("CASE WHEN suggested_weight > 0 THEN 'bullish' ELSE 'neutral' END", "suggested_weight"),
    "market_regime": ("CASE WHEN coalesce(data_quality_status, 'unknown') <> 'pass' THEN 'blocked' WHEN market_regime IN ('bullish', 'bearish') THEN market_regime ELSE 'neutral' END", None),
    "settlement": ("CASE WHEN action IN ('SELL', 'TRIM', 'HOLD_LOCKED') THEN CASE WHEN sellable <= 0 THEN 'blocked' ELSE 'neutral' END END", "sellable"),
}
_ROWS = " UNION ALL ".join(f"SELECT symbol, trading_date, '{name}' AS signal, {said} AS verdict, {f'CAST(coalesce({value}, 0) AS DOUBLE)' if value else 'CAST(NULL AS DOUBLE)'} AS value FROM dc" for name, (said, value) in _SAID.items())
SIGNALS = ctes(*_SRC, **_WIDE) + f"SELECT symbol, trading_date, signal, verdict, {r('value')} FROM ({_ROWS}) WHERE verdict IS NOT NULL"

_NARROW = {**ft.CONTEXT_CTES, "c": "SELECT " + ", ".join(r(c) if c in _CXD else c for c in _CX) + " FROM cx", "sc": SCORE}
_LISTS = """SELECT trading_date, symbol, 1 AS list_rank, -suggested_weight AS k1, -score AS k2 FROM ov WHERE suggested_weight > 0
  UNION ALL SELECT trading_date, symbol, 2, -score, -confidence FROM ov WHERE recommendation IN ('candidate_long', 'watch')
  UNION ALL SELECT trading_date, symbol, 3, score, confidence FROM ov WHERE recommendation IN ('avoid_or_reduce', 'blocked_data_quality')"""
SYMBOLS = ctes(*_SRC, **_NARROW, ov=OVERLAY, ls=_LISTS) + """SELECT trading_date, symbol, list_rank, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY list_rank, nth) AS place FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trading_date, list_rank ORDER BY k1, k2, symbol) AS nth FROM ls) WHERE nth <= 10 QUALIFY row_number() OVER (PARTITION BY trading_date, symbol ORDER BY list_rank) = 1)) WHERE place <= 15"""


def rationale(s: SparkSession, d: str) -> DataFrame:
    """What the stored reasons of a score say, read back from their JSON, where numbers have four digits."""
    why = lambda field: F.get_json_object("rationale_json", f"$.{field}")
    return rounded(scored(s, d).select("symbol", "trading_date", why("market").cast("double").alias("market"), why("symbol").cast("double").alias("own"), why("quality").alias("quality"), why("risk_level").alias("risk_level")), 5)


RATIONALE = ctes(*_SRC, **_NARROW) + f"SELECT symbol, trading_date, {r('market own', 5)}, quality, risk_level FROM (SELECT symbol, trading_date, round(mk + 1e-9, 4) AS market, round(sy + 1e-9, 4) AS own, coalesce(data_quality_status, 'missing') AS quality, risk_level FROM sc)"


def nav(s: SparkSession, d: str) -> DataFrame:
    """Daily values of five runs with their turnover, and which priorities open and finished orders have."""
    o = table(s, d, "orders")
    of = lambda status: F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))
    daily = o.groupBy((F.col("o_custkey") % 5).alias("run_id"), F.to_date("o_orderdate").alias("trade_date")).agg(F.sum("o_totalprice").alias("v"), of("F").alias("a"), of("O").alias("b"))
    return daily.select("run_id", "trade_date", (1e6 + F.col("v") / 1000).alias("nav"), (F.col("v") / 1000).alias("market_value"), (F.col("v") / 1e6).alias("turnover"), "a", "b")


def agreement(s: SparkSession, d: str) -> DataFrame:
    made = agg.nav_metrics(agg.nav_series(nav(s, d), choices=("a", "b")), initial_cash=1e6)
    return rounded(made.select("run_id", "n", "total_return", "annualised_return", "turnover", "mean_agreement"), 5)


AGREEMENT = f"""WITH pr AS (SELECT o_custkey % 5 AS run_id, CAST(o_orderdate AS DATE) AS trade_date, o_orderpriority, sum(o_totalprice) AS v, bool_or(o_orderstatus = 'F') AS a, bool_or(o_orderstatus = 'O') AS b FROM orders GROUP BY ALL),
  nav AS (SELECT run_id, trade_date, 1e6 + sum(v) / 1000 AS nav, sum(v) / 1e6 AS turnover, CASE WHEN bool_or(a OR b) THEN count(*) FILTER (WHERE a AND b)::DOUBLE / count(*) FILTER (WHERE a OR b) ELSE 1.0 END AS agreement FROM pr GROUP BY ALL)
  SELECT run_id, n, {r('total_return annualised_return turnover mean_agreement', 5)} FROM (SELECT run_id, n, l / 1e6 - 1 AS total_return, power(l / 1e6, 252.0 / n) - 1 AS annualised_return, turnover, mean_agreement FROM (
    SELECT run_id, count(*) AS n, arg_max(nav, trade_date) AS l, sum(turnover) AS turnover, avg(agreement) AS mean_agreement FROM nav GROUP BY run_id))"""

_GRACE = "(SELECT as_of FROM upto) - max(trading_date)"


def expected_manifest(s: SparkSession, d: str) -> DataFrame:
    """Coverage of the universe's symbols; those that a filter leaves without bars are empty."""
    bars = fx.bars(s, d)
    return quality.build_manifest(bars.where("symbol NOT LIKE 'Brand#1%'"), "daily", fx.as_of(bars), expected=fx.universe(s, d))


EXPECTED = ctes("bars", "upto", "uni") + f"""SELECT 'daily' AS dataset_name, symbol, min(trading_date) AS coverage_start, max(trading_date) AS coverage_end, count(trading_date) AS row_count, false AS needs_merge,
  CASE WHEN count(trading_date) = 0 THEN 'empty' WHEN {_GRACE} <= 0 THEN 'up_to_date' WHEN {_GRACE} <= 3 THEN 'awaiting_refresh_window' ELSE 'stale' END AS update_status
  FROM (SELECT DISTINCT symbol FROM uni) LEFT JOIN (SELECT symbol, trading_date FROM bars WHERE symbol NOT LIKE 'Brand#1%') USING (symbol) GROUP BY symbol"""


def intraday_integrity(s: SparkSession, d: str) -> DataFrame:
    """Counts over bars of which some are moved off the grid or filed under another session."""
    hour = F.hour("bar_time")
    bars = fx.intraday(s, d).withColumns({"session_date": F.when(hour == 5, F.date_add("session_date", 1)).otherwise(F.col("session_date")), "bar_time": F.when(hour == 7, F.col("bar_time") + F.expr("INTERVAL '1' MINUTE")).otherwise(F.col("bar_time"))})
    return quality.integrity_metrics(bars, ["symbol", "bar_time"], "bar_time", True)


INTRADAY = ctes("intra") + """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS null_rows, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS non_positive_rows, CAST(0 AS BIGINT) AS negative_volume_rows,
  count(*) FILTER (WHERE high < greatest(open, low, close) OR low > least(open, high, close)) AS bad_bounds_rows, count(*) FILTER (WHERE hour(bar_time) = 7) AS off_grid_rows, count(*) FILTER (WHERE hour(bar_time) = 5) AS session_mismatch_rows FROM intra"""


def reconciled(s: SparkSession, d: str) -> DataFrame:
    """Coverage of the compacted table with the version that it leads to."""
    state = s.createDataFrame([("intraday", 4, None, "r0"), ("daily", 2, None, "r0")], "dataset_name string, version bigint, latest_data_ts timestamp_ntz, run_id string")
    _, rest, manifest, after = merge.eod_reconcile(fx.base(s, d), fx.delta(s, d), state, F.lit(date(2024, 1, 26)), "intraday", "r1", 20)
    left = rest.groupBy("symbol").agg(F.count("*").alias("still_open"))
    return manifest.join(after, "dataset_name").join(left, "symbol", "left").select("symbol", "coverage_start", "coverage_end", "row_count", "version", "run_id", (F.col("latest_data_ts") >= F.col("coverage_end")).alias("covers"), F.coalesce("still_open", F.lit(0)).alias("still_open"))


RECONCILED = f"""WITH merged AS ({COMPACTED}), rest AS ({ctes('delta')} SELECT symbol, count(*) AS still_open FROM delta WHERE session_date > DATE '2024-01-26' GROUP BY symbol)
  SELECT symbol, min(bar_time) AS coverage_start, max(bar_time) AS coverage_end, count(*) AS row_count, CAST(5 AS BIGINT) AS version, 'r1' AS run_id, true AS covers, coalesce(any_value(still_open), 0) AS still_open FROM merged LEFT JOIN rest USING (symbol) GROUP BY symbol"""


def appended(s: SparkSession, d: str) -> DataFrame:
    """Delta bars that are not stored yet, looked for only among stored bars of the delta's time range."""
    return merge.append_new_rows(fx.base(s, d), fx.delta(s, d), ["symbol", "bar_time"], "bar_time").select("symbol", "bar_time")


APPENDED = ctes("base", "delta") + "SELECT symbol, bar_time FROM delta EXCEPT SELECT symbol, bar_time FROM base"

RULES = [*quality.OHLCV_RULES, quality.Rule("thin_day", "volume >= 100", "warning"), quality.Rule("known_source", "source IN ('a', 'b', 'c')", "warning")]


def severities(s: SparkSession, d: str) -> DataFrame:
    """Failing rows of each rule, and, as a rule of its own, rows that pass though they earn warnings."""
    bars = fx.bars(s, d)
    rows = fx.raw(s, d).join(F.broadcast(fx.as_of(bars)), F.lit(True))
    clean, _, _ = quality.validate(rows, RULES, ["symbol", "trading_date"], [F.col("source")])
    passed = clean.agg(F.count_if(F.col("volume") < 100).alias("n")).select(F.lit("clean_with_warning").alias("rule"), F.lit("info").alias("severity"), "n")
    return quality.severity_report(rows, RULES).unionByName(passed)


_CHECKS = {
    "symbol_present": "symbol IS NOT NULL", "positive_prices": "least(open, high, low, close) > 0", "ohlc_bounds": "high >= greatest(open, low, close) AND low <= least(open, high, close)", "volume_not_negative": "volume >= 0",
    "not_in_future": "trading_date <= (SELECT as_of FROM upto)", "thin_day": "volume >= 100", "known_source": "source IN ('a', 'b', 'c')",
}
_GOOD = " AND ".join(f"coalesce({c}, false)" for n, c in _CHECKS.items() if n not in ("thin_day", "known_source"))
SEVERITIES = ctes("raw", "upto") + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{'warning' if n in ('thin_day', 'known_source') else 'error'}' AS severity, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n FROM raw" for n, c in _CHECKS.items())
SEVERITIES += f" UNION ALL SELECT 'clean_with_warning', 'info', count(*) FILTER (WHERE volume < 100) FROM (SELECT volume FROM raw WHERE {_GOOD} QUALIFY row_number() OVER (PARTITION BY symbol, trading_date ORDER BY source) = 1)"

QUERIES = {
    "decision_signals": signals, "signal_symbols": lambda s, d: sc.signal_symbols(overlay(s, d)), "signal_rationale": rationale, "nav_agreement": agreement, "expected_manifest": expected_manifest, "integrity_intraday": intraday_integrity, "eod_reconcile": reconciled,
    "append_in_range": appended, "rule_severities": severities,
}
ORACLES = {
    "decision_signals": SIGNALS, "signal_symbols": SYMBOLS, "signal_rationale": RATIONALE, "nav_agreement": AGREEMENT, "expected_manifest": EXPECTED, "integrity_intraday": INTRADAY, "eod_reconcile": RECONCILED,
    "append_in_range": APPENDED, "rule_severities": SEVERITIES,
}
