"""Queries of the model layer: returns, liquidity, breadth, sessions, regimes, signals, quality and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators_mart as mart
from ..operators import marts
from . import fixtures as fx
from .common import r, rounded
from .fixtures import ctes

W = "(PARTITION BY symbol ORDER BY trading_date)"


def W_(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def returns_sql(source: str) -> str:
    return f"""SELECT *, stddev_samp(log_return_1d) OVER {W_(20)} AS volatility_20d, stddev_samp(log_return_1d) OVER {W_(60)} AS volatility_60d FROM (
      SELECT symbol, trading_date, open, high, low, close, volume, {", ".join(f"close / nullif(lag(close, {n}) OVER {W}, 0) - 1 AS return_{n}d" for n in (1, 5, 20, 60))},
        CASE WHEN close / nullif(lag(close) OVER {W}, 0) > 0 THEN ln(close / nullif(lag(close) OVER {W}, 0)) END AS log_return_1d,
        {", ".join(f"avg(close) OVER {W_(n)} AS sma_{n}" for n in (20, 50, 200))},
        close / nullif(max(close) OVER (PARTITION BY symbol ORDER BY trading_date ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown_from_peak FROM {source})"""


LIQUIDITY = f"""SELECT symbol, trading_date, volume, close * volume AS traded_value_proxy, avg(volume) OVER {W_(20)} AS avg_volume_20d, avg(volume) OVER {W_(60)} AS avg_volume_60d,
  volume / nullif(avg(volume) OVER {W_(20)}, 0) AS volume_to_avg_20d, percent_rank() OVER (PARTITION BY trading_date ORDER BY volume NULLS FIRST) AS volume_cross_section_percentile,
  percent_rank() OVER (PARTITION BY trading_date ORDER BY close * volume NULLS FIRST) AS traded_value_cross_section_percentile FROM bars"""
BREADTH = f"""SELECT *, advancers / nullif(active_symbols, 0)::DOUBLE AS advancer_ratio, decliners / nullif(active_symbols, 0)::DOUBLE AS decliner_ratio, (advancers - decliners) / nullif(active_symbols, 0)::DOUBLE AS breadth_score FROM (
  SELECT trading_date, count(*) AS active_symbols, count(*) FILTER (WHERE close > prev) AS advancers, count(*) FILTER (WHERE close < prev) AS decliners, count(*) FILTER (WHERE close = prev) AS unchanged, sum(volume) AS constituent_volume,
    avg(close / nullif(prev, 0) - 1) AS avg_constituent_return_1d FROM (SELECT *, lag(close) OVER {W} AS prev FROM bars) GROUP BY trading_date)"""
SESSIONS = """SELECT symbol, session_date AS trading_date, min(bar_time) AS first_bar_time, max(bar_time) AS last_bar_time, count(*) AS bar_count, arg_min(open, bar_time) AS session_open, max(high) AS session_high, min(low) AS session_low,
  arg_max(close, bar_time) AS session_close, sum(volume) AS session_volume, (max(high) - min(low)) / nullif(arg_max(close, bar_time), 0) AS session_range_pct, arg_max(close, bar_time) / nullif(arg_min(open, bar_time), 0) - 1 AS session_return
  FROM intra GROUP BY symbol, session_date"""
REGIME = f"""SELECT *, CASE market_regime WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END + coalesce(breadth_score, 0) + CASE WHEN second_return_20d > main_return_20d THEN 0.25 ELSE -0.25 END AS regime_score FROM (
  SELECT *, CASE WHEN main_close - main_sma_50 > 1e-9 AND main_sma_50 - main_sma_200 > 1e-9 AND coalesce(breadth_score, 0) >= 0.10 THEN 'bullish' WHEN main_sma_50 - main_close > 1e-9 AND main_sma_200 - main_sma_50 > 1e-9 AND coalesce(breadth_score, 0) <= -0.10 THEN 'bearish' ELSE 'neutral' END AS market_regime,
    CASE WHEN main_volatility_20d > 1.35 * nullif(volatility_avg_252, 0) THEN 'high_volatility' WHEN main_volatility_20d < 0.75 * nullif(volatility_avg_252, 0) THEN 'low_volatility' ELSE 'normal_volatility' END AS volatility_regime FROM (
    SELECT p.*, active_symbols, advancers, decliners, advancer_ratio, breadth_score, constituent_volume, avg(main_volatility_20d) OVER (ORDER BY p.trading_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS volatility_avg_252 FROM (
      SELECT trading_date, {", ".join(f"max(CASE WHEN symbol = '{s}' THEN {c} END) AS {p}_{c}" for p, s in (("main", "IDX_ALL"), ("second", "IDX_CORE")) for c in ("close", "return_1d", "return_20d", "sma_20", "sma_50", "sma_200", "volatility_20d"))} FROM ir GROUP BY trading_date) p LEFT JOIN br USING (trading_date)))"""

EMA = """SELECT c.symbol, c.trading_date, {cols} FROM (SELECT *, row_number() OVER {w} AS rn FROM bars) c JOIN (SELECT *, row_number() OVER {w} AS rn FROM bars) p ON c.symbol = p.symbol AND p.rn BETWEEN c.rn - 200 AND c.rn GROUP BY c.symbol, c.trading_date""".format(
    w=W,
    cols=", ".join(
        f"sum(CASE WHEN c.rn - p.rn <= {min(200, 4 * n)} THEN p.close * power(1 - 2.0 / {n + 1}, c.rn - p.rn) END) / sum(CASE WHEN c.rn - p.rn <= {min(200, 4 * n)} THEN power(1 - 2.0 / {n + 1}, c.rn - p.rn) END) AS ema_{n}" for n in (12, 20, 26, 50)
    ),
)
TA1 = f"""SELECT m.*, ema_12, ema_20, ema_26, ema_50, ema_12 - ema_26 AS macd, {", ".join(f"avg(close) OVER {W_(n)} AS sma_{n}" for n in (20, 50, 100, 200))}, stddev_samp(close) OVER {W_(20)} AS close_std_20, min(low) OVER {W_(14)} AS low_14,
  max(high) OVER {W_(14)} AS high_14, avg(volume) OVER {W_(20)} AS avg_volume_20, stddev_samp(volume) OVER {W_(20)} AS volume_std_20, max(close) OVER {W_(252)} AS high_close_252, stddev_samp(log_return_1d) OVER {W_(20)} AS realized_volatility_20d,
  stddev_samp(log_return_1d) OVER {W_(60)} AS realized_volatility_60d, stddev_samp(CASE WHEN log_return_1d < 0 THEN log_return_1d END) OVER {W_(20)} AS downside_volatility_20d, avg(true_range) OVER {W_(14)} AS atr_14, avg(gain_1d) OVER {W_(14)} AS avg_gain_14,
  avg(loss_1d) OVER {W_(14)} AS avg_loss_14, {", ".join(f"sum({c}) OVER {W_(14)} AS {c}_14" for c in ("plus_dm", "minus_dm", "true_range", "positive_flow", "negative_flow"))}, avg(typical_price) OVER {W_(20)} AS typical_sma_20, sum(obv_step) OVER {W} AS obv
  FROM (SELECT *, {", ".join(f"close / nullif(lag(close, {n}) OVER {W}, 0) - 1 AS roc_{n}" for n in (10, 20, 60))}, CASE WHEN close / nullif(pc, 0) > 0 THEN ln(close / nullif(pc, 0)) END AS log_return_1d,
    greatest(high - low, abs(high - coalesce(pc, close)), abs(low - coalesce(pc, close))) AS true_range, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS plus_dm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS minus_dm,
    greatest(close - coalesce(pc, close), 0.0) AS gain_1d, greatest(coalesce(pc, close) - close, 0.0) AS loss_1d, CASE WHEN typical_price > pt THEN typical_price * volume ELSE 0.0 END AS positive_flow,
    CASE WHEN typical_price < pt THEN typical_price * volume ELSE 0.0 END AS negative_flow, CASE WHEN close > coalesce(pc, close) THEN volume WHEN close < coalesce(pc, close) THEN -volume ELSE 0.0 END AS obv_step
    FROM (SELECT *, lag(close) OVER {W} AS pc, (high + low + close) / 3.0 AS typical_price, lag((high + low + close) / 3.0) OVER {W} AS pt, high - coalesce(lag(high) OVER {W}, high) AS up, coalesce(lag(low) OVER {W}, low) - low AS dn FROM bars)) m JOIN em USING (symbol, trading_date)"""
TA2 = f"""SELECT *, avg(macd) OVER {W_(9)} AS macd_signal, avg(abs(typical_price - typical_sma_20)) OVER {W_(20)} AS typical_dev_20, 100 - 100 / (1 + avg_gain_14 / nullif(avg_loss_14, 0)) AS rsi_14, 100 * (close - low_14) / nullif(high_14 - low_14, 0) AS stochastic_k,
  100 * plus_dm_14 / nullif(true_range_14, 0) AS plus_di_14, 100 * minus_dm_14 / nullif(true_range_14, 0) AS minus_di_14, 100 - 100 / (1 + positive_flow_14 / nullif(negative_flow_14, 0)) AS mfi_14, 4 * close_std_20 / nullif(sma_20, 0) AS bollinger_band_width,
  close / nullif(high_close_252, 0) - 1 AS drawdown_from_252d_high, volume / nullif(avg_volume_20, 0) AS volume_to_avg_20d, (volume - avg_volume_20) / nullif(volume_std_20, 0) AS volume_zscore_20, sma_20 / nullif(lag(sma_20, 20) OVER {W}, 0) - 1 AS sma_20_slope_20d,
  sma_50 / nullif(lag(sma_50, 20) OVER {W}, 0) - 1 AS sma_50_slope_20d, atr_14 / nullif(close, 0) AS atr_pct_14, {", ".join(f"close / nullif(sma_{n}, 0) - 1 AS price_to_sma_{n}" for n in (20, 50, 200))}, close / nullif(ema_20, 0) - 1 AS price_to_ema_20 FROM t1"""
TA3 = f"""SELECT *, macd - macd_signal AS macd_histogram, avg(stochastic_k) OVER {W_(3)} AS stochastic_d, (typical_price - typical_sma_20) / nullif(0.015 * typical_dev_20, 0) AS cci_20, symbol || '|' || CAST(trading_date AS VARCHAR) AS symbol_date_key,
  avg(100 * abs(plus_di_14 - minus_di_14) / nullif(plus_di_14 + minus_di_14, 0)) OVER {W_(14)} AS adx_14 FROM t2"""
TA4 = f"""SELECT *, covar_samp(log_return_1d, core_return_1d) OVER {W_(60)} / nullif(var_samp(core_return_1d) OVER {W_(60)}, 0) AS beta_60d,
  covar_samp(log_return_1d, core_return_1d) OVER {W_(60)} / nullif(stddev_samp(CASE WHEN core_return_1d IS NOT NULL THEN log_return_1d END) OVER {W_(60)} * stddev_samp(CASE WHEN log_return_1d IS NOT NULL THEN core_return_1d END) OVER {W_(60)}, 0) AS correlation_60d,
  {", ".join(f"roc_{n} - {b}_return_{n}d AS relative_strength_{b}_{n}d" for b in ("core", "all") for n in (20, 60))} FROM t3
  LEFT JOIN (SELECT trading_date, {", ".join(f"max(CASE WHEN symbol = '{s}' THEN {c} END) AS {p}_{c}" for p, s in (("core", "IDX_CORE"), ("all", "IDX_ALL")) for c in ("return_1d", "return_20d", "return_60d"))} FROM ir GROUP BY trading_date) USING (trading_date)"""


def _clamp(total: str) -> str:
    return f"least(1.0, greatest(0.0, {total}))"


def _yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"


SCORED = "SELECT * , {trend} AS ta_trend_score, {momentum} AS ta_momentum_score, {volatility} AS ta_volatility_score, {liquidity} AS ta_liquidity_score, {strength} AS ta_relative_strength_score FROM t4".format(
    trend=_clamp("(" + " + ".join(map(_yes, ["close - sma_20 > 1e-9", "close - sma_50 > 1e-9", "close - sma_200 > 1e-9", "sma_20 - sma_50 > 1e-9", "sma_50 - sma_200 > 1e-9", "ema_20 - ema_50 > 1e-9", "coalesce(adx_14, 0) >= 20 AND coalesce(plus_di_14, 0) > coalesce(minus_di_14, 0)"])) + ") / 7.0"),
    momentum=_clamp(f"(coalesce((rsi_14 - 30) / 40, 0.5) + {_yes('macd_histogram > 1e-9')} + coalesce((roc_20 + 0.12) / 0.24, 0.5) + coalesce(stochastic_k / 100, 0.5) + coalesce((mfi_14 - 20) / 60, 0.5)) / 5.0"),
    volatility=_clamp("(coalesce(1 - realized_volatility_20d * 8, 0.5) + coalesce(1 - atr_pct_14 * 8, 0.5) + coalesce(1 - bollinger_band_width * 2, 0.5) + coalesce(1 + drawdown_from_252d_high, 0.5)) / 4.0"),
    liquidity=_clamp("(percent_rank() OVER (PARTITION BY trading_date ORDER BY close * volume NULLS FIRST) + CASE WHEN volume_to_avg_20d IS NULL THEN 0.5 ELSE least(volume_to_avg_20d, 2.0) / 2 END + CASE WHEN volume_zscore_20 IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, (volume_zscore_20 + 2) / 4)) END) / 3.0"),
    strength=_clamp("(coalesce((relative_strength_core_20d + 0.10) / 0.20, 0.5) + coalesce((relative_strength_core_60d + 0.15) / 0.30, 0.5) + coalesce((relative_strength_all_20d + 0.10) / 0.20, 0.5) + coalesce((relative_strength_all_60d + 0.15) / 0.30, 0.5)) / 4.0"),
)
TA5 = f"""SELECT *, CASE WHEN ta_composite_score >= 0.62 THEN 'bullish' WHEN ta_composite_score <= 0.38 THEN 'bearish' ELSE 'neutral' END AS ta_action_bias,
  CASE WHEN coalesce(realized_volatility_20d, 0) >= 0.045 OR coalesce(drawdown_from_252d_high, 0) <= -0.20 OR coalesce(atr_pct_14, 0) >= 0.055 THEN 'high' WHEN coalesce(realized_volatility_20d, 0) >= 0.028 OR coalesce(drawdown_from_252d_high, 0) <= -0.10 THEN 'medium' ELSE 'low' END AS ta_risk_flag
  FROM (SELECT *, {_clamp("0.0 + 0.28 * ta_trend_score + 0.24 * ta_momentum_score + 0.16 * ta_volatility_score + 0.14 * ta_liquidity_score + 0.18 * ta_relative_strength_score")} AS ta_composite_score FROM t5)"""
TA_CTES = {"ir": returns_sql("idx"), "em": EMA, "t1": TA1, "t2": TA2, "t3": TA3, "t4": TA4, "t5": SCORED, "ta": TA5}

RETURNS = "open high low close volume return_1d return_5d return_20d return_60d log_return_1d sma_20 sma_50 sma_200 drawdown_from_peak volatility_20d volatility_60d"
LIQ = "volume traded_value_proxy avg_volume_20d avg_volume_60d volume_to_avg_20d volume_cross_section_percentile traded_value_cross_section_percentile"
SUITE = "sma_20 sma_50 sma_100 sma_200 ema_12 ema_20 ema_26 ema_50 price_to_sma_20 price_to_sma_50 price_to_sma_200 price_to_ema_20 sma_20_slope_20d sma_50_slope_20d adx_14 plus_di_14 minus_di_14 rsi_14 macd macd_signal macd_histogram roc_10 roc_20 roc_60 stochastic_k stochastic_d cci_20 atr_14 atr_pct_14 bollinger_band_width realized_volatility_20d realized_volatility_60d downside_volatility_20d drawdown_from_252d_high volume_zscore_20 volume_to_avg_20d obv mfi_14"
SCORES = "relative_strength_core_20d relative_strength_core_60d relative_strength_all_20d relative_strength_all_60d beta_60d correlation_60d ta_trend_score ta_momentum_score ta_volatility_score ta_liquidity_score ta_relative_strength_score ta_composite_score"


def index_returns(spark: SparkSession, sf: str) -> DataFrame:
    return mart.symbol_daily_returns(fx.index_bars(spark, sf))


def ta_signals(market: fx.Market, indexes: DataFrame | None = None) -> DataFrame:
    indexes = mart.symbol_daily_returns(market.index) if indexes is None else indexes
    return marts.ta_scores(mart.relative_strength(mart.indicator_suite(market.daily), indexes, {"core": "IDX_CORE", "all": "IDX_ALL"}))


def regime(market: fx.Market, indexes: DataFrame | None = None) -> DataFrame:
    indexes = mart.symbol_daily_returns(market.index) if indexes is None else indexes
    return marts.market_regime(indexes, marts.market_breadth(market.daily))


def manifest(spark: SparkSession, sf: str, daily: DataFrame | None = None) -> DataFrame:
    """A manifest of the daily bars, off by one row for one symbol in five."""
    counted = (fx.bars(spark, sf) if daily is None else daily).groupBy("symbol").agg(F.max("trading_date").cast("timestamp_ntz").alias("coverage_end"), F.count("*").alias("n"))
    off = F.when(F.regexp_extract("symbol", r"(\d+)$", 1).cast("int") % 5 == 0, 1).otherwise(0)
    return counted.select(F.lit("daily").alias("dataset_name"), "symbol", "coverage_end", (F.col("n") - off).alias("row_count"), F.when(off == 1, "stale").otherwise("up_to_date").alias("update_status"))


MANIFEST = "SELECT 'daily' AS dataset_name, symbol, CAST(max(trading_date) AS TIMESTAMP) AS coverage_end, count(*) - CASE WHEN CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INT) % 5 = 0 THEN 1 ELSE 0 END AS row_count, CASE WHEN CAST(regexp_extract(symbol, '(\\d+)$', 1) AS INT) % 5 = 0 THEN 'stale' ELSE 'up_to_date' END AS update_status FROM bars GROUP BY symbol"
FRESH = """SELECT s.dataset_name, s.symbol, latest_data_ts, table_row_count, manifest_coverage_end, CAST(manifest_row_count AS BIGINT) AS manifest_row_count, coalesce(update_status, 'missing_manifest') AS update_status,
  CAST(date_diff('day', CAST(latest_data_ts AS DATE), (SELECT as_of FROM upto)) AS INT) AS stale_days, CAST(abs(coalesce(manifest_row_count, 0) - table_row_count) AS BIGINT) AS manifest_row_count_diff FROM (
  SELECT 'daily' AS dataset_name, symbol, CAST(max(trading_date) AS TIMESTAMP) AS latest_data_ts, count(*) AS table_row_count FROM bars GROUP BY symbol
  UNION ALL SELECT 'index', symbol, CAST(max(trading_date) AS TIMESTAMP), count(*) FROM idx GROUP BY symbol
  UNION ALL SELECT 'intraday', symbol, max(bar_time), count(*) FROM intra GROUP BY symbol) s
  LEFT JOIN (SELECT dataset_name, symbol, max(coverage_end) AS manifest_coverage_end, sum(row_count) AS manifest_row_count, max(update_status) AS update_status FROM mani GROUP BY ALL) m ON s.dataset_name = m.dataset_name AND s.symbol = m.symbol"""
FEATURES = """SELECT r.*, traded_value_proxy, avg_volume_20d, avg_volume_60d, volume_to_avg_20d, volume_cross_section_percentile, traded_value_cross_section_percentile, bench_return_1d, bench_return_20d, bench_return_60d,
  return_20d - bench_return_20d AS relative_strength_20d, return_60d - bench_return_60d AS relative_strength_60d, CASE WHEN close - sma_50 > 1e-9 AND sma_50 - sma_200 > 1e-9 THEN 'uptrend' WHEN sma_50 - close > 1e-9 AND sma_200 - sma_50 > 1e-9 THEN 'downtrend' ELSE 'sideways' END AS trend_state,
  CASE WHEN traded_value_cross_section_percentile >= 0.75 THEN 'high_liquidity' WHEN traded_value_cross_section_percentile <= 0.25 THEN 'low_liquidity' ELSE 'normal_liquidity' END AS liquidity_state
  FROM rt r SEMI JOIN act USING (symbol) LEFT JOIN (SELECT * EXCLUDE (volume) FROM lq) l USING (symbol, trading_date) LEFT JOIN (SELECT trading_date, return_1d AS bench_return_1d, return_20d AS bench_return_20d, return_60d AS bench_return_60d FROM ir WHERE symbol = 'IDX_CORE') b USING (trading_date)"""
ACTIVE = "SELECT DISTINCT symbol FROM uni WHERE universe_name = 'CORE' AND (end_date IS NULL OR end_date >= (SELECT as_of FROM upto))"
QUALITY = """SELECT symbol, coalesce(daily_row_count, 0) AS daily_row_count, first_trading_date, latest_trading_date, coalesce(invalid_ohlc_rows, 0) AS invalid_ohlc_rows, coalesce(negative_volume_rows, 0) AS negative_volume_rows, coalesce(duplicate_symbol_date_rows, 0) AS duplicate_symbol_date_rows,
  manifest_row_count, manifest_row_count_diff, stale_days, CASE WHEN coalesce(daily_row_count, 0) = 0 THEN 'missing' WHEN invalid_ohlc_rows > 0 THEN 'invalid_ohlc' WHEN negative_volume_rows > 0 THEN 'invalid_volume' WHEN duplicate_symbol_date_rows > 0 THEN 'duplicate_rows'
  WHEN coalesce(stale_days, 999) > 7 THEN 'stale' WHEN coalesce(manifest_row_count_diff, 0) > 0 THEN 'manifest_mismatch' ELSE 'pass' END AS data_quality_status FROM act LEFT JOIN (
  SELECT symbol, count(*) AS daily_row_count, min(trading_date) AS first_trading_date, max(trading_date) AS latest_trading_date, count(*) FILTER (WHERE high < greatest(open, low, close) OR low > least(open, high, close)) AS invalid_ohlc_rows, count(*) FILTER (WHERE volume < 0) AS negative_volume_rows,
    count(*) - count(DISTINCT trading_date) AS duplicate_symbol_date_rows FROM bars GROUP BY symbol) USING (symbol) LEFT JOIN (SELECT symbol, manifest_row_count, manifest_row_count_diff, stale_days FROM fr WHERE dataset_name = 'daily') USING (symbol)"""


def freshness(spark: SparkSession, sf: str, market: fx.Market | None = None) -> DataFrame:
    daily, index = market or fx.market(spark, sf)
    return marts.freshness_status({"daily": (daily, "trading_date"), "index": (index, "trading_date"), "intraday": (fx.intraday(spark, sf), "bar_time")}, manifest(spark, sf, daily), fx.as_of(daily))


def features(spark: SparkSession, sf: str, market: fx.Market | None = None, indexes: DataFrame | None = None) -> DataFrame:
    daily, index = market = market or fx.market(spark, sf)
    indexes = mart.symbol_daily_returns(index) if indexes is None else indexes
    return marts.symbol_daily_features(mart.symbol_daily_returns(daily), mart.symbol_liquidity(daily), indexes, fx.universe(spark, sf, daily), "CORE", fx.as_of(daily))


def quality(spark: SparkSession, sf: str, market: fx.Market | None = None) -> DataFrame:
    daily, _ = market = market or fx.market(spark, sf)
    fresh = freshness(spark, sf, market).where(F.col("dataset_name") == "daily")
    return marts.symbol_data_quality(fx.universe(spark, sf, daily), "CORE", daily, fresh, fx.as_of(daily))


def context(spark: SparkSession, sf: str, market: fx.Market | None = None) -> DataFrame:
    """All of a symbol's date. The ticks are read once, for the market's bars."""
    market = market or fx.market(spark, sf)
    indexes = mart.symbol_daily_returns(market.index)
    return marts.agent_context(features(spark, sf, market, indexes), regime(market, indexes), quality(spark, sf, market), ta_signals(market, indexes))


CONTEXT_CTES = {"rt": returns_sql("bars"), "lq": LIQUIDITY, **TA_CTES, "br": BREADTH, "mr": REGIME, "mani": MANIFEST, "fr": FRESH, "act": ACTIVE, "ft": FEATURES, "ql": QUALITY}
CONTEXT_CTES["cx"] = f"""SELECT ft.*, market_regime, volatility_regime, regime_score, breadth_score, advancer_ratio, data_quality_status, stale_days, manifest_row_count_diff, {", ".join(f"ta.{c}" for c in ("ta_composite_score ta_trend_score rsi_14 adx_14 beta_60d macd_histogram atr_pct_14 volume_zscore_20 drawdown_from_252d_high ta_action_bias ta_risk_flag symbol_date_key").split())},
  CASE WHEN data_quality_status = 'pass' AND market_regime = 'bullish' AND trend_state = 'uptrend' AND relative_strength_20d > 0 THEN 'candidate_long' WHEN data_quality_status <> 'pass' THEN 'blocked_data_quality' WHEN market_regime = 'bearish' THEN 'risk_off_watch' ELSE 'watch' END AS agent_candidate_state
  FROM ft LEFT JOIN mr USING (trading_date) LEFT JOIN ql USING (symbol) LEFT JOIN ta USING (symbol, trading_date)"""
CONTEXT_COLS = ["symbol", "trading_date", "close", "return_20d", "relative_strength_20d", "volatility_20d", "drawdown_from_peak", "trend_state", "liquidity_state", "market_regime", "volatility_regime", "regime_score", "data_quality_status", "stale_days", "ta_composite_score", "rsi_14", "ta_action_bias", "ta_risk_flag", "agent_candidate_state", "symbol_date_key"]
_DOUBLES = {"close", "return_20d", "relative_strength_20d", "volatility_20d", "drawdown_from_peak", "regime_score", "ta_composite_score", "rsi_14"}

QUERIES = {
    "symbol_daily_returns": lambda s, d: rounded(mart.symbol_daily_returns(fx.bars(s, d))),
    "index_daily_returns": lambda s, d: rounded(index_returns(s, d)),
    "symbol_liquidity": lambda s, d: rounded(mart.symbol_liquidity(fx.bars(s, d))),
    "market_breadth": lambda s, d: rounded(marts.market_breadth(fx.bars(s, d))),
    "session_summary": lambda s, d: rounded(marts.session_summary(fx.intraday(s, d))),
    "market_regime": lambda s, d: rounded(regime(fx.market(s, d))),
    "indicator_suite_mart": lambda s, d: rounded(mart.indicator_suite(fx.bars(s, d)).select("symbol", "trading_date", *SUITE.split(), "symbol_date_key")),
    "ta_scores": lambda s, d: rounded(ta_signals(fx.market(s, d)).select("symbol", "trading_date", *SCORES.split(), "ta_action_bias", "ta_risk_flag")),
    "freshness_status": lambda s, d: freshness(s, d),
    "symbol_daily_features": lambda s, d: rounded(features(s, d)),
    "symbol_data_quality": lambda s, d: quality(s, d),
    "agent_context": lambda s, d: rounded(context(s, d).select(*CONTEXT_COLS)),
}
ORACLES = {
    "symbol_daily_returns": ctes("bars") + f"SELECT symbol, trading_date, {r(RETURNS)} FROM ({returns_sql('bars')})",
    "index_daily_returns": ctes("idx") + f"SELECT symbol, trading_date, {r(RETURNS)} FROM ({returns_sql('idx')})",
    "symbol_liquidity": ctes("bars") + f"SELECT symbol, trading_date, {r(LIQ)} FROM ({LIQUIDITY})",
    "market_breadth": ctes("bars") + f"SELECT trading_date, active_symbols, advancers, decliners, unchanged, {r('constituent_volume avg_constituent_return_1d advancer_ratio decliner_ratio breadth_score')} FROM ({BREADTH})",
    "session_summary": ctes("intra") + f"SELECT symbol, trading_date, first_bar_time, last_bar_time, bar_count, {r('session_open session_high session_low session_close session_volume session_range_pct session_return')} FROM ({SESSIONS})",
    "market_regime": ctes("bars", "idx", ir=returns_sql("idx"), br=BREADTH)
    + "SELECT trading_date, active_symbols, advancers, decliners, market_regime, volatility_regime, "
    + r(" ".join(f"{p}_{c}" for p in ("main", "second") for c in ("close", "return_1d", "return_20d", "sma_20", "sma_50", "sma_200", "volatility_20d")) + " advancer_ratio breadth_score constituent_volume volatility_avg_252 regime_score")
    + f" FROM ({REGIME})",
    "indicator_suite_mart": ctes("bars", em=EMA, t1=TA1, t2=TA2) + f"SELECT symbol, trading_date, {r(SUITE)}, symbol_date_key FROM ({TA3})",
    "ta_scores": ctes("bars", "idx", **TA_CTES) + f"SELECT symbol, trading_date, {r(SCORES)}, ta_action_bias, ta_risk_flag FROM ta",
    "freshness_status": ctes("bars", "idx", "upto", "intra", mani=MANIFEST) + FRESH,
    "symbol_daily_features": ctes("bars", "idx", "uni", ir=returns_sql("idx"), rt=returns_sql("bars"), lq=LIQUIDITY, act=ACTIVE)
    + f"SELECT symbol, trading_date, {r(RETURNS)}, {r(LIQ.replace('volume ', '', 1))}, {r('bench_return_1d bench_return_20d bench_return_60d relative_strength_20d relative_strength_60d')}, trend_state, liquidity_state FROM ({FEATURES})",
    "symbol_data_quality": ctes("bars", "idx", "uni", "intra", mani=MANIFEST, fr=FRESH, act=ACTIVE) + QUALITY,
    "agent_context": ctes("bars", "idx", "uni", "intra", **CONTEXT_CTES) + "SELECT " + ", ".join(r(c) if c in _DOUBLES else c for c in CONTEXT_COLS) + " FROM cx",
}
