"""Marts over the feature operators: breadth, regimes, scores, quality and the wide context table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, is_active, label, neutral, ratio, safe_return
from .windows import cross_section_rank, rolling_mean_global, window_spec

#: Weights of the composite score.
WEIGHTS = {"trend": 0.28, "momentum": 0.24, "volatility": 0.16, "liquidity": 0.14, "relative_strength": 0.18}

GAP = 1e-9


def market_breadth(bars: DataFrame, key: str = "symbol", order: str = "trading_date") -> DataFrame:
    """Advancers, decliners and their ratios a date. Rows without a previous close count as active."""
    seen = bars.select(order, "close", "volume", F.lag("close").over(window_spec(key, order)).alias("prev"))
    counted = seen.groupBy(order).agg(
        F.count("*").alias("active_symbols"),
        F.count_if(F.col("close") > F.col("prev")).alias("advancers"),
        F.count_if(F.col("close") < F.col("prev")).alias("decliners"),
        F.count_if(F.col("close") == F.col("prev")).alias("unchanged"),
        F.sum("volume").alias("constituent_volume"),
        F.avg(safe_return(F.col("close"), F.col("prev"))).alias("avg_constituent_return_1d"),
    )
    active = F.col("active_symbols").cast("double")
    return counted.withColumns({"advancer_ratio": ratio(F.col("advancers").cast("double"), active), "decliner_ratio": ratio(F.col("decliners").cast("double"), active), "breadth_score": ratio((F.col("advancers") - F.col("decliners")).cast("double"), active)})


def session_summary(intraday: DataFrame, key: str = "symbol") -> DataFrame:
    """Bars of a session from its intraday bars."""
    made = intraday.groupBy(key, F.col("session_date").alias("trading_date")).agg(
        F.min("bar_time").alias("first_bar_time"), F.max("bar_time").alias("last_bar_time"), F.count("*").alias("bar_count"),
        F.min_by("open", F.when(F.col("open").isNotNull(), F.col("bar_time"))).alias("session_open"), F.max("high").alias("session_high"), F.min("low").alias("session_low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("bar_time"))).alias("session_close"), F.sum("volume").alias("session_volume"),
    )
    return made.withColumns({"session_range_pct": ratio(F.col("session_high") - F.col("session_low"), F.col("session_close")), "session_return": safe_return(F.col("session_close"), F.col("session_open"))})


def pivot_index(features: DataFrame, symbols: dict[str, str], cols: list[str], order: str = "trading_date") -> DataFrame:
    """One row a date; columns prefix_column for each symbol. symbols: prefix to symbol."""
    return features.groupBy(order).agg(*[F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{p}_{c}") for p, s in symbols.items() for c in cols])


def market_overview(breadth: DataFrame, index_features: DataFrame, main: str = "IDX_ALL", second: str = "IDX_CORE") -> DataFrame:
    """Breadth with two indexes of the same date, and the second one's price over the first one's. Dates that lack
    one of the three are left out."""
    wide = pivot_index(index_features, {"main": main, "second": second}, ["close", "return_1d"]).where(F.col("main_close").isNotNull() & F.col("second_close").isNotNull())
    return breadth.select("trading_date", "advancers", "decliners").join(wide, "trading_date").select("*", ratio(F.col("second_close"), F.col("main_close")).alias("relative_price"))


def market_regime(index_features: DataFrame, breadth: DataFrame, main: str = "IDX_ALL", second: str = "IDX_CORE") -> DataFrame:
    wide = pivot_index(index_features, {"main": main, "second": second}, ["close", "return_1d", "return_20d", "sma_20", "sma_50", "sma_200", "volatility_20d"])
    df = wide.join(breadth.select("trading_date", "active_symbols", "advancers", "decliners", "advancer_ratio", "breadth_score", "constituent_volume"), "trading_date", "left")
    # one row a date
    df = df.withColumn("volatility_avg_252", rolling_mean_global("main_volatility_20d", 252))
    close, mid, slow, breadth_now = F.col("main_close"), F.col("main_sma_50"), F.col("main_sma_200"), neutral(F.col("breadth_score"), 0.0)
    usual = F.nullif(F.col("volatility_avg_252"), F.lit(0.0))
    df = df.withColumns({
        "market_regime": label([((close - mid > GAP) & (mid - slow > GAP) & (breadth_now >= 0.10), "bullish"), ((mid - close > GAP) & (slow - mid > GAP) & (breadth_now <= -0.10), "bearish")], "neutral"),
        "volatility_regime": label([(F.col("main_volatility_20d") > 1.35 * usual, "high_volatility"), (F.col("main_volatility_20d") < 0.75 * usual, "low_volatility")], "normal_volatility"),
    })
    lean = F.when(F.col("market_regime") == "bullish", 1.0).when(F.col("market_regime") == "bearish", -1.0).otherwise(0.0)
    return df.withColumn("regime_score", lean + breadth_now + F.when(F.col("second_return_20d") > F.col("main_return_20d"), 0.25).otherwise(-0.25))


def ta_scores(df: DataFrame, benchmarks: tuple[str, str] = ("core", "all"), weights: dict[str, float] = WEIGHTS, order: str = "trading_date") -> DataFrame:
    """Scores of 0 to 1 over an indicator table with benchmark columns; missing inputs count as neutral."""
    c = F.col
    yes = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    above = lambda a, b: yes(c(a) - c(b) > 1e-9)  # noqa: E731  equal means differ in their last bits
    mean = lambda *parts: clamp(sum(parts[1:], parts[0]) / float(len(parts)))
    strengths = [neutral((c(f"relative_strength_{b}_{n}d") + off) / (2 * off)) for b in benchmarks for n, off in ((20, 0.10), (60, 0.15))]
    df = df.withColumns({
        "ta_trend_score": mean(
            *[above(a, b) for a, b in (("close", "sma_20"), ("close", "sma_50"), ("close", "sma_200"), ("sma_20", "sma_50"), ("sma_50", "sma_200"), ("ema_20", "ema_50"))],
            yes((neutral(c("adx_14"), 0.0) >= 20) & (neutral(c("plus_di_14"), 0.0) > neutral(c("minus_di_14"), 0.0))),
        ),
        "ta_momentum_score": mean(neutral((c("rsi_14") - 30.0) / 40.0), yes(c("macd_histogram") > 1e-9), neutral((c("roc_20") + 0.12) / 0.24), neutral(c("stochastic_k") / 100.0), neutral((c("mfi_14") - 20.0) / 60.0)),
        "ta_volatility_score": mean(neutral(1.0 - c("realized_volatility_20d") * 8.0), neutral(1.0 - c("atr_pct_14") * 8.0), neutral(1.0 - c("bollinger_band_width") * 2.0), neutral(1.0 + c("drawdown_from_252d_high"))),
        "ta_liquidity_score": mean(cross_section_rank(order, c("close") * c("volume")), F.when(c("volume_to_avg_20d").isNull(), 0.5).otherwise(F.least(c("volume_to_avg_20d"), F.lit(2.0)) / 2.0), F.when(c("volume_zscore_20").isNull(), 0.5).otherwise(clamp((c("volume_zscore_20") + 2.0) / 4.0))),
        "ta_relative_strength_score": mean(*strengths),
    })
    total = sum((F.lit(w) * c(f"ta_{n}_score") for n, w in weights.items()), F.lit(0.0))
    df = df.withColumn("ta_composite_score", clamp(total))
    vol, dd, atr = neutral(c("realized_volatility_20d"), 0.0), neutral(c("drawdown_from_252d_high"), 0.0), neutral(c("atr_pct_14"), 0.0)
    return df.withColumns({
        "ta_action_bias": label([(c("ta_composite_score") >= 0.62, "bullish"), (c("ta_composite_score") <= 0.38, "bearish")], "neutral"),
        "ta_risk_flag": label([((vol >= 0.045) | (dd <= -0.20) | (atr >= 0.055), "high"), ((vol >= 0.028) | (dd <= -0.10), "medium")], "low"),
    })


def trend_state(close: Column, mid: Column, slow: Column) -> Column:
    """Gaps of 1e-9 count: equal means differ in their last bits."""
    return label([((close - mid > GAP) & (mid - slow > GAP), "uptrend"), ((mid - close > GAP) & (slow - mid > GAP), "downtrend")], "sideways")


def liquidity_state(share: Column) -> Column:
    return label([(share >= 0.75, "high_liquidity"), (share <= 0.25, "low_liquidity")], "normal_liquidity")


def restrict_to_universe(df: DataFrame, members: DataFrame, universe: str, as_of: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows of the members of a universe that are active at as_of (one row)."""
    active = members.where(F.col("universe_name") == universe).join(F.broadcast(as_of), is_active(F.col("end_date"), F.col("as_of")))
    return df.join(active.select(key), key, "left_semi")


def symbol_daily_features(returns: DataFrame, liquidity: DataFrame, index_returns: DataFrame, members: DataFrame, universe: str, as_of: DataFrame, benchmark: str = "IDX_CORE") -> DataFrame:
    keys = ["symbol", "trading_date"]
    bench = index_returns.where(F.col("symbol") == benchmark).select("trading_date", *[F.col(f"return_{n}d").alias(f"bench_return_{n}d") for n in (1, 20, 60)])
    df = restrict_to_universe(returns, members, universe, as_of).join(liquidity.drop("volume"), keys, "left").join(bench, "trading_date", "left")
    return df.withColumns({
        "relative_strength_20d": F.col("return_20d") - F.col("bench_return_20d"),
        "relative_strength_60d": F.col("return_60d") - F.col("bench_return_60d"),
        "trend_state": trend_state(F.col("close"), F.col("sma_50"), F.col("sma_200")),
        "liquidity_state": liquidity_state(F.col("traded_value_cross_section_percentile")),
    })


def freshness_status(datasets: dict[str, tuple[DataFrame, str]], manifest: DataFrame, as_of: DataFrame) -> DataFrame:
    """Latest time and rows of each dataset and symbol against the manifest. datasets: name to (frame, time column)."""
    found = None
    for name, (frame, time) in datasets.items():
        part = frame.groupBy("symbol").agg(F.max(F.col(time).cast("timestamp_ntz")).alias("latest_data_ts"), F.count("*").alias("table_row_count")).withColumn("dataset_name", F.lit(name))
        found = part if found is None else found.unionByName(part)
    known = manifest.groupBy("dataset_name", "symbol").agg(F.max("coverage_end").alias("manifest_coverage_end"), F.sum("row_count").alias("manifest_row_count"), F.max("update_status").alias("update_status"))
    met = found.join(known, ["dataset_name", "symbol"], "left").join(F.broadcast(as_of), F.lit(True))
    return met.select(
        "dataset_name", "symbol", "latest_data_ts", "table_row_count", "manifest_coverage_end", "manifest_row_count", F.coalesce("update_status", F.lit("missing_manifest")).alias("update_status"),
        F.datediff("as_of", F.to_date("latest_data_ts")).alias("stale_days"), F.abs(F.coalesce("manifest_row_count", F.lit(0)) - F.col("table_row_count")).alias("manifest_row_count_diff"),
    )


def symbol_data_quality(members: DataFrame, universe: str, bars: DataFrame, freshness: DataFrame, as_of: DataFrame) -> DataFrame:
    symbols = restrict_to_universe(members.where(F.col("universe_name") == universe).select("symbol").distinct(), members, universe, as_of)
    counted = bars.groupBy("symbol").agg(
        F.count("*").alias("daily_row_count"), F.min("trading_date").alias("first_trading_date"), F.max("trading_date").alias("latest_trading_date"),
        F.count_if((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))).alias("invalid_ohlc_rows"),
        F.count_if(F.col("volume") < 0).alias("negative_volume_rows"), (F.count("*") - F.countDistinct("trading_date")).alias("duplicate_symbol_date_rows"),
    )
    df = symbols.join(counted, "symbol", "left").join(freshness.select("symbol", "manifest_row_count", "manifest_row_count_diff", "stale_days"), "symbol", "left")
    zero = F.lit(0)
    for name in ("daily_row_count", "invalid_ohlc_rows", "negative_volume_rows", "duplicate_symbol_date_rows"):
        df = df.withColumn(name, F.coalesce(name, zero))
    rules = [
        (F.col("daily_row_count") == 0, "missing"), (F.col("invalid_ohlc_rows") > 0, "invalid_ohlc"), (F.col("negative_volume_rows") > 0, "invalid_volume"), (F.col("duplicate_symbol_date_rows") > 0, "duplicate_rows"),
        (F.coalesce("stale_days", F.lit(999)) > 7, "stale"), (F.coalesce("manifest_row_count_diff", zero) > 0, "manifest_mismatch"),
    ]
    return df.withColumn("data_quality_status", label(rules, "pass"))


def agent_context(features: DataFrame, regime: DataFrame, quality: DataFrame, ta: DataFrame) -> DataFrame:
    """Features with the date's regime, the symbol's quality and its signals, and the candidate state."""
    ta_cols = [c for c in ta.columns if c not in features.columns or c in ("symbol", "trading_date")]
    df = (
        features.join(regime.select("trading_date", "market_regime", "volatility_regime", "regime_score", "breadth_score", "advancer_ratio"), "trading_date", "left")
        .join(quality.select("symbol", "data_quality_status", "stale_days", "manifest_row_count_diff"), "symbol", "left")
        .join(ta.select(*ta_cols), ["symbol", "trading_date"], "left")
    )
    passed = F.col("data_quality_status") == "pass"
    long = passed & (F.col("market_regime") == "bullish") & (F.col("trend_state") == "uptrend") & (F.col("relative_strength_20d") > 0)
    return df.withColumn("agent_candidate_state", label([(long, "candidate_long"), (~passed, "blocked_data_quality"), (F.col("market_regime") == "bearish", "risk_off_watch")], "watch"))
