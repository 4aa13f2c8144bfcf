"""Indicators of the mart family: partial windows and simple averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, safe_return, surrogate_key
from .blocks import KEY, PART, parts_of
from .windows import cross_section_rank, lag_return, log_return, rolling_abs_dev, rolling_beta_corr, rolling_max, rolling_mean, rolling_min, rolling_std, rolling_sum, running_max, running_sum, slope, window_spec


def weighted(values: Column, rate: float) -> Column:
    """Mean of values, the first of weight 1 and each next one of the last's times rate."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(1.0).alias("f"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["s"] + x * a["f"]).alias("s"), (a["w"] + a["f"]).alias("w"), (a["f"] * F.lit(rate)).alias("f")), lambda a: ratio(a["s"], a["w"]))


def ema_kernel(df: DataFrame, spans: tuple[int, ...] = (12, 20, 26, 50), col: str = "close", key: str = "symbol", order: str = "trading_date") -> DataFrame:
    """Truncated exponential averages: weights (1 - 2/(n+1))^lag up to lag 4n, at most 200, normalised.

    One window collects a row's history, which is folded once for each span; the band self-join that this replaces
    would keep 201 rows for every row.
    """
    longest = min(200, 4 * max(spans))
    out = df.withColumn("__past", F.reverse(F.collect_list(col).over(window_spec(key, order).rowsBetween(-longest, 0))))
    for n in spans:
        rate = 1.0 - 2.0 / (n + 1)
        reach = min(200, 4 * n)
        out = out.withColumn(f"ema_{n}", weighted(F.slice("__past", 1, reach + 1), rate))
    return out.drop("__past")


def symbol_daily_returns(bars: DataFrame, key: str = "symbol", order: str = "trading_date", rows: int | None = None) -> DataFrame:
    """Returns over 1, 5, 20 and 60 rows, means, deviations of log returns, drawdown from the peak, over parts of a key's
    rows with the 200 before each."""
    parts = parts_of(bars.select(key, order, "open", "high", "low", "close", "volume"), [key], [order], rows)
    parts = parts.carried(__peak=(F.max("close"), F.max)).with_neighbours(200, 0)
    keys = [KEY, PART]
    w = window_spec(keys, order)
    base = parts.rows.withColumns({
        **{f"return_{n}d": lag_return("close", n, w) for n in (1, 5, 20, 60)},
        "log_return_1d": log_return("close", w),
        **{f"sma_{n}": rolling_mean("close", n, keys, order) for n in (20, 50, 200)},
        "drawdown_from_peak": safe_return(F.col("close"), F.greatest(running_max("close", keys, order), "__peak")),
    })
    made = base.withColumns({f"volatility_{n}d": rolling_std("log_return_1d", n, keys, order) for n in (20, 60)})
    return made.where("not __copy").drop(*keys, "__copy", "__peak")


def symbol_liquidity(bars: DataFrame, key: str = "symbol", order: str = "trading_date") -> DataFrame:
    traded = F.col("close") * F.col("volume")
    return bars.select(
        key, order, "volume", traded.alias("traded_value_proxy"),
        *[rolling_mean("volume", n, key, order).alias(f"avg_volume_{n}d") for n in (20, 60)],
        ratio(F.col("volume"), rolling_mean("volume", 20, key, order)).alias("volume_to_avg_20d"),
        cross_section_rank(order, "volume").alias("volume_cross_section_percentile"),
        cross_section_rank(order, traded).alias("traded_value_cross_section_percentile"),
    )


def moves(bars: DataFrame, key: str = "symbol", order: str = "trading_date") -> DataFrame:
    """Per-row inputs of the indicators: true range, directional moves, gains, money flows, volume steps."""
    w = window_spec(key, order)
    close, high, low, volume = (F.col(c) for c in ("close", "high", "low", "volume"))
    typical = (high + low + close) / 3.0
    seen = bars.withColumns({"prev_close": F.lag("close").over(w), "prev_high": F.lag("high").over(w), "prev_low": F.lag("low").over(w), "typical_price": typical, "prev_typical": F.lag(typical).over(w)})
    before = F.coalesce("prev_close", "close")
    up, down = high - F.coalesce("prev_high", "high"), F.coalesce("prev_low", "low") - low
    flow = F.col("typical_price") * volume
    zero = F.lit(0.0)
    return seen.withColumns({
        **{f"roc_{n}": lag_return("close", n, w) for n in (10, 20, 60)},
        "log_return_1d": log_return("close", w),
        "true_range": F.greatest(high - low, F.abs(high - before), F.abs(low - before)),
        "plus_dm": F.when((up > down) & (up > 0), up).otherwise(zero),
        "minus_dm": F.when((down > up) & (down > 0), down).otherwise(zero),
        "gain_1d": F.greatest(close - before, zero),
        "loss_1d": F.greatest(before - close, zero),
        "positive_flow": F.when(F.col("typical_price") > F.col("prev_typical"), flow).otherwise(zero),
        "negative_flow": F.when(F.col("typical_price") < F.col("prev_typical"), flow).otherwise(zero),
        "obv_step": F.when(close > before, volume).when(close < before, -volume).otherwise(zero),
    })


def _strength(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain / loss); null without losses."""
    return F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(gain, loss))


def indicator_suite(bars: DataFrame, key: str = "symbol", order: str = "trading_date") -> DataFrame:
    """All indicators of the family, in three passes over one sort."""
    def mean(c, n):
        return rolling_mean(c, n, key, order)

    def total(c, n):
        return rolling_sum(c, n, key, order)

    first = ema_kernel(moves(bars, key, order), key=key, order=order).withColumns({
        **{f"sma_{n}": mean("close", n) for n in (20, 50, 100, 200)},
        "close_std_20": rolling_std("close", 20, key, order),
        "low_14": rolling_min("low", 14, key, order),
        "high_14": rolling_max("high", 14, key, order),
        "avg_volume_20": mean("volume", 20),
        "volume_std_20": rolling_std("volume", 20, key, order),
        "high_close_252": rolling_max("close", 252, key, order),
        "realized_volatility_20d": rolling_std("log_return_1d", 20, key, order),
        "realized_volatility_60d": rolling_std("log_return_1d", 60, key, order),
        "downside_volatility_20d": rolling_std("log_return_1d", 20, key, order, when=F.col("log_return_1d") < 0),
        "atr_14": mean("true_range", 14),
        "avg_gain_14": mean("gain_1d", 14),
        "avg_loss_14": mean("loss_1d", 14),
        **{f"{c}_14": total(c, 14) for c in ("plus_dm", "minus_dm", "true_range", "positive_flow", "negative_flow")},
        "typical_sma_20": mean("typical_price", 20),
        "obv": running_sum("obv_step", key, order),
        "macd": F.col("ema_12") - F.col("ema_26"),
    })
    second = first.withColumns({
        "macd_signal": mean("macd", 9),
        "typical_dev_20": rolling_abs_dev("typical_price", "typical_sma_20", 20, key, order),
        "rsi_14": _strength(F.col("avg_gain_14"), F.col("avg_loss_14")),
        "stochastic_k": ratio(100.0 * (F.col("close") - F.col("low_14")), F.col("high_14") - F.col("low_14")),
        "plus_di_14": ratio(100.0 * F.col("plus_dm_14"), F.col("true_range_14")),
        "minus_di_14": ratio(100.0 * F.col("minus_dm_14"), F.col("true_range_14")),
        "mfi_14": _strength(F.col("positive_flow_14"), F.col("negative_flow_14")),
        "bollinger_band_width": ratio(4.0 * F.col("close_std_20"), F.col("sma_20")),
        "drawdown_from_252d_high": safe_return(F.col("close"), F.col("high_close_252")),
        "volume_to_avg_20d": ratio(F.col("volume"), F.col("avg_volume_20")),
        "volume_zscore_20": ratio(F.col("volume") - F.col("avg_volume_20"), F.col("volume_std_20")),
        "sma_20_slope_20d": slope("sma_20", 20, key, order),
        "sma_50_slope_20d": slope("sma_50", 20, key, order),
        "atr_pct_14": ratio(F.col("atr_14"), F.col("close")),
        **{f"price_to_sma_{n}": safe_return(F.col("close"), F.col(f"sma_{n}")) for n in (20, 50, 200)},
        "price_to_ema_20": safe_return(F.col("close"), F.col("ema_20")),
    })
    return second.withColumns({
        "macd_histogram": F.col("macd") - F.col("macd_signal"),
        "stochastic_d": mean("stochastic_k", 3),
        "cci_20": ratio(F.col("typical_price") - F.col("typical_sma_20"), 0.015 * F.col("typical_dev_20")),
        "adx_14": F.avg(ratio(100.0 * F.abs(F.col("plus_di_14") - F.col("minus_di_14")), F.col("plus_di_14") + F.col("minus_di_14"))).over(window_spec(key, order, 14)),
        "symbol_date_key": surrogate_key(key, order),
    })


def relative_strength(df: DataFrame, index_returns: DataFrame, names: dict[str, str], key: str = "symbol", order: str = "trading_date") -> DataFrame:
    """Differences to the 20- and 60-row returns of benchmarks (prefix: index symbol), and beta and correlation to the
    first of them. The benchmarks are pivoted once, a row a date."""
    wanted = index_returns.where(F.col(key).isin(list(names.values())))
    wide = wanted.groupBy(order).agg(*[F.max(F.when(F.col(key) == s, F.col(c))).alias(f"{p}_{c}") for p, s in names.items() for c in ("return_1d", "return_20d", "return_60d")])
    out = df.join(wide, order, "left")
    out = out.withColumns({f"relative_strength_{p}_{n}d": F.col(f"roc_{n}") - F.col(f"{p}_return_{n}d") for p in names for n in (20, 60)})
    main = next(iter(names))
    beta, corr = rolling_beta_corr("log_return_1d", f"{main}_return_1d", 60, key, order)
    return out.withColumns({"beta_60d": beta, "correlation_60d": corr})


def relative_price_strength(df: DataFrame, index: DataFrame, n: int = 20, key: str = "symbol", order: str = "trading_date") -> DataFrame:
    """Over the dates that a symbol and the index have in common: the ratio of their prices, its change over n such
    rows, and the difference of their returns over these."""
    met = df.select(key, order, "close").join(index.select(order, F.col("close").alias("__index")), order).withColumn("price_ratio", ratio(F.col("close"), F.col("__index")))
    w = window_spec(key, order)
    return met.withColumns({"ratio_change": lag_return("price_ratio", n, w), "strength": lag_return("close", n, w) - lag_return("__index", n, w)}).select(key, order, "price_ratio", "ratio_change", "strength")
