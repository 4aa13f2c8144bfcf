"""Scoring, ranking and selection over context rows, for all dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clamp, finite, floor_lot, label, neutral, ratio, to_json_sorted
from .aggregates import rank_of

#: Thresholds, weights and bonuses of the rule-based score.
CONFIG = {
    "max_stale_days": 5, "min_confidence": 0.35, "candidate_score": 0.60, "risk_off_score": 0.25, "bullish_bonus": 0.15, "bearish_penalty": 0.25, "high_volatility_penalty": 0.10,
    "trend": 0.25, "relative_strength": 0.25, "momentum": 0.20, "volatility": 0.15, "liquidity": 0.15, "percentile_scale": 100.0, "max_positions": 10, "max_weight": 0.15, "min_weight": 0.02,
}

#: Keeps sums that end in a 5 at the seventh digit off the rounding edge.
EDGE = 1e-9


def score_context(df: DataFrame, config: dict[str, float] = CONFIG) -> DataFrame:
    """Score, confidence, risk level, recommendation and rationale of context rows.

    Kept as declared: the liquidity percentile (0 to 1) is divided by percentile_scale, and the regime score is
    centred on 0.5.
    """
    c, cfg = F.col, config
    quality = F.coalesce(c("data_quality_status"), F.lit("missing"))
    stale = neutral(c("stale_days").cast("double"), 999.0)
    blocked = (quality != "pass") | (stale > cfg["max_stale_days"])
    regime, vol_regime = F.coalesce(c("market_regime"), F.lit("neutral")), F.coalesce(c("volatility_regime"), F.lit("normal_volatility"))
    market = (
        F.when(regime == "bullish", cfg["bullish_bonus"]).when(regime == "bearish", -cfg["bearish_penalty"]).otherwise(0.0)
        - F.when(vol_regime == "high_volatility", cfg["high_volatility_penalty"]).otherwise(0.0)
        + (neutral(c("regime_score")) - 0.5) * 0.20
    )
    parts = {
        "trend": F.when(c("trend_state") == "uptrend", 1.0).when(c("trend_state") == "downtrend", 0.0).otherwise(0.5),
        "relative_strength": clamp(0.5 + neutral(c("relative_strength_20d"), 0.0) * 2.0),
        "momentum": clamp(0.5 + neutral(c("return_20d"), 0.0) * 3.0),
        "volatility": clamp(1.0 - neutral(c("volatility_20d"), 0.0) * 3.0),
        "liquidity": clamp(neutral(c("traded_value_cross_section_percentile"), 0.0) / cfg["percentile_scale"]),
    }
    symbol = sum((cfg[k] * (v - 0.5) for k, v in parts.items()), F.lit(0.0))
    fall, vol = F.abs(neutral(c("drawdown_from_peak"), 0.0)), neutral(c("volatility_20d"), 0.0)
    risk = label([((vol_regime == "high_volatility") | (fall > 0.18) | (vol > 0.06), "high"), ((fall > 0.08) | (vol > 0.035), "medium")], "low")
    df = df.withColumns({"__blocked": blocked, "__market": market, "__symbol": symbol, "risk_level": risk, **{f"score_{k}": v for k, v in parts.items()}})
    df = df.withColumn("__score", clamp(0.50 + c("__market") + c("__symbol")))
    sure = clamp(cfg["min_confidence"] + F.abs(c("__score") - 0.50) + F.when(~c("__blocked"), 0.15).otherwise(-0.10))
    rec = label([(c("__blocked"), "blocked_data_quality"), ((regime == "bearish") | (c("__score") <= cfg["risk_off_score"]), "avoid_or_reduce"), (c("__score") >= cfg["candidate_score"], "candidate_long")], "watch")
    df = df.withColumns({
        "recommendation": rec,
        "confidence": F.round(F.when(c("risk_level") == "high", clamp(sure - 0.10)).otherwise(sure) + EDGE, 6),
        "score": F.round(F.when(c("__blocked"), F.least(c("__score"), F.lit(0.20))).otherwise(c("__score")) + EDGE, 6),
    })
    why = to_json_sorted({"market": finite(c("__market") + EDGE), "symbol": finite(c("__symbol") + EDGE), "components": F.struct(*[F.round(f"score_{k}", 4).alias(k) for k in sorted(parts)]), "quality": quality, "risk_level": c("risk_level")})
    return df.withColumn("rationale_json", why).drop("__blocked", "__market", "__symbol", "__score")


def portfolio_overlay(df: DataFrame, config: dict[str, float] = CONFIG, by: str = "trading_date", cap_after: bool = False) -> DataFrame:
    """Weights of each date's best candidates by score and confidence: clipped shares, renormalised (which can lift
    them above max_weight; cap_after caps them again)."""
    candidate = (F.col("recommendation") == "candidate_long") & (F.col("confidence") > 0)
    line = Window.partitionBy(by).orderBy(candidate.desc(), F.desc("score"), F.desc("confidence"), "symbol")
    df = df.withColumn("__in", candidate & (F.row_number().over(line) <= config["max_positions"]))
    whole = Window.partitionBy(by)
    share = ratio(F.col("score"), F.sum(F.when(F.col("__in"), F.greatest("score", F.lit(0.0)))).over(whole))
    df = df.withColumn("__raw", F.when(F.col("__in"), F.greatest(F.lit(config["min_weight"]), F.least(F.lit(config["max_weight"]), share))))
    weight = F.round(ratio(F.col("__raw"), F.sum("__raw").over(whole)), 6)
    weight = F.least(weight, F.lit(config["max_weight"])) if cap_after else weight
    return df.withColumn("suggested_weight", F.coalesce(F.when(F.col("__in"), weight), F.lit(0.0))).drop("__in", "__raw")


def candidate_pool(context: DataFrame, k: int = 12, min_liquidity: float = 0.25, by: str = "trading_date") -> DataFrame:
    """Each date's k best rows that pass, with their expected alpha."""
    kept = context.where((F.col("data_quality_status") == "pass") & (neutral(F.col("traded_value_cross_section_percentile"), 0.0) >= min_liquidity) & F.col("ta_composite_score").isNotNull())
    line = Window.partitionBy(by).orderBy(F.round("ta_composite_score", 9).desc(), F.desc("traded_value_cross_section_percentile"), F.desc_nulls_last("relative_strength_20d"), "symbol")
    alpha = (F.col("ta_composite_score") - 0.5) * 0.08 + neutral(F.col("return_20d"), 0.0) * 0.20 + neutral(F.col("relative_strength_20d"), 0.0) * 0.20 - F.when(F.col("ta_risk_flag") == "high", 0.025).otherwise(0.0)
    return kept.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).withColumn("expected_alpha", clamp(alpha, -0.08, 0.08))


def qubo_coefficients(candidates: DataFrame, cov: DataFrame, max_positions: int = 5, risk_aversion: float = 0.5, turnover_penalty: float = 0.01, concentration_penalty: float = 0.05, bad_risk_penalty: float = 0.02, by: str = "trading_date", held: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(linear, quadratic) coefficients of each date's candidates. cov: (i, j, cov), i <= j."""
    sized = candidates.withColumn("target", F.least(F.count("*").over(Window.partitionBy(by)), F.lit(max_positions)))
    own = cov.where("i = j").select(F.col("i").alias("symbol"), F.col("cov").alias("variance"))
    keeps = F.col("symbol").isin(held or [])
    linear = sized.join(own, "symbol", "left").select(
        by, "symbol", "rank", "target",
        (-F.col("expected_alpha") + risk_aversion * F.greatest(neutral(F.col("variance"), 0.0), F.lit(0.0)) + F.when(keeps, -turnover_penalty).otherwise(turnover_penalty)
         + F.when(F.col("ta_risk_flag") == "high", bad_risk_penalty).otherwise(0.0) + concentration_penalty * (1.0 - 2.0 * F.col("target"))).alias("linear"),
    )
    a = sized.select(by, F.col("symbol").alias("si"), F.col("rank").alias("ri"))
    b = sized.select(by, F.col("symbol").alias("sj"), F.col("rank").alias("rj"))
    pairs = a.join(b, by).where("ri < rj").withColumns({"i": F.least("si", "sj"), "j": F.greatest("si", "sj")})
    quadratic = pairs.join(cov.select("i", "j", "cov"), ["i", "j"], "left").select(by, "ri", "rj", (risk_aversion * neutral(F.col("cov"), 0.0) + 2.0 * concentration_penalty).alias("quadratic"))
    return linear, quadratic


def subset_scan(linear: DataFrame, quadratic: DataFrame, concentration_penalty: float = 0.05, by: str = "trading_date") -> DataFrame:
    """The subset of least energy of each date's candidates (ranks 1 to n, n <= 16), by every bitmask.

    Each date's coefficients become two arrays; masks are numbers that a row generates, so no row is sent.
    """
    lin = linear.groupBy(by).agg(F.collect_list(F.struct("rank", "linear", "symbol")).alias("lin"), F.max("target").alias("target"), F.max("rank").alias("n"))
    quad = quadratic.groupBy(by).agg(F.collect_list(F.struct("ri", "rj", "quadratic")).alias("quad"))
    both = lin.join(quad, by, "left").withColumn("mask", F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), "n") - 1).cast("int"))))
    bit = lambda r: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), r - 1)), F.lit(2)).cast("int")
    energy = F.aggregate("lin", F.lit(0.0), lambda a, x: a + x["linear"] * bit(x["rank"])) + F.coalesce(F.aggregate("quad", F.lit(0.0), lambda a, x: a + x["quadratic"] * bit(x["ri"]) * bit(x["rj"])), F.lit(0.0)) + concentration_penalty * F.col("target") * F.col("target")
    tried = both.where(F.bit_count("mask") <= F.col("target")).select(by, "mask", energy.alias("energy"), F.transform(F.array_sort(F.filter("lin", lambda x: bit(x["rank"]) == 1)), lambda x: x["symbol"]).alias("selected"))
    return tried.groupBy(by).agg(F.min_by(F.struct("mask", "energy", "selected"), F.struct(F.round("energy", 12), "mask")).alias("best")).select(by, "best.*")


def proposed_weights(selected: DataFrame, cap: float = 0.35, min_cash: float = 0.05, by: str = "trading_date") -> DataFrame:
    budget = max(0.0, 1.0 - min_cash)
    score = F.greatest(neutral(F.col("ta_composite_score"), 0.01), F.lit(0.01)) / F.greatest(neutral(F.col("volatility_20d"), 0.02), F.lit(0.01))
    whole = Window.partitionBy(by)
    df = selected.withColumn("__s", score).withColumn("__c", F.least(F.lit(cap), ratio(budget * F.col("__s"), F.sum("__s").over(whole))))
    total = F.sum("__c").over(whole)
    return df.withColumn("weight", F.round(ratio(F.col("__c"), total) * F.least(F.lit(budget), total), 6)).drop("__s", "__c")


def percentile_signals(df: DataFrame, by: str, score: str, hi: float = 0.8, lo: float = 0.2) -> DataFrame:
    cuts = df.groupBy(by).agg(F.percentile(score, hi).alias("__hi"), F.percentile(score, lo).alias("__lo"))
    return df.join(cuts, by).withColumn("signal", label([(F.col(score) >= F.col("__hi"), "BUY"), (F.col(score) <= F.col("__lo"), "AVOID")], "HOLD")).drop("__hi", "__lo")


def top_k_backtest(scores: DataFrame, k: int = 5, every: int = 5, cost: float = 0.001, score: str = "score", ret: str = "return_1d", by: str = "trading_date") -> DataFrame:
    """Daily returns of an equal-weight basket of the k best, chosen every few dates and held from the next date on,
    after costs on turnover."""
    days = scores.select(by).distinct().withColumn("nth", F.row_number().over(Window.orderBy(by)))  # a row a date
    df = scores.join(days, by)
    line = Window.partitionBy(by).orderBy(F.desc_nulls_last(F.round(score, 9)), "symbol")
    chosen = df.withColumn("__w", F.when((F.col("nth") - 1) % every == 0, F.when(F.row_number().over(line) <= k, 1.0 / k).otherwise(0.0)))
    past = Window.partitionBy("symbol").orderBy(by)
    held = chosen.withColumn("__held", F.coalesce(F.last("__w", True).over(past.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    held = held.withColumns({"__used": F.coalesce(F.lag("__held").over(past), F.lit(0.0)), "__move": F.abs(F.col("__held") - F.coalesce(F.lag("__held").over(past), F.lit(0.0)))})
    return held.groupBy(by).agg(F.sum(F.col("__used") * neutral(F.col(ret), 0.0)).alias("gross_return"), F.sum("__move").alias("turnover")).withColumn("net_return", F.col("gross_return") - cost * F.col("turnover"))


def daily_plan(recs: DataFrame, account: str = "account_id", lot: int = 100, fee: float = 0.0015, tax: float = 0.001) -> DataFrame:
    """Actions for recommendations with positions and prices: (account, symbol, rank, recommendation, price,
    quantity, sellable, target_value, cash). Cash is spent in rank order: a fold over an account's ranked rows."""
    value = F.col("quantity") * F.col("price")
    short, spare = F.col("target_value") - value, value - F.col("target_value")
    action = label([
        (F.col("price").isNull() | (F.col("price") <= 0), "NO_DATA"),
        (F.col("recommendation").isin("avoid_or_reduce", "blocked_data_quality") & (F.col("quantity") > 0), F.when(F.col("sellable") > 0, "SELL").otherwise("HOLD_LOCKED")),
        ((F.col("recommendation") == "candidate_long") & (short >= F.col("price") * lot), "BUY"),
        ((F.col("quantity") > 0) & (spare >= F.col("price") * lot) & (F.col("target_value") > 0), F.when(F.col("sellable") >= lot, "SELL").otherwise("HOLD_LOCKED")),
        (F.col("quantity") > 0, "HOLD"),
    ], "WATCH")
    whole_exit = F.col("recommendation").isin("avoid_or_reduce", "blocked_data_quality")
    wanted = F.when(F.col("action") == "BUY", floor_lot(ratio(short, F.col("price")), lot)).when(F.col("action") == "SELL", F.when(whole_exit, F.col("sellable")).otherwise(F.least(F.col("sellable"), floor_lot(ratio(spare, F.col("price")), lot)))).otherwise(0)
    rows = recs.withColumn("action", action).withColumn("wanted", wanted.cast("bigint")).select(account, "cash", F.struct("rank", "symbol", "action", "wanted", "price").alias("r"))
    listed = rows.groupBy(account).agg(F.array_sort(F.collect_list("r")).alias("rs"), F.max("cash").alias("cash"))
    empty = F.slice("rs", 1, 0)
    afford = lambda a, x: F.when(x["action"] == "BUY", F.least(x["wanted"], floor_lot(ratio(a["cash"], x["price"] * (1 + fee)), lot))).otherwise(x["wanted"]).cast("bigint")

    def spend(a: Column, x: Column) -> Column:
        n = afford(a, x)
        cash = F.when(x["action"] == "BUY", F.greatest(F.lit(0.0), a["cash"] - n * x["price"] * (1 + fee))).when(x["action"] == "SELL", a["cash"] + n * x["price"] * (1 - fee - tax)).otherwise(a["cash"])
        act = F.when((x["action"] == "BUY") & (n <= 0), "WATCH").otherwise(x["action"])
        return F.struct(cash.alias("cash"), F.concat(a["out"], F.array(F.struct(x["rank"].alias("rank"), x["symbol"].alias("symbol"), act.alias("action"), n.alias("wanted"), x["price"].alias("price")))).alias("out"))

    planned = listed.withColumn("p", F.aggregate("rs", F.struct(F.col("cash").cast("double").alias("cash"), empty.alias("out")), spend))
    return planned.select(account, F.explode("p.out").alias("o")).select(account, "o.rank", "o.symbol", F.col("o.action").alias("proposed_action"), F.col("o.wanted").alias("suggested_quantity"))


def position_action(recommendation: Column, risk: Column, trend: Column, gross: Column, five: Column, score: Column) -> Column:
    return label([
        (recommendation.isin("avoid_or_reduce", "blocked_data_quality") | (score <= 0.30), "SELL"),
        ((trend == "downtrend") & ((gross < -0.03) | (five < -0.02)), "SELL"),
        ((risk == "high") & ((trend != "uptrend") | (five < 0)), "TRIM"),
        ((recommendation == "candidate_long") | (score >= 0.45), "HOLD"),
    ], "WATCH")


def return_bucket(value: Column, band: float = 0.005) -> Column:
    return label([(value > band, "positive"), (value < -band, "negative")], "neutral")


def indicator_verdicts(context: DataFrame) -> DataFrame:
    """Signals of a context row in long form (symbol, trading_date, label, verdict, evidence)."""
    c = F.col

    def verdict(name: str, value: str, good: Column, bad: Column) -> Column:
        said = label([(c(value).isNull(), "n/a"), (good, "positive"), (bad, "negative")], "neutral")
        return F.struct(F.lit(name).alias("label"), said.alias("verdict"), F.round(c(value).cast("double"), 4).alias("evidence"))

    rows = [
        verdict("momentum_20d", "return_20d", c("return_20d") > 0, c("return_20d") < 0),
        verdict("relative_strength", "relative_strength_20d", c("relative_strength_20d") > 0, c("relative_strength_20d") < 0),
        verdict("rsi", "rsi_14", (c("rsi_14") >= 45) & (c("rsi_14") <= 70), (c("rsi_14") < 30) | (c("rsi_14") > 80)),
        verdict("volatility", "volatility_20d", c("volatility_20d") < 0.028, c("volatility_20d") >= 0.045),
        verdict("drawdown", "drawdown_from_peak", c("drawdown_from_peak") > -0.08, c("drawdown_from_peak") < -0.18),
        verdict("composite", "ta_composite_score", c("ta_composite_score") >= 0.62, c("ta_composite_score") <= 0.38),
        verdict("regime", "regime_score", c("regime_score") > 0.5, c("regime_score") < -0.5),
    ]
    return context.select("symbol", "trading_date", F.explode(F.array(*rows)).alias("v")).select("symbol", "trading_date", "v.*")


def sanitize_weights(decisions: DataFrame, allowed: DataFrame, cap: float = 0.2, max_positions: int = 5, by: str = "as_of_date") -> DataFrame:
    """Weights of allowed symbols, capped, the largest max_positions of a date, scaled to a sum of at most 1; errors
    say what was changed."""
    known = decisions.join(allowed.select("symbol").distinct().withColumn("__ok", F.lit(True)), "symbol", "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    capped = known.withColumn("__w", F.when(F.col("__ok"), F.greatest(F.least(F.col("weight"), F.lit(cap)), F.lit(0.0))).otherwise(0.0))
    capped = capped.withColumn("__nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__w"), "symbol")))
    kept = capped.withColumn("__k", F.when(F.col("__nth") <= max_positions, F.col("__w")).otherwise(0.0))
    total = F.sum("__k").over(Window.partitionBy(by))
    errors = F.array_compact(F.array(F.when(~F.col("__ok"), "not_allowed"), F.when(F.col("weight") > cap, "capped"), F.when((F.col("__nth") > max_positions) & (F.col("__w") > 0), "over_max_positions"), F.when(total > 1, "scaled")))
    return kept.select(by, "symbol", "weight", F.when(total > 1, ratio(F.col("__k"), total)).otherwise(F.col("__k")).alias("clean_weight"), F.array_join(errors, ",").alias("errors"))


def top_lists(recs: DataFrame, n: int = 5, by: str = "trading_date") -> DataFrame:
    """Each date's top weights, watch list and risk-off list, a symbol in the first list that has it."""
    place = label([(F.col("suggested_weight") > 0, "top_weight"), (F.col("recommendation") == "watch", "watchlist")], "risk_off")
    line = Window.partitionBy(by, "list").orderBy(F.desc("suggested_weight"), F.desc("score"), "symbol")
    return recs.withColumn("list", place).withColumn("nth", F.row_number().over(line)).where(F.col("nth") <= n).withColumn("list_rank", rank_of(F.col("list"), ["top_weight", "watchlist", "risk_off"]))


def signal_symbols(recs: DataFrame, limit: int = 15, n: int = 10, by: str = "trading_date") -> DataFrame:
    """Each date's symbols of interest in order: the n largest weights, then the n best scores to watch, then the n
    worst to leave, each symbol once, limit in all. A symbol may stand in two lists; the first one counts."""
    c = F.col
    lists = [
        (c("suggested_weight") > 0, -c("suggested_weight"), -c("score")),
        (c("recommendation").isin("candidate_long", "watch"), -c("score"), -c("confidence")),
        (c("recommendation").isin("avoid_or_reduce", "blocked_data_quality"), c("score"), c("confidence")),
    ]
    places = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("list_rank"), first.alias("k1"), second.alias("k2"))) for i, (test, first, second) in enumerate(lists, 1)]))
    rows = recs.select(by, "symbol", F.explode(places).alias("p")).select(by, "symbol", "p.*")
    nth = F.row_number().over(Window.partitionBy(by, "list_rank").orderBy("k1", "k2", "symbol"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= n).groupBy(by, "symbol").agg(F.min(F.struct("list_rank", "nth")).alias("p"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("p"))).where(F.col("place") <= limit).select(by, "symbol", "p.list_rank", "place")


def decision_signals(df: DataFrame, by: str = "trading_date") -> DataFrame:
    """What each indicator says about a row's decision, in long form (symbol, date, signal, verdict, value).

    df: context columns with action, risk_level, suggested_weight and sellable. A missing number counts as 0, a missing
    state as unknown. settlement is given only where something would be sold.
    """
    c = F.col
    num = lambda name: neutral(c(name).cast("double"), 0.0)
    said = lambda name: F.coalesce(c(name), F.lit("unknown"))
    two = lambda good, bad: label([(good, "bullish"), (bad, "bearish")], "neutral")
    chosen, none_left = num("suggested_weight") > 0, num("sellable") <= 0
    buying, selling = c("action").isin("BUY", "HOLD"), c("action").isin("SELL", "TRIM")
    backed = chosen | (said("ta_action_bias") == "bullish") | (said("trend_state") == "uptrend")
    # Names, order and thresholds of the signals.
    signals = [
        ("decision", label([(buying & backed, "bullish"), (selling & none_left, "risk"), (selling, "bearish")], "neutral"), num("score")),
        ("trend", two(said("trend_state") == "uptrend", said("trend_state") == "downtrend"), F.lit(None)),
        ("rsi_14", label([(num("rsi_14") >= 70, "risk"), (num("rsi_14") <= 30, "bearish"), (num("rsi_14") >= 55, "bullish")], "neutral"), num("rsi_14")),
        ("macd_histogram", two(num("macd_histogram") > 0, num("macd_histogram") < 0), num("macd_histogram")),
        ("relative_strength_20d", two(num("relative_strength_20d") > 0.02, num("relative_strength_20d") < -0.02), num("relative_strength_20d")),
        ("liquidity", label([(said("liquidity_state") == "high_liquidity", "bullish"), (said("liquidity_state") == "normal_liquidity", "neutral")], "risk"), num("traded_value_cross_section_percentile")),
        ("risk", label([((said("risk_level") == "high") | (said("ta_risk_flag") == "high") | (num("atr_pct_14") > 0.04) | (num("drawdown_from_peak") < -0.15), "risk")], "neutral"), num("drawdown_from_peak")),
        ("ta_composite", two(said("ta_action_bias") == "bullish", said("ta_action_bias") == "bearish"), num("ta_composite_score")),
        ("optimizer", label([(chosen, "bullish")], "neutral"), num("suggested_weight")),
        ("market_regime", label([(said("data_quality_status") != "pass", "blocked")], two(said("market_regime") == "bullish", said("market_regime") == "bearish")), F.lit(None)),
        ("settlement", F.when(selling | (c("action") == "HOLD_LOCKED"), label([(none_left, "blocked")], "neutral")), num("sellable")),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("signal"), verdict.alias("verdict"), value.cast("double").alias("value")) for name, verdict, value in signals])
    return df.select("symbol", by, F.explode(rows).alias("v")).select("symbol", by, "v.*").where(F.col("verdict").isNotNull())


def feature_table(features: DataFrame, min_history: int = 50, by: str = "trading_date") -> DataFrame:
    """Trend, momentum, technical and risk scores; rows of a symbol's first min_history - 1 dates are left out."""
    numbered = features.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(by)))
    scored = numbered.withColumns({
        "trend_score": (F.when(F.col("close") - F.col("sma_20") > 1e-9, 1.0).otherwise(0.0) + F.when(F.col("close") - F.col("sma_50") > 1e-9, 1.0).otherwise(0.0) + F.when(F.col("sma_20") - F.col("sma_50") > 1e-9, 1.0).otherwise(0.0)) / 3.0,
        "momentum_score": clamp(0.5 + neutral(F.col("return_20d"), 0.0) * 3.0),
        "risk_score": F.percent_rank().over(Window.partitionBy(by).orderBy(F.round("volatility_20d", 9).asc_nulls_first())),
    })
    return scored.withColumn("technical_score", (F.col("trend_score") + F.col("momentum_score")) / 2.0).where(F.col("__n") >= min_history).drop("__n")


def compact_signals(recs: DataFrame, context: DataFrame, limit: int = 50) -> DataFrame:
    """Each symbol's latest recommendation with its latest context, as nested rounded records."""
    last = recs.groupBy("symbol").agg(F.max_by(F.struct("trading_date", "recommendation", "score", "confidence", "risk_level"), "trading_date").alias("rec"))
    ctx = context.groupBy("symbol").agg(F.max_by(F.struct("trading_date", "close", "return_20d", "rsi_14", "ta_composite_score"), "trading_date").alias("ctx"))
    return last.join(ctx, "symbol", "left").select(
        "symbol", F.col("rec.trading_date").alias("as_of_date"), F.struct(F.col("rec.recommendation").alias("recommendation"), F.round("rec.score", 4).alias("score"), F.round("rec.confidence", 4).alias("confidence"), F.col("rec.risk_level").alias("risk_level")).alias("signal"),
        F.struct(F.round("ctx.close", 2).alias("close"), F.round("ctx.return_20d", 4).alias("return_20d"), F.round("ctx.rsi_14", 2).alias("rsi_14"), F.round("ctx.ta_composite_score", 4).alias("composite")).alias("context"),
    ).orderBy(F.desc("signal.score"), "symbol").limit(limit)
