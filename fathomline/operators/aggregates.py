"""Aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio, safe_return


def coverage(df: DataFrame, key: str = "symbol", time: str = "trading_date") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def cond_sum(col: Column, when: Column) -> Column:
    return F.sum(F.when(when, col))


def cond_avg(col: Column, when: Column) -> Column:
    return F.avg(F.when(when, col))


def first_last_by(df: DataFrame, key: str, time: str, cols: list[str]) -> DataFrame:
    """First and last values in time, nulls left out."""
    return df.groupBy(key).agg(*[f(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(f"{n}_{c}") for c in cols for n, f in (("first", F.min_by), ("last", F.max_by))])


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key. Counted in two levels, so that no task holds all keys."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def coverage_floor(df: DataFrame, key: str, time: str) -> DataFrame:
    """The earliest of the keys' last times."""
    return df.groupBy(key).agg(F.max(time).alias("last")).agg(F.min("last").alias("floor"), F.max("last").alias("ceiling"), F.count("*").alias("n_keys"))


def distinct_list(col: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(col)), ",")


def status_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def success_rate(runs: DataFrame, by: str) -> DataFrame:
    return runs.groupBy(by).agg(F.count("*").alias("n_runs"), (F.avg(F.when(F.col("status") == "ok", 1.0).otherwise(0.0)) * 100).alias("success_rate"))


def covariance_pairs(returns: DataFrame, lookback: int = 252, min_obs: int = 20, per_year: int = 252, key: str = "symbol", order: str = "trading_date", default: float = 0.04) -> DataFrame:
    """(i, j, cov, n) of the last returns, i <= j; pairs of few common dates are 0, non-positive variances the median
    of the positive ones. The self-join is on the date: a symbol list bounds its pairs a date."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    kept = returns.where(F.col("log_return_1d").isNotNull()).withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= lookback).select(F.col(key), F.col(order), F.col("log_return_1d").alias("x"))
    other = kept.select(F.col(key).alias("j"), F.col(order), F.col("x").alias("y"))
    pairs = kept.withColumnRenamed(key, "i").join(other, order).where("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))
    pairs = pairs.withColumn("cov", F.when(F.col("n") >= min_obs, F.coalesce("cov", F.lit(0.0)) * per_year).otherwise(0.0))
    usual = pairs.where("i = j AND cov > 0").agg(F.coalesce(F.percentile("cov", 0.5), F.lit(default)).alias("usual"))
    return pairs.join(F.broadcast(usual), F.lit(True)).select("i", "j", F.when((F.col("i") == F.col("j")) & (F.col("cov") <= 0), F.col("usual")).otherwise(F.col("cov")).alias("cov"), "n")


def nav_series(nav: DataFrame, key: str = "run_id", order: str = "trade_date", choices: tuple[str, str] | None = None) -> DataFrame:
    """Daily return, running peak, drawdown and exposure; with two array columns of choices, their agreement (1 if
    both are empty)."""
    if choices is not None:
        nav = nav.withColumn("agreement", F.coalesce(jaccard(*map(F.col, choices)), F.lit(1.0)))
    w = Window.partitionBy(key).orderBy(order)
    peak = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return nav.withColumns({"daily_return": safe_return(F.col("nav"), F.lag("nav").over(w)), "peak": peak, "drawdown": safe_return(F.col("nav"), peak), "exposure": ratio(F.col("market_value"), F.col("nav"))})


def nav_metrics(series: DataFrame, periods: int = 252, key: str = "run_id", order: str = "trade_date", initial_cash: float | None = None) -> DataFrame:
    """Returns start from initial_cash, or from the first day's value. A turnover column is summed and an agreement
    column averaged, where the series has them."""
    more = [f(c).alias(n) for c, n, f in (("turnover", "turnover", F.sum), ("agreement", "mean_agreement", F.avg)) if c in series.columns]
    made = series.groupBy(key).agg(
        *more,
        F.count("*").alias("n"), F.min_by("nav", order).alias("first_nav"), F.max_by("nav", order).alias("last_nav"), F.avg("daily_return").alias("mean"), F.stddev_samp("daily_return").alias("std"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("daily_return").isNotNull(), F.when(F.col("daily_return") > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.avg("exposure").alias("mean_exposure"),
    )
    total = safe_return(F.col("last_nav"), F.col("first_nav") if initial_cash is None else F.lit(initial_cash))
    return made.select(
        key, "n", total.alias("total_return"), (F.pow(1 + total, F.lit(float(periods)) / F.col("n")) - 1).alias("annualised_return"), (F.col("std") * math.sqrt(periods)).alias("volatility"),
        ratio(F.col("mean") * math.sqrt(periods), F.col("std")).alias("sharpe"), "max_drawdown", "win_rate", "mean_exposure",
        *[c for c in ("turnover", "mean_agreement") if c in made.columns],
    )


def coverage_report(df: DataFrame, manifest: DataFrame, key: str = "symbol", time: str = "trading_date") -> DataFrame:
    return coverage(df, key, time).join(manifest.groupBy(key).agg(F.sum("row_count").alias("manifest_rows")), key, "full_outer")


def basket_return(decisions: DataFrame, returns: DataFrame, weight_col: str | None = None, fees: tuple[float, float, float] = (0.0015, 0.0015, 0.001)) -> DataFrame:
    """Equal- or score-weighted return of a date's basket, gross and after buying and selling."""
    buy, sell, tax = fees
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    met = decisions.join(returns, "symbol").withColumn("__w", weight)
    made = met.groupBy("as_of_date").agg(ratio(F.sum(F.col("__w") * F.col("period_return")), F.sum("__w")).alias("gross_return"), F.count("*").alias("n_names"))
    return made.withColumn("net_return", (1 + F.col("gross_return")) * (1 - buy) * (1 - sell - tax) - 1)


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))


def stack(frames: dict[str, DataFrame], tag: str | None = None) -> DataFrame:
    out = None
    for name, frame in frames.items():
        part = frame.withColumn(tag, F.lit(name)) if tag else frame
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def order_nulls_last(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """keys: (column, descending)."""
    return df.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in keys])


def rank_of(col: Column, ranking: list[str]) -> Column:
    """Place in a ranking; what isn't in it comes last."""
    place = F.array_position(F.array(*map(F.lit, ranking)), col)
    return F.when(F.coalesce(place, F.lit(0)) > 0, place).otherwise(len(ranking) + 1).cast("int")


def order_by_rank(df: DataFrame, col: str, ranking: list[str], *more: Column) -> DataFrame:
    return df.orderBy(rank_of(F.col(col), ranking), *more)


def top_k(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def top_n_per_group(df: DataFrame, by: list[str], keys: list[Column], n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("nth") <= n)
