"""Window operators over keyed, ordered rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import ratio, safe_return


def window_spec(key: str | list[str] = "symbol", order: str = "trading_date", rows: int | None = None) -> WindowSpec:
    """Rows of a key in order; the last `rows` of them, this one included, or all up to this one's peers."""
    spec = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)
    return spec if rows is None else spec.rowsBetween(-(rows - 1), 0)


def gated(value: Column, over: Column, min_obs: int) -> Column:
    """value where at least min_obs inputs stand in the frame."""
    return value if min_obs <= 1 else F.when(over >= min_obs, value)


def lag_return(col: str, n: int, w: WindowSpec) -> Column:
    return safe_return(F.col(col), F.lag(col, n).over(w))


def log_return(col: str, w: WindowSpec) -> Column:
    move = ratio(F.col(col), F.lag(col, 1).over(w))
    return F.when(move > 0, F.ln(move))


def sequence(df: DataFrame, key: str = "symbol", order: str = "trading_date") -> DataFrame:
    return df.withColumn("rn", F.row_number().over(window_spec(key, order)))


def dedupe_by_priority(df: DataFrame, keys: list[str], order_desc: list[str]) -> DataFrame:
    """The row of each key that comes first in falling order, nulls last."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order_desc])
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def last_n_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n).drop("__nth")


def rolling_mean(col: str | Column, n: int, key: str | list[str] = "symbol", order: str = "trading_date", min_obs: int = 1) -> Column:
    w = window_spec(key, order, n)
    return gated(F.avg(col).over(w), F.count(col).over(w), min_obs)


def rolling_std(col: str | Column, n: int, key: str | list[str] = "symbol", order: str = "trading_date", when: Column | None = None, min_obs: int = 1) -> Column:
    value = col if isinstance(col, Column) else F.col(col)
    value = value if when is None else F.when(when, value)
    w = window_spec(key, order, n)
    return gated(F.stddev_samp(value).over(w), F.count(value).over(w), min_obs)


def rolling_min(col: str | Column, n: int, key: str | list[str] = "symbol", order: str = "trading_date", min_obs: int = 1) -> Column:
    w = window_spec(key, order, n)
    return gated(F.min(col).over(w), F.count(col).over(w), min_obs)


def rolling_max(col: str | Column, n: int, key: str | list[str] = "symbol", order: str = "trading_date", min_obs: int = 1) -> Column:
    w = window_spec(key, order, n)
    return gated(F.max(col).over(w), F.count(col).over(w), min_obs)


def rolling_sum(col: str | Column, n: int, key: str | list[str] = "symbol", order: str = "trading_date", min_obs: int = 1) -> Column:
    w = window_spec(key, order, n)
    return gated(F.sum(col).over(w), F.count(col).over(w), min_obs)


def running_max(col: str, key: str | list[str] = "symbol", order: str = "trading_date") -> Column:
    return F.max(col).over(window_spec(key, order).rowsBetween(Window.unboundedPreceding, 0))


def running_sum(col: str | Column, key: str | list[str] = "symbol", order: str = "trading_date", frame: str = "range") -> Column:
    """frame range: rows of the same order value share a value."""
    w = window_spec(key, order)
    return F.sum(col).over(w if frame == "range" else w.rowsBetween(Window.unboundedPreceding, 0))


def cross_section_rank(by: str, col: str | Column) -> Column:
    """percent_rank among the rows of one date, nulls first."""
    value = F.col(col) if isinstance(col, str) else col
    return F.percent_rank().over(Window.partitionBy(by).orderBy(value.asc_nulls_first()))


def rolling_beta_corr(x: str, y: str, n: int, key: str | list[str] = "symbol", order: str = "trading_date") -> tuple[Column, Column]:
    """Beta of x to y, and their correlation from covariance and deviations (null without variance)."""
    w = window_spec(key, order, n)
    cov = F.covar_samp(x, y).over(w)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    spread = F.stddev_samp(F.when(both, F.col(x))).over(w) * F.stddev_samp(F.when(both, F.col(y))).over(w)
    return ratio(cov, F.var_samp(y).over(w)), ratio(cov, spread)


def rolling_mean_global(col: str, n: int, order: str = "trading_date", partition: str | None = None) -> Column:
    """For one series of a row a day; other inputs need a partition."""
    spec = (Window.partitionBy(partition) if partition else Window.partitionBy()).orderBy(order)
    return F.avg(col).over(spec.rowsBetween(-(n - 1), 0))


def slope(ma_col: str, n: int, key: str | list[str] = "symbol", order: str = "trading_date") -> Column:
    return safe_return(F.col(ma_col), F.lag(ma_col, n).over(window_spec(key, order)))


def rolling_abs_dev(x: str, centre: str, n: int, key: str | list[str] = "symbol", order: str = "trading_date") -> Column:
    """Mean distance of each row to its own centre."""
    return F.avg(F.abs(F.col(x) - F.col(centre))).over(window_spec(key, order, n))


def session_cumsum(col: str | Column, key: str | list[str] = "symbol", session: str = "session_date", order: str = "bar_time") -> Column:
    return F.sum(col).over(window_spec([key, session], order).rowsBetween(Window.unboundedPreceding, 0))


def rolling_quantile(col: str, n: int, p: float, key: str | list[str] = "symbol", order: str = "trading_date", min_obs: int = 30) -> Column:
    w = window_spec(key, order, n)
    return gated(F.percentile(col, p).over(w), F.count(col).over(w), min_obs)


def forward_target(col: str, n: int = 5, key: str | list[str] = "symbol", order: str = "trading_date") -> tuple[Column, Column]:
    """Return over the next n rows, and whether it is positive. For training only."""
    move = safe_return(F.lead(col, n).over(window_spec(key, order)), F.col(col))
    return move, (move > 0).cast("int")


def shifted_weight_return(weight: str, ret: str, key: str = "symbol", order: str = "trading_date") -> Column:
    return F.coalesce(F.lag(weight, 1).over(window_spec(key, order)), F.lit(0.0)) * F.col(ret)


def scanned(df: DataFrame, key: str, order: str, inputs: dict[str, Column], start: Column, step: Callable[[Column, Column], Column], names: list[str], block: int = 256) -> DataFrame:
    """df with the named fields of a state that is carried along each key's rows in order: state' = step(state, row).

    For states that don't compose (else see blocks.block_scan): a key's rows stand in one array. inputs: what step
    reads of a row; start: the state (a struct of doubles, booleans, ...) before the first row. A fold of folds walks
    the array in the JVM: the inner one collects a block of states, the outer one the blocks, which are put together
    once, at the end.
    """
    kind = df.select(start.alias("s")).schema["s"].dataType.simpleString()  # as text, which makes all fields nullable
    picked = F.struct(F.col(order), F.struct(*[c.alias(n) for n, c in inputs.items()]).alias("x"), F.struct(*df.columns).alias("row"))
    rows = df.groupBy(key).agg(F.sort_array(F.collect_list(picked)).alias("rows"))
    none = F.array().cast(f"array<{kind}>")

    def within(done: Column, part: Column) -> Column:
        first = F.struct(done["state"].alias("state"), none.alias("out"))

        def one(at: Column, row: Column) -> Column:
            now = step(at["state"], row["x"]).cast(kind)
            return F.struct(now.alias("state"), F.concat(at["out"], F.array(now)).alias("out"))

        made = F.aggregate(part, first, one)
        return F.struct(made["state"].alias("state"), F.concat(done["out"], F.array(made["out"])).alias("out"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / block).cast("int")), lambda i: F.slice("rows", i * block + 1, F.lit(block)))
    states = F.aggregate(parts, F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), within, lambda s: F.flatten(s["out"]))
    zipped = rows.select(F.explode(F.zip_with("rows", states, lambda r, s: F.struct(r["row"].alias("row"), s.alias("state")))).alias("z"))
    return zipped.select("z.row.*", *[F.col(f"z.state.{n}").alias(n) for n in names])
