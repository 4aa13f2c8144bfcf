"""Ledger analytics: costs, cash, FIFO matching, positions, settlement, equity and portfolio analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import add_trading_days, ratio, safe_return, weekday_number
from .blocks import KEY, parts_of

FEE, TAX = 0.0015, 0.001


def apply_costs(orders: DataFrame, fee: float = FEE, tax: float = TAX) -> DataFrame:
    """Gross value, fees, taxes (sales only), signed net cash and, for purchases, the average cost with the fee."""
    gross = F.col("price") * F.col("quantity")
    buy = F.col("action") == "BUY"
    df = orders.withColumns({"gross_value": gross, "fees": gross * fee, "taxes": F.when(buy, 0.0).otherwise(gross * tax)})
    return df.withColumns({"net_cash": F.when(buy, -(F.col("gross_value") + F.col("fees"))).otherwise(F.col("gross_value") - F.col("fees") - F.col("taxes")), "avg_cost": F.when(buy, ratio(F.col("gross_value") + F.col("fees"), F.col("quantity").cast("double")))})


def cash_balance(costed: DataFrame, initial_cash: float = 0.0, account: str = "account_id", rows: int | None = None) -> DataFrame:
    """The cash after each order, over parts of an account's orders."""
    parts = parts_of(costed, [account], ["trade_date", "order_id"], rows).carried(__cash=(F.sum("net_cash"), F.sum))
    cash = F.lit(initial_cash) + F.coalesce("__cash", F.lit(0.0)) + F.coalesce(F.sum("net_cash").over(parts.so_far), F.lit(0.0))
    return parts.but(parts.rows.withColumn("cash", cash).drop("__cash")).done()


def settled_at(trade_date: Column, days: int = 2, clock: str = "13:00") -> Column:
    """When what was bought on a date can be sold: on the days-th trading day after it, from that time of day on."""
    return F.to_timestamp_ntz(F.concat(add_trading_days(trade_date, days).cast("string"), F.lit(f" {clock}:00")))


def fifo_match(costed: DataFrame, keys: tuple[str, ...] = ("account_id", "symbol"), days: int = 2, clock: str = "13:00", moment: Column | None = None, rows: int | None = None) -> DataFrame:
    """(keys, buy_id, sell_id, qty, pnl): each sale takes settled units in the order they were bought. What a sale
    can't take is a row without buy_id and pnl.

    moment: when an order is placed; by default its trade date at the hour of settlement. With Q units asked for by
    sales up to one and A units settled by then, the units taken so far are Q + min(0, least A - Q up to here): what
    lacked once is never made up for. So running sums give an interval of bought units for each sale, and matches are
    the overlaps with the purchases' intervals. The sums run over parts of a key's orders, with what is carried
    into each. Both sides are cut into slices of a key's mean order quantity, so that
    the join is on key and slice instead of on all pairs of a key.
    """
    k = list(keys)
    buy = F.col("action") == "BUY"
    by_date = F.to_timestamp_ntz(F.concat(F.col("trade_date").cast("string"), F.lit(f" {clock}:00")))
    at = by_date if moment is None else F.coalesce(moment, by_date)
    timed = costed.withColumns({"__at": F.when(buy, settled_at(F.col("trade_date"), days, clock)).otherwise(at), "__sells": F.when(buy, 0).otherwise(1), "__bought_on": F.when(buy, F.col("trade_date")), "__bought": F.when(buy, F.col("quantity")).otherwise(0), "__asked": F.when(buy, 0).otherwise(F.col("quantity"))})
    # purchases settle in the order of their dates, so that one line orders both sides
    parts = parts_of(timed, k, ["__at", "__sells", "__bought_on", "order_id"], rows)
    parts = parts.carried(__q0=(F.sum("__asked"), F.sum), __a0=(F.sum("__bought"), F.sum))
    running = lambda c, before: F.sum(c).over(parts.so_far) + F.coalesce(before, F.lit(0))
    parts = parts.but(parts.rows.withColumns({"__q": running("__asked", "__q0"), "__a": running("__bought", "__a0")}))
    lacking = F.when(~buy, F.col("__a") - F.col("__q"))
    parts = parts.carried(__least=(F.min(lacking), F.min))
    least = lambda w: F.coalesce(F.least(F.lit(0), F.min(lacking).over(w), F.col("__least")), F.lit(0))
    line = parts.rows.withColumns({"__lack": least(parts.so_far), "__before": least(parts.line.rowsBetween(Window.unboundedPreceding, -1))})
    low = F.when(buy, F.col("__a") - F.col("quantity")).otherwise(F.col("__q") - F.col("quantity") + F.col("__before"))
    high = F.when(buy, F.col("__a")).otherwise(F.col("__q") + F.col("__lack"))
    steps = line.groupBy(KEY).agg(F.greatest(F.ceil(F.avg("quantity")), F.lit(1)).alias("__step"))
    placed = line.withColumns({"__lo": low, "__hi": high}).join(steps, KEY)
    short = placed.where(~buy & (F.col("__hi") - F.col("__lo") < F.col("quantity"))).select(*k, F.lit(None).cast(costed.schema["order_id"].dataType).alias("buy_id"), F.col("order_id").alias("sell_id"), (F.col("quantity") - (F.col("__hi") - F.col("__lo"))).cast("bigint").alias("qty"), F.lit(None).cast("double").alias("pnl"))
    sliced = placed.where("__hi > __lo").withColumn("__slice", F.explode(F.sequence(F.floor(F.col("__lo") / F.col("__step")), F.floor((F.col("__hi") - 1) / F.col("__step")))))
    buys = sliced.where(buy).select(*k, "__slice", "__step", F.col("order_id").alias("buy_id"), F.col("avg_cost"), F.col("__lo").alias("blo"), F.col("__hi").alias("bhi"))
    sells = sliced.where(~buy).select(*k, "__slice", F.col("order_id").alias("sell_id"), ((F.col("price") * F.col("quantity") - F.col("fees") - F.col("taxes")) / F.col("quantity")).alias("net_price"), F.col("__lo").alias("slo"), F.col("__hi").alias("shi"))
    shared = F.least("bhi", "shi", (F.col("__slice") + 1) * F.col("__step")) - F.greatest("blo", "slo", F.col("__slice") * F.col("__step"))
    met = buys.join(sells, [*k, "__slice"]).withColumn("q", shared).where("q > 0")
    matched = met.groupBy(*k, "buy_id", "sell_id").agg(F.sum("q").cast("bigint").alias("qty"), F.sum(F.col("q") * (F.col("net_price") - F.col("avg_cost"))).alias("pnl"))
    return matched.unionByName(short)


def filled(costed: DataFrame, matches: DataFrame, fee: float = FEE, tax: float = TAX) -> DataFrame:
    """Orders as they took place: of a sale what fifo_match() found for it, possibly none; `asked` is the quantity
    ordered, and costs and cash are those of what was sold."""
    sold = matches.where("buy_id IS NOT NULL").groupBy(F.col("sell_id").alias("order_id")).agg(F.sum("qty").alias("__sold"))
    met = costed.withColumnRenamed("quantity", "asked").join(sold, "order_id", "left")
    took = F.when(F.col("action") == "BUY", F.col("asked")).otherwise(F.coalesce("__sold", F.lit(0)))
    return apply_costs(met.withColumn("quantity", took).drop("__sold"), fee, tax)


def open_lots(costed: DataFrame, matches: DataFrame) -> DataFrame:
    """Purchases with what is left of them."""
    used = matches.groupBy("buy_id").agg(F.sum("qty").alias("__used"))
    buys = costed.where("action = 'BUY'").join(used, F.col("order_id") == F.col("buy_id"), "left")
    return buys.select("order_id", "account_id", "symbol", "trade_date", "avg_cost", "quantity", (F.col("quantity") - F.coalesce("__used", F.lit(0))).alias("remaining_quantity"))


def positions(lots: DataFrame) -> DataFrame:
    kept = lots.where("remaining_quantity > 0")
    made = kept.groupBy("account_id", "symbol").agg(F.sum("remaining_quantity").alias("quantity"), F.sum(F.col("remaining_quantity") * F.col("avg_cost")).alias("cost_basis"), F.min("trade_date").alias("first_buy"), F.max("trade_date").alias("last_buy"))
    return made.withColumn("avg_cost", ratio(F.col("cost_basis"), F.col("quantity").cast("double")))


def settlement_buckets(lots: DataFrame, now: Column, days: int = 2, clock: str = "13:00") -> DataFrame:
    """Open quantity at a moment: what is settled can be sold; the rest by the trading days since it was bought (t0,
    t1, t2 for two and more)."""
    kept = lots.where("remaining_quantity > 0").withColumns({"__settled": settled_at(F.col("trade_date"), days, clock) <= now, "__age": F.when(F.col("trade_date") >= F.to_date(now), 0).otherwise(weekday_number(F.to_date(now)) - weekday_number(F.col("trade_date")))})
    q, waits = F.col("remaining_quantity"), ~F.col("__settled")
    return kept.groupBy("account_id", "symbol").agg(*[F.coalesce(F.sum(F.when(c, q)), F.lit(0)).alias(n) for n, c in {"sellable": F.col("__settled"), "t0": waits & (F.col("__age") <= 0), "t1": waits & (F.col("__age") == 1), "t2": waits & (F.col("__age") > 1)}.items()])


def equity(held: DataFrame, cash: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value, unrealised profit and equity by account."""
    met = held.join(prices, "symbol", "left").withColumn("market_value", F.col("quantity") * F.col("price"))
    made = met.groupBy("account_id").agg(F.sum("market_value").alias("market_value"), F.sum(F.col("market_value") - F.col("cost_basis")).alias("unrealised_pnl"))
    return cash.join(made, "account_id", "left").withColumn("equity", F.col("cash") + F.coalesce("market_value", F.lit(0.0)))


def portfolio_analysis(held: DataFrame, prices: DataFrame, fee: float = FEE, tax: float = TAX) -> DataFrame:
    """Gross and, if closed now, net profit of positions, by account with winners and losers."""
    met = held.join(prices, "symbol", "left")
    value = F.col("quantity") * F.col("price")
    met = met.withColumns({"market_value": value, "gross_pnl": value - F.col("cost_basis"), "net_pnl": value * (1 - fee - tax) - F.col("cost_basis")})
    return met.groupBy("account_id").agg(
        F.count("*").alias("n_positions"), F.sum("cost_basis").alias("cost_basis"), F.sum("market_value").alias("market_value"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("net_pnl").alias("net_pnl"),
        F.count_if(F.col("gross_pnl") > 1e-9).alias("winners"), F.count_if(F.col("gross_pnl") < -1e-9).alias("losers"),
    ).withColumn("net_return", safe_return(F.col("net_pnl") + F.col("cost_basis"), F.col("cost_basis")))


def trade_history(orders: DataFrame, account: int, limit: int = 50) -> DataFrame:
    return orders.where(F.col("account_id") == account).orderBy(F.desc("trade_date"), F.desc("order_id")).limit(limit)


def order_costs(costed: DataFrame) -> DataFrame:
    return costed.groupBy("account_id").agg(F.sum(F.col("fees") + F.col("taxes")).alias("transaction_cost"), F.count_if(F.col("quantity") <= 0).alias("rejected"), F.count("*").alias("n_orders"))


def plan_summary(plans: DataFrame, items: DataFrame) -> DataFrame:
    counted = items.groupBy("plan_id").agg(F.count("*").alias("n_items"))
    return plans.join(counted, "plan_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
