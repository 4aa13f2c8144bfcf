"""Queries over delta reads, alert rules, calendars, labels, targets, market comparisons and small reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import aggregates as agg
from ..operators import indicators_chart as chart
from ..operators import indicators_mart as mart
from ..operators import joins, ledger, marts, quality
from ..operators import windows as win
from ..session import table
from ..sources import tables as src
from ..streaming import events as ev
from . import features as ft
from . import fixtures as fx
from .common import r, rounded
from .features import W, W_
from .fixtures import ctes
from .selection import _smooth_cte

SLOT, NOW = "2024-01-26 10:07:00", "2024-01-29 18:30:00"


def moment(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


def delta_slice(s: SparkSession, d: str) -> DataFrame:
    return ev.delta_slice(fx.intraday(s, d), fx.base(s, d), moment(SLOT)).select("symbol", "bar_time", "session_date")


DELTA_SLICE = ctes("intra", "base") + f"SELECT symbol, bar_time, session_date FROM intra LEFT JOIN (SELECT symbol, max(bar_time) AS l FROM base GROUP BY symbol) USING (symbol) WHERE (l IS NULL OR bar_time >= l) AND bar_time + INTERVAL 15 MINUTE <= TIMESTAMP '{SLOT}'"


def rules(s: SparkSession, d: str) -> DataFrame:
    """Every rule that looks at a table as a whole, at one moment."""
    log, bars, intra = fx.event_log(s, d), fx.bars(s, d), fx.intraday(s, d)
    counted = bars.groupBy("symbol").agg(F.count("*").alias("actual_rows"), F.max("trading_date").alias("actual_end"))
    manifest = counted.select("symbol", (F.col("actual_rows") + F.when(F.col("symbol") == "Brand#3", 1).otherwise(0)).alias("row_count"), F.col("actual_end").alias("coverage_end"), (F.col("symbol") == "Brand#4").alias("needs_merge"))
    return agg.stack({
        "heartbeat": ev.rule_heartbeat(log.where("event_type = 'scheduler_heartbeat'"), moment()), "lag": ev.rule_intraday_lag(intra, moment()), "eod": ev.rule_eod_missing(bars, moment()),
        "mismatch": ev.rule_manifest_mismatch(joins.manifest_mismatches(manifest, counted)), "merge": ev.rule_pending_merge(manifest, F.to_date(moment())),
    })


RULES = ctes("elog", "bars", "intra") + f"""SELECT 'heartbeat' AS alert_key, coalesce(epoch(TIMESTAMP '{NOW}') - floor(epoch(max(event_ts))), 1e9) > 120 AS firing FROM elog WHERE event_type = 'scheduler_heartbeat'
  UNION ALL SELECT 'intraday_lag', epoch(TIMESTAMP '{NOW}') - epoch(min(l)) > 1800 FROM (SELECT max(bar_time) AS l FROM intra GROUP BY symbol)
  UNION ALL SELECT 'eod_missing', isodow(DATE '{NOW[:10]}') < 6 AND max(trading_date) < DATE '{NOW[:10]}' FROM bars
  UNION ALL SELECT 'manifest_mismatch', count(*) > 0 FROM bars WHERE symbol = 'Brand#3' UNION ALL SELECT 'pending_merge', max(trading_date) < DATE '{NOW[:10]}' FROM bars WHERE symbol = 'Brand#4'"""


def views(s: SparkSession, d: str) -> DataFrame:
    """Latest job status and bar lag of each symbol that has either, and how many of the last failures are its own."""
    log = ev.dedupe_events(fx.event_log(s, d))
    made = ev.ops_views(log.where("event_type = 'pipeline_run'"), log.select(F.col("symbol").alias("alert_key"), "status"), fx.intraday(s, d))
    failed = made["recent_failures"].groupBy("symbol").agg(F.count("*").alias("n_failures"))
    jobs = made["latest_job_status"].select("symbol", "status", "event_ts").join(failed, "symbol", "left")
    lag = made["symbol_lag"].select("symbol", "last_bar_time", "n_bars")
    return jobs.join(lag, "symbol", "full_outer").select("symbol", "status", "event_ts", F.coalesce("n_failures", F.lit(0)).alias("n_failures"), "last_bar_time", "n_bars")


VIEWS = ctes("elog", "intra", j="SELECT symbol, arg_max(status, (event_ts, event_id)) AS status, max(event_ts) AS event_ts FROM elog WHERE event_type = 'pipeline_run' GROUP BY symbol",
    f="SELECT symbol, count(*) AS n_failures FROM (SELECT symbol FROM elog WHERE event_type = 'pipeline_run' AND status = 'failed' ORDER BY event_ts DESC, event_id DESC LIMIT 50) GROUP BY symbol", l="SELECT symbol, max(bar_time) AS last_bar_time, count(*) AS n_bars FROM intra GROUP BY symbol",
) + "SELECT symbol, status, event_ts, coalesce(n_failures, 0) AS n_failures, last_bar_time, n_bars FROM j LEFT JOIN f USING (symbol) FULL JOIN l USING (symbol)"


def acknowledged(s: SparkSession, d: str) -> DataFrame:
    """Events that acknowledge each symbol's open alert, and the state they lead to."""
    log = fx.event_log(s, d).where("event_type = 'alert_state_change'").select(F.col("symbol").alias("alert_key"), F.lit("open").alias("status"), "event_ts", F.col("event_id").cast("string").alias("event_id"))
    asked = ev.manual_transition(ev.alert_state(log), F.col("alert_key") != "U7", "acknowledged", moment("2030-01-01 00:00:00"))
    return ev.alert_state(log.unionByName(asked)).select("alert_key", "status", "first_event_ts", "acknowledged_at")


ACKNOWLEDGED = ctes("elog") + "SELECT symbol AS alert_key, CASE WHEN symbol = 'U7' THEN 'open' ELSE 'acknowledged' END AS status, min(event_ts) AS first_event_ts, CASE WHEN symbol <> 'U7' THEN TIMESTAMP '2030-01-01' END AS acknowledged_at FROM elog WHERE event_type = 'alert_state_change' GROUP BY symbol"


def missing_dates(s: SparkSession, d: str) -> DataFrame:
    """Trading days within the bars' range on which IDX_CORE's symbols have no bar at all."""
    bars = fx.bars(s, d).where(F.col("symbol").isin(fx.CORE[:2]))
    ends = bars.agg(F.min("trading_date").alias("lo"), F.max("trading_date").alias("hi")).first()
    calendar = x.trading_calendar(s, ends["lo"], ends["hi"]) if ends["lo"] else x.trading_calendar(s, date(1970, 1, 1), date(1970, 1, 1)).limit(0)
    return ev.missing_dates(calendar, bars).select("day", F.col("nth").cast("bigint").alias("nth"))


MISSING_DATES = ctes("bars", b="SELECT DISTINCT trading_date FROM bars WHERE symbol IN ('Brand#1', 'Brand#2')", cal="SELECT day, row_number() OVER (ORDER BY day) AS nth FROM (SELECT CAST(unnest(generate_series((SELECT min(trading_date) FROM b)::TIMESTAMP, (SELECT max(trading_date) FROM b)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) < 6") + "SELECT day, nth FROM cal WHERE day NOT IN (SELECT trading_date FROM b)"


def labels(s: SparkSession, d: str) -> DataFrame:
    df = chart.macd(chart.rsi(fx.bars(s, d)).select("symbol", "trading_date", "close", "rsi")).withColumns({"fast": chart.sma(20), "slow": chart.sma(50)})
    near = lambda c: F.round(c, 6)
    return df.select("symbol", "trading_date", x.trend_label(near(F.col("close")), near(F.col("fast")), near(F.col("slow"))).alias("trend"), x.rsi_label(near(F.col("rsi"))).alias("rsi_said"), x.macd_label(near(F.col("macd")), near(F.col("macd_signal"))).alias("macd_said"))


_LABELS = {"mv": f"SELECT symbol, trading_date, close, greatest(close - pc, CASE WHEN pc IS NOT NULL THEN 0.0 END) AS gain, greatest(pc - close, CASE WHEN pc IS NOT NULL THEN 0.0 END) AS loss FROM (SELECT *, lag(close) OVER {W} AS pc FROM bars)"}
_LABELS |= _smooth_cte("sm", "mv", {"gain": ("gain", 1 / 14), "loss": ("loss", 1 / 14), "e12": ("close", 2.0 / 13), "e26": ("close", 2.0 / 27)})
_LABELS["mc"] = "SELECT symbol, trading_date, y_e12 - y_e26 AS macd, CASE WHEN n_gain >= 14 THEN round(100 - 100 / (1 + y_gain / nullif(y_loss, 0)), 6) END AS rsi FROM sm"
_LABELS |= _smooth_cte("sg", "mc", {"s": ("macd", 0.2)})
_LABELS["av"] = f"SELECT symbol, trading_date, round(close, 6) AS px, CASE WHEN count(close) OVER {W_(20)} >= 6 THEN round(avg(close) OVER {W_(20)}, 6) END AS fast, CASE WHEN count(close) OVER {W_(50)} >= 16 THEN round(avg(close) OVER {W_(50)}, 6) END AS slow FROM bars"
LABELS = ctes("bars", **_LABELS).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT symbol, trading_date, CASE WHEN px > fast AND fast > slow THEN 'uptrend' WHEN px < fast AND fast < slow THEN 'downtrend' ELSE 'sideways' END AS trend,
    CASE WHEN rsi IS NULL THEN 'n/a' WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' WHEN rsi >= 55 THEN 'bullish' WHEN rsi <= 45 THEN 'bearish' ELSE 'neutral' END AS rsi_said,
    CASE WHEN m > g THEN 'bullish cross' WHEN m < g THEN 'bearish cross' ELSE 'flat' END AS macd_said
  FROM (SELECT symbol, trading_date, px, fast, slow, rsi, round(macd, 6) AS m, round(y_s, 6) AS g FROM av JOIN mc USING (symbol, trading_date) JOIN sg USING (symbol, trading_date))"""


def keltner_levels(s: SparkSession, d: str) -> DataFrame:
    df = chart.keltner(fx.bars(s, d)).withColumns({"place": chart.normalize_0_100("close"), "level": chart.bounded(F.col("close"), 900.0, 1000.0)})
    return rounded(df.select("symbol", "trading_date", "keltner_middle", "keltner_upper", "keltner_lower", "place", "level"))


_KELTNER = {"mv": f"SELECT symbol, trading_date, close, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER {W} AS pc FROM bars)", **_smooth_cte("sm", "mv", {"m": ("close", 2.0 / 21), "tr": ("tr", 1 / 20)})}
_KELTNER["q"] = f"SELECT symbol, trading_date, CASE WHEN count(close) OVER {W_(120)} >= 30 THEN quantile_cont(close, 0.05) OVER {W_(120)} END AS q05, CASE WHEN count(close) OVER {W_(120)} >= 30 THEN quantile_cont(close, 0.95) OVER {W_(120)} END AS q95 FROM bars"
KELTNER = ctes("bars", **_KELTNER).replace("WITH ", "WITH RECURSIVE ", 1) + f"""SELECT symbol, trading_date, {r('keltner_middle keltner_upper keltner_lower place level')} FROM (
  SELECT symbol, trading_date, y_m AS keltner_middle, CASE WHEN n_tr >= 20 THEN y_m + 2 * y_tr END AS keltner_upper, CASE WHEN n_tr >= 20 THEN y_m - 2 * y_tr END AS keltner_lower,
    CASE WHEN q95 - q05 <> 0 THEN least(100.0, greatest(0.0, (close - q05) / (q95 - q05) * 100)) END AS place, least(100.0, greatest(0.0, (close - 900) / 100 * 100)) AS level
  FROM sm JOIN mv USING (symbol, trading_date) JOIN q USING (symbol, trading_date))"""


def overview(s: SparkSession, d: str) -> DataFrame:
    return rounded(marts.market_overview(marts.market_breadth(fx.bars(s, d)), ft.index_returns(s, d)))


OVERVIEW = ctes("bars", "idx", br=ft.BREADTH, ir=ft.returns_sql("idx")) + f"SELECT trading_date, advancers, decliners, {r('main_close second_close main_return_1d second_return_1d relative_price')} FROM (SELECT br.trading_date, advancers, decliners, a.close AS main_close, b.close AS second_close, a.return_1d AS main_return_1d, b.return_1d AS second_return_1d, b.close / nullif(a.close, 0) AS relative_price FROM br JOIN ir a ON a.trading_date = br.trading_date AND a.symbol = 'IDX_ALL' JOIN ir b ON b.trading_date = br.trading_date AND b.symbol = 'IDX_CORE')"


def strength(s: SparkSession, d: str) -> DataFrame:
    return rounded(mart.relative_price_strength(fx.bars(s, d), fx.index_bars(s, d).where("symbol = 'IDX_ALL'"), 20))


STRENGTH = ctes("bars", "idx", c="SELECT b.symbol, trading_date, b.close, i.close AS ic FROM bars b JOIN (SELECT trading_date, close FROM idx WHERE symbol = 'IDX_ALL') i USING (trading_date)") + f"SELECT symbol, trading_date, {r('price_ratio ratio_change strength')} FROM (SELECT *, price_ratio / nullif(lag(price_ratio, 20) OVER {W}, 0) - 1 AS ratio_change, (close / nullif(lag(close, 20) OVER {W}, 0) - 1) - (ic / nullif(lag(ic, 20) OVER {W}, 0) - 1) AS strength FROM (SELECT *, close / nullif(ic, 0) AS price_ratio FROM c))"


def weighted_moves(s: SparkSession, d: str) -> DataFrame:
    b = fx.bars(s, d).withColumns({"ret": win.lag_return("close", 1, win.window_spec()), "weight": F.col("volume") / 1000.0})
    return rounded(b.select("symbol", "trading_date", win.shifted_weight_return("weight", "ret").alias("moved")))


WEIGHTED = ctes("bars") + f"SELECT symbol, trading_date, {r('moved')} FROM (SELECT symbol, trading_date, coalesce(lag(volume / 1000.0) OVER {W}, 0.0) * (close / nullif(lag(close) OVER {W}, 0) - 1) AS moved FROM bars)"


def last_lows(s: SparkSession, d: str) -> DataFrame:
    """The 25 bars of the least returns, those without one last."""
    b = fx.bars(s, d).withColumn("ret", F.round(win.lag_return("close", 1, win.window_spec()), 9))
    return rounded(agg.order_nulls_last(b, ("ret", False), ("symbol", False), ("trading_date", True)).limit(25).select("symbol", "trading_date", "ret"))


LAST_LOWS = ctes("bars") + f"SELECT symbol, trading_date, {r('ret')} FROM (SELECT symbol, trading_date, round(close / nullif(lag(close) OVER {W}, 0) - 1, 9) AS ret FROM bars) ORDER BY ret NULLS LAST, symbol, trading_date DESC LIMIT 25"


def likeness(s: SparkSession, d: str) -> DataFrame:
    """How alike the symbols of each account's purchases and sales are."""
    sides = fx.ledger(s, d).groupBy("account_id").agg(F.collect_set(F.when(F.col("action") == "BUY", F.col("symbol"))).alias("a"), F.collect_set(F.when(F.col("action") == "SELL", F.col("symbol"))).alias("b"))
    return rounded(sides.select("account_id", agg.jaccard(F.col("a"), F.col("b")).alias("likeness")))


LIKENESS = ctes("ledger") + f"SELECT account_id, {r('likeness')} FROM (SELECT account_id, count(*) FILTER (WHERE b AND s)::DOUBLE / count(*) AS likeness FROM (SELECT account_id, symbol, bool_or(action = 'BUY') AS b, bool_or(action = 'SELL') AS s FROM ledger GROUP BY ALL) GROUP BY account_id)"


def plans(s: SparkSession, d: str) -> DataFrame:
    """Each account as a plan with its orders as items, and how many of its last 50 trades are sales."""
    orders = fx.ledger(s, d)
    accounts = orders.select(F.col("account_id").alias("plan_id")).distinct()
    counted = ledger.plan_summary(accounts, orders.where("action = 'SELL'").select(F.col("account_id").alias("plan_id")))
    recent = ledger.trade_history(orders, 7).groupBy("account_id").agg(F.count_if(F.col("action") == "SELL").alias("recent_sales"))
    return counted.join(recent, F.col("plan_id") == F.col("account_id"), "left").select("plan_id", "n_items", "recent_sales")


PLANS = ctes("ledger") + "SELECT account_id AS plan_id, count(*) FILTER (WHERE action = 'SELL') AS n_items, any_value(rs) AS recent_sales FROM ledger LEFT JOIN (SELECT account_id, count(*) FILTER (WHERE action = 'SELL') AS rs FROM (SELECT * FROM ledger WHERE account_id = 7 ORDER BY trade_date DESC, order_id DESC LIMIT 50) GROUP BY account_id) USING (account_id) GROUP BY account_id"


def expectations(s: SparkSession, d: str) -> DataFrame:
    """What is expected of the bars, and by how many trading days the ledger lags behind them."""
    b, o = fx.bars(s, d), fx.ledger(s, d).select(F.col("trade_date").alias("as_of_date"))
    made = quality.assert_expectations(b, {"no_null_close": (F.count_if(F.col("close").isNull()), 0), "high_holds_low": (F.count_if(F.col("high") < F.col("low")), 0), "one_symbol": (F.count_distinct("symbol"), 1)})
    lag = quality.recommendation_freshness(o, b.select("trading_date")).select(F.lit("ledger_lag").alias("name"), (F.col("lag_days") > 0).alias("passed"))
    return made.unionByName(lag)


EXPECTATIONS = ctes("bars", "ledger") + "SELECT 'no_null_close' AS name, count(*) FILTER (WHERE close IS NULL) = 0 AS passed FROM bars UNION ALL SELECT 'high_holds_low', count(*) FILTER (WHERE high < low) = 0 FROM bars UNION ALL SELECT 'one_symbol', count(DISTINCT symbol) = 1 FROM bars UNION ALL SELECT 'ledger_lag', (SELECT max(trade_date) FROM ledger) < (SELECT max(trading_date) FROM bars)"


def counts(s: SparkSession, d: str) -> DataFrame:
    """The catalog with the number of columns of each table, and what is read from the documents' texts."""
    names = ["nation", "region", "orders", "documents"]
    frames = {n: table(s, d, n) for n in names}
    listed = src.catalog(frames).select("table_name", "n_rows")
    columns = None
    for name, frame in frames.items():
        part = frame.limit(1).select(F.lit(name).alias("table_name"), F.explode(F.array(*map(F.lit, frame.columns))).alias("column_name"))
        columns = part if columns is None else columns.unionByName(part)
    return joins.catalog_with_counts(listed, columns).select("table_name", "n_rows", F.col("n_columns").cast("bigint").alias("n_columns"))


COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows, CASE WHEN (SELECT count(*) FROM {n}) > 0 THEN (SELECT count(*) FROM (DESCRIBE {n})) ELSE 0 END AS n_columns" for n in ("nation", "region", "orders", "documents"))


def read_from_texts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents")
    return rounded(t.select("doc_id", F.size(x.extract_dates(F.coalesce("text", F.lit("")))).alias("n_dates"), x.finite(x.parse_number(F.regexp_extract(F.coalesce("text", F.lit("")), r"[0-9]{1,9}", 0))).alias("first_number")))


TEXTS = f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b')) AS INT) AS n_dates, round(try_cast(nullif(regexp_extract(coalesce(text, ''), '[0-9]{{1,9}}'), '') AS DOUBLE) + 3e-10, 6) + 0.0 AS first_number FROM documents"


def hourly(s: SparkSession, d: str) -> DataFrame:
    """The stored and the delta bars as two chunks, the later one winning, and only sound rows."""
    a, b = fx.base(s, d).withColumn("seq", F.lit(1)), fx.delta(s, d).withColumn("seq", F.lit(2)).drop("session_date")
    return rounded(src.standardize_hourly([a, b], "made").select("symbol", "bar_time", "open", "high", "low", "close", "volume"))


HOURLY = ctes("base", "delta", u="SELECT symbol, bar_time, open, high, low, close, volume, 1 AS seq FROM base UNION ALL SELECT symbol, bar_time, open, high, low, close, volume, 2 FROM delta") + f"SELECT symbol, bar_time, {r('open high low close volume')} FROM (SELECT symbol, bar_time, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, volume FROM u WHERE least(open, high, low, close) > 0 AND volume >= 0 QUALIFY row_number() OVER (PARTITION BY symbol, bar_time ORDER BY seq DESC) = 1)"


def zoned(s: SparkSession, d: str) -> DataFrame:
    """Intraday bars whose times are UTC, as wall times of another zone, up to the end of a day there."""
    rows = fx.intraday(s, d).drop("session_date").withColumn("seq", F.lit(1))
    return rounded(src.standardize_intraday(rows, "made", "Asia/Bangkok", moment("2024-01-03 00:00:00"), F.lit(date(2024, 1, 20))).select("symbol", "bar_time", "session_date", "close"))


ZONED = ctes("intra") + f"SELECT symbol, bar_time, CAST(bar_time AS DATE) AS session_date, {r('close')} FROM (SELECT symbol, bar_time + INTERVAL 7 HOUR AS bar_time, close FROM intra WHERE least(open, high, low, close) > 0 AND volume >= 0) WHERE bar_time >= TIMESTAMP '2024-01-03' AND bar_time < TIMESTAMP '2024-01-21'"

QUERIES = {
    "delta_slice": delta_slice, "table_rules": rules, "ops_views": views, "acknowledged_alerts": acknowledged, "missing_dates": missing_dates, "chart_labels": labels, "chart_levels": keltner_levels, "market_overview": overview, "price_strength": strength, "shifted_weights": weighted_moves,
    "order_nulls_last": last_lows, "side_likeness": likeness, "plan_summary": plans, "expectations": expectations, "catalog_columns": counts, "read_from_texts": read_from_texts, "standardize_hourly": hourly, "standardize_intraday": zoned,
}
ORACLES = {
    "delta_slice": DELTA_SLICE, "table_rules": RULES, "ops_views": VIEWS, "acknowledged_alerts": ACKNOWLEDGED, "missing_dates": MISSING_DATES, "chart_labels": LABELS, "chart_levels": KELTNER, "market_overview": OVERVIEW, "price_strength": STRENGTH, "shifted_weights": WEIGHTED,
    "order_nulls_last": LAST_LOWS, "side_likeness": LIKENESS, "plan_summary": PLANS, "expectations": EXPECTATIONS, "catalog_columns": COUNTS, "read_from_texts": TEXTS, "standardize_hourly": HOURLY, "standardize_intraday": ZONED,
}
