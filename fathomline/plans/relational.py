"""Queries over expressions, joins, aggregations, windows, merging, quality and event logs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import aggregates as agg
from ..operators import joins, merge, quality
from ..operators import windows as win
from ..operators.blocks import Parts, framed
from ..session import table
from ..sources import tables as src
from ..streaming import events as ev
from . import features as ft
from . import fixtures as fx
from .common import r, rounded
from .fixtures import ctes

D0, D1, D2 = date(1996, 6, 28), date(1997, 6, 30), date(1998, 6, 30)


def staging(s: SparkSession, d: str) -> DataFrame:
    staged = x.stage(fx.bars(s, d).withColumn("symbol", F.lower("symbol")), {"symbol": "string", "trading_date": "date", "close": "double", "volume": "bigint"})
    return rounded(staged.where(x.bar_filter(start=D0, end=D2) & x.in_set(F.col("symbol"), ["BRAND#1"], negate=True)).withColumns({
        "symbol_date_key": x.surrogate_key("symbol", "trading_date"), "unit_price": x.to_unit_price(F.col("close")), "lots": x.floor_lot(F.col("volume"), 10), "clamped": x.clamp(F.col("close") / 1000.0, 0.91, 0.95),
        "days": x.day_diff(F.lit(D2), F.col("trading_date")), "content": x.content_hash(F.col("symbol")), "row_sha1": x.sha1_id(F.col("symbol"), F.col("trading_date")),
    }))


STAGING = ctes("bars") + """SELECT symbol, trading_date, round(close + 3e-10, 6) + 0.0 AS close, volume, symbol || '|' || CAST(trading_date AS VARCHAR) AS symbol_date_key, round(CASE WHEN close > 0 AND close < 1000 THEN close * 1000 ELSE close END + 3e-10, 6) + 0.0 AS unit_price,
  CAST(floor(volume / 10) * 10 AS BIGINT) AS lots, round(least(0.95, greatest(0.91, close / 1000)) + 3e-10, 6) + 0.0 AS clamped, CAST(date_diff('day', trading_date, DATE '1998-06-30') AS INT) AS days, sha256(symbol) AS content, sha1(symbol || '|' || CAST(trading_date AS VARCHAR)) AS row_sha1
  FROM (SELECT upper(symbol) AS symbol, trading_date, close, CAST(volume AS BIGINT) AS volume FROM bars) WHERE trading_date BETWEEN DATE '1996-06-28' AND DATE '1998-06-30' AND symbol NOT IN ('BRAND#1')"""


def calendar_gaps(s: SparkSession, d: str) -> DataFrame:
    days = fx.bars(s, d).select("trading_date").distinct()
    return days.select("trading_date", x.trading_day_gap(F.col("trading_date"), F.lit(D2)).alias("gap"), x.add_trading_days(F.col("trading_date"), 3).alias("plus3"), x.previous_trading_day(F.col("trading_date")).alias("before"))


_WD = "(floor(date_diff('day', DATE '1970-01-05', {0}) / 7.0) * 5 + least(date_diff('day', DATE '1970-01-05', {0}) - floor(date_diff('day', DATE '1970-01-05', {0}) / 7.0) * 7, 4))"
_T = _WD.format("trading_date")
CALENDAR = ctes("bars") + f"""SELECT trading_date, CAST({_WD.format("DATE '1998-06-30'")} - {_T} AS INT) AS gap, CAST(DATE '1970-01-05' + CAST(floor(({_T} + 3) / 5.0) * 7 + ({_T} + 3) - floor(({_T} + 3) / 5.0) * 5 AS INT) AS DATE) AS plus3,
  CAST(trading_date - CASE WHEN isodow(trading_date) = 1 THEN 3 WHEN isodow(trading_date) = 7 THEN 2 ELSE 1 END AS DATE) AS before FROM (SELECT DISTINCT trading_date FROM bars)"""

SLOTS = ["09:15", "09:30", "10:00", "11:15", "13:00", "14:45"]


def sessions(s: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    e = table(s, d, "events")
    return e.select("event_id", x.session_state(ts).alias("state"), x.latest_slot(ts, SLOTS).alias("slot"), F.size(x.due_slots(ts, SLOTS, 3)).alias("n_due"), x.minute_of(ts).alias("minute"), x.json_field(F.col("props"), "k", "int").alias("k"))


SESSIONS = """SELECT event_id, CASE WHEN isodow(ts) >= 6 THEN 'closed' WHEN c < '09:15' THEN 'pre' WHEN c <= '11:30' THEN 'morning' WHEN c < '13:00' THEN 'lunch' WHEN c <= '15:00' THEN 'afternoon' ELSE 'post' END AS state,
  CASE WHEN c >= '14:45' THEN '14:45' WHEN c >= '13:00' THEN '13:00' WHEN c >= '11:15' THEN '11:15' WHEN c >= '10:00' THEN '10:00' WHEN c >= '09:30' THEN '09:30' WHEN c >= '09:15' THEN '09:15' END AS slot,
  CAST(least(3, (c >= '09:15')::INT + (c >= '09:30')::INT + (c >= '10:00')::INT + (c >= '11:15')::INT + (c >= '13:00')::INT + (c >= '14:45')::INT) AS INT) AS n_due, CAST(minute(ts) AS INT) AS minute, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM (SELECT *, strftime(ts, '%H:%M') AS c FROM events)"""


def asof_quotes(s: SparkSession, d: str) -> DataFrame:
    o = fx.ledger(s, d).select("order_id", F.concat(F.lit("Brand#"), (F.col("order_id") % 25 + 1).cast("string")).alias("symbol"), "trade_date")
    return rounded(joins.asof_join(o, fx.bars(s, d), "symbol", "trade_date", "trading_date", ["trading_date", "close"]))


ASOF = ctes("bars", "ledger") + "SELECT order_id, o.symbol, trade_date, b.trading_date AS asof_trading_date, round(b.close + 3e-10, 6) + 0.0 AS asof_close FROM (SELECT order_id, 'Brand#' || CAST(order_id % 25 + 1 AS VARCHAR) AS symbol, trade_date FROM ledger) o ASOF LEFT JOIN bars b ON o.symbol = b.symbol AND o.trade_date >= b.trading_date"


def ranges(s: SparkSession, d: str) -> DataFrame:
    """Count and sum of the last ten closes of each bar."""
    w = win.window_spec("symbol", "trading_date")
    b = fx.bars(s, d).withColumn("rn", F.row_number().over(w))
    spans = b.select("symbol", F.col("rn").alias("at"), (F.col("rn") - 9).alias("lo"), F.col("rn").alias("hi"))
    met = joins.range_join(b.select("symbol", "rn", "close"), spans, "symbol", "rn", "lo", "hi", 64)
    return rounded(met.groupBy("symbol", "at").agg(F.count("*").alias("n"), F.sum("close").alias("total")), 4)


RANGES = ctes("bars", b="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_date) AS rn FROM bars") + "SELECT s.symbol, CAST(s.rn AS INT) AS at, count(*) AS n, round(sum(b.close) + 3e-8, 4) + 0.0 AS total FROM b s JOIN b ON s.symbol = b.symbol AND b.rn BETWEEN s.rn - 9 AND s.rn GROUP BY s.symbol, s.rn"


def entry_prices(s: SparkSession, d: str) -> DataFrame:
    return rounded(joins.entry_current_prices(fx.bars(s, d), F.lit(D1), F.lit(D2)))


ENTRY = ctes("bars") + "SELECT coalesce(e.symbol, c.symbol) AS symbol, entry_date, round(entry_price + 3e-10, 6) + 0.0 AS entry_price, \"current_date\", round(current_price + 3e-10, 6) + 0.0 AS current_price FROM (SELECT symbol, min(trading_date) AS entry_date, arg_min(close, trading_date) AS entry_price FROM bars WHERE trading_date >= DATE '1997-06-30' GROUP BY symbol) e FULL JOIN (SELECT symbol, max(trading_date) AS \"current_date\", arg_max(close, trading_date) AS current_price FROM bars WHERE trading_date <= DATE '1998-06-30' GROUP BY symbol) c ON e.symbol = c.symbol"


def returns_between(s: SparkSession, d: str) -> DataFrame:
    return rounded(joins.period_return(fx.bars(s, d), F.lit(D1), F.lit(D2)))


PERIOD = ctes("bars") + f"SELECT symbol, {r('start_close end_close period_return')} FROM (SELECT *, end_close / nullif(start_close, 0) - 1 AS period_return FROM (SELECT symbol, arg_min(close, trading_date) AS start_close, arg_max(close, trading_date) AS end_close FROM bars WHERE trading_date BETWEEN DATE '1997-06-30' AND DATE '1998-06-30' GROUP BY symbol))"


def mismatches(s: SparkSession, d: str) -> DataFrame:
    actual = fx.bars(s, d).groupBy("symbol").agg(F.count("*").alias("actual_rows"), F.max("trading_date").cast("timestamp_ntz").alias("actual_end"))
    return joins.manifest_mismatches(ft.manifest(s, d), actual)


MISMATCH = ctes("bars", mani=ft.MANIFEST) + "SELECT m.symbol, row_count, actual_rows FROM mani m LEFT JOIN (SELECT symbol, count(*) AS actual_rows, max(trading_date) AS e FROM bars GROUP BY symbol) a USING (symbol) WHERE row_count <> coalesce(actual_rows, 0) OR coverage_end IS DISTINCT FROM e"


def latest_rows(s: SparkSession, d: str) -> DataFrame:
    return rounded(joins.latest_date_rows(fx.bars(s, d), "trading_date"))


def run_rows(s: SparkSession, d: str) -> DataFrame:
    log = fx.event_log(s, d)
    runs = log.groupBy("symbol").agg(F.min("status").alias("status"), F.max("event_ts").alias("as_of_date")).select(F.col("symbol").alias("run_id"), F.when(F.substring("symbol", 2, 2).cast("int") % 2 == 0, "ok").otherwise("failed").alias("status"), "as_of_date")
    return joins.latest_run_rows(runs, log.select(F.col("symbol").alias("run_id"), "event_id", "event_type"))


RUN_ROWS = ctes("elog") + "SELECT symbol AS run_id, event_id, event_type FROM elog WHERE symbol = (SELECT symbol FROM elog WHERE CAST(substr(symbol, 2) AS INT) % 2 = 0 GROUP BY symbol ORDER BY max(event_ts) DESC, symbol DESC LIMIT 1)"


def coverage(s: SparkSession, d: str) -> DataFrame:
    return agg.coverage_report(fx.bars(s, d), ft.manifest(s, d))


COVERAGE = ctes("bars", mani=ft.MANIFEST) + "SELECT symbol, n_rows, first_time, last_time, CAST(manifest_rows AS BIGINT) AS manifest_rows FROM (SELECT symbol, count(*) AS n_rows, min(trading_date) AS first_time, max(trading_date) AS last_time FROM bars GROUP BY symbol) FULL JOIN (SELECT symbol, sum(row_count) AS manifest_rows FROM mani GROUP BY symbol) USING (symbol)"


def first_last(s: SparkSession, d: str) -> DataFrame:
    return rounded(agg.first_last_by(fx.bars(s, d), "symbol", "trading_date", ["open", "close"]))


def conditional(s: SparkSession, d: str) -> DataFrame:
    b = fx.bars(s, d).withColumn("dow", F.date_format("trading_date", "EEE"))
    up = F.col("close") > F.col("open")
    return rounded(b.groupBy("symbol").agg(agg.cond_sum(F.col("volume"), up).alias("up_volume"), agg.cond_avg(F.col("close"), up).alias("up_close"), agg.distinct_list("dow").alias("days")))


CONDITIONAL = ctes("bars") + f"SELECT symbol, {r('up_volume up_close')}, days FROM (SELECT symbol, sum(volume) FILTER (WHERE close > open) AS up_volume, avg(close) FILTER (WHERE close > open) AS up_close, string_agg(DISTINCT strftime(trading_date, '%a'), ',' ORDER BY strftime(trading_date, '%a')) AS days FROM bars GROUP BY symbol)"


def duplicates(s: SparkSession, d: str) -> DataFrame:
    return agg.duplicate_count(fx.raw(s, d), ["symbol", "trading_date"])


def floor_(s: SparkSession, d: str) -> DataFrame:
    return agg.coverage_floor(fx.intraday(s, d), "symbol", "bar_time")


def rates(s: SparkSession, d: str) -> DataFrame:
    return rounded(agg.success_rate(fx.event_log(s, d), "symbol"))


def statuses(s: SparkSession, d: str) -> DataFrame:
    return agg.status_counts(fx.event_log(s, d), ["event_type", "status"])


def covariances(s: SparkSession, d: str) -> DataFrame:
    from ..operators.indicators_mart import symbol_daily_returns

    return rounded(agg.covariance_pairs(symbol_daily_returns(fx.bars(s, d))))


COV = ctes("bars", rt=ft.returns_sql("bars"), k="SELECT symbol, trading_date, log_return_1d AS x FROM rt WHERE log_return_1d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trading_date DESC) <= 252",
           p="SELECT a.symbol AS i, b.symbol AS j, CASE WHEN count(*) >= 20 THEN coalesce(covar_samp(a.x, b.x), 0) * 252 ELSE 0.0 END AS cov, count(*) AS n FROM k a JOIN k b USING (trading_date) WHERE a.symbol <= b.symbol GROUP BY ALL") + "SELECT i, j, round(CASE WHEN i = j AND cov <= 0 THEN coalesce((SELECT quantile_cont(cov, 0.5) FROM p WHERE i = j AND cov > 0), 0.04) ELSE cov END + 3e-10, 6) + 0.0 AS cov, n FROM p"


def _nav(s: SparkSession, d: str) -> DataFrame:
    daily = table(s, d, "orders").groupBy((F.col("o_custkey") % 5).alias("run_id"), F.to_date("o_orderdate").alias("trade_date")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    return daily.select("run_id", "trade_date", (1e6 + F.col("v") / 1000).alias("nav"), (F.col("v") / 1000).alias("market_value"))


_NAV = "SELECT o_custkey % 5 AS run_id, CAST(o_orderdate AS DATE) AS trade_date, 1e6 + sum(o_totalprice) / 1000 AS nav, sum(o_totalprice) / 1000 AS market_value FROM orders GROUP BY ALL"
_NAVS = "SELECT *, nav / nullif(lag(nav) OVER (PARTITION BY run_id ORDER BY trade_date), 0) - 1 AS daily_return, max(nav) OVER w AS peak, nav / nullif(max(nav) OVER w, 0) - 1 AS drawdown, market_value / nullif(nav, 0) AS exposure FROM nav WINDOW w AS (PARTITION BY run_id ORDER BY trade_date ROWS UNBOUNDED PRECEDING)"
NAV_METRICS = f"WITH nav AS ({_NAV}), ns AS ({_NAVS}) SELECT run_id, n, " + r("total_return annualised_return volatility sharpe max_drawdown win_rate mean_exposure", 5) + """ FROM (SELECT run_id, n, l / f - 1 AS total_return, power(l / f, 252.0 / n) - 1 AS annualised_return, s * sqrt(252) AS volatility, m * sqrt(252) / nullif(s, 0) AS sharpe, max_drawdown, win_rate, mean_exposure FROM (
  SELECT run_id, count(*) AS n, arg_min(nav, trade_date) AS f, arg_max(nav, trade_date) AS l, avg(daily_return) AS m, stddev_samp(daily_return) AS s, min(drawdown) AS max_drawdown, avg(CASE WHEN daily_return IS NOT NULL THEN CASE WHEN daily_return > 0 THEN 1.0 ELSE 0.0 END END) AS win_rate, avg(exposure) AS mean_exposure FROM ns GROUP BY run_id))"""


def quantile_band(s: SparkSession, d: str) -> DataFrame:
    def build(parts: Parts, keys: list[str]) -> DataFrame:
        fwd, up = win.forward_target("close", key=keys)
        bands = {"q05": win.rolling_quantile("close", 120, 0.05, keys), "q95": win.rolling_quantile("close", 120, 0.95, keys), "std_20": win.rolling_std("close", 20, keys, min_obs=10)}
        return parts.rows.withColumns(bands | {"target_5d": fwd, "target_up": up})

    made = framed(fx.bars(s, d), "symbol", "trading_date", 119, 5, build)
    return rounded(made.select("symbol", "trading_date", "q05", "q95", "target_5d", "target_up", "std_20", win.cross_section_rank("trading_date", "close").alias("rank")))


QUANTILE = ctes("bars") + "SELECT symbol, trading_date, " + r("q05 q95 target_5d std_20 rank") + ", target_up FROM (SELECT *, CASE WHEN n >= 30 THEN quantile_cont(close, 0.05) OVER w END AS q05, CASE WHEN n >= 30 THEN quantile_cont(close, 0.95) OVER w END AS q95, CAST(target_5d > 0 AS INT) AS target_up FROM (SELECT *, count(close) OVER w AS n, lead(close, 5) OVER (PARTITION BY symbol ORDER BY trading_date) / nullif(close, 0) - 1 AS target_5d, CASE WHEN count(close) OVER v >= 10 THEN stddev_samp(close) OVER v END AS std_20, percent_rank() OVER (PARTITION BY trading_date ORDER BY close NULLS FIRST) AS rank FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), v AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WINDOW w AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW))"


def differences(s: SparkSession, d: str) -> DataFrame:
    daily = fx.bars(s, d)
    return agg.key_difference(daily.where(F.col("trading_date") < F.lit(D0)).select("trading_date"), daily.where(F.col("symbol") == "Brand#1").select("trading_date"), "trading_date")


DIFFERENCES = ctes("bars") + "SELECT *, 'missing' AS side FROM (SELECT trading_date FROM bars WHERE trading_date < DATE '1996-06-28' EXCEPT SELECT trading_date FROM bars WHERE symbol = 'Brand#1') UNION ALL SELECT *, 'extra' FROM (SELECT trading_date FROM bars WHERE symbol = 'Brand#1' EXCEPT SELECT trading_date FROM bars WHERE trading_date < DATE '1996-06-28')"


def best_days(s: SparkSession, d: str) -> DataFrame:
    return rounded(agg.top_n_per_group(fx.bars(s, d), ["symbol"], [F.desc("volume"), F.col("trading_date")], 3).select("symbol", "trading_date", "volume", "nth"))


def severity_order(s: SparkSession, d: str) -> DataFrame:
    log = agg.status_counts(fx.event_log(s, d), ["event_type"]).withColumn("rank", agg.rank_of(F.col("event_type"), ["alert_state_change", "pipeline_run"]))
    return agg.order_by_rank(log, "event_type", ["alert_state_change", "pipeline_run"], F.desc("n")).limit(10)


def merged(prefer: str):
    return lambda s, d: rounded(merge.merge_on_read(fx.base(s, d), fx.delta(s, d), ["symbol", "bar_time"], prefer))


def _merged_sql(prefer: str) -> str:
    a, b = ("delta", "base") if prefer == "delta" else ("base", "delta")
    return ctes("base", "delta") + f"SELECT symbol, bar_time, session_date, {r('open high low close volume')} FROM (SELECT * FROM {a} UNION ALL BY NAME SELECT * FROM {b} b WHERE NOT EXISTS (SELECT 1 FROM {a} a WHERE a.symbol = b.symbol AND a.bar_time = b.bar_time))"


def sliced(s: SparkSession, d: str) -> DataFrame:
    return rounded(merge.replace_slices(fx.base(s, d), fx.delta(s, d), "symbol", "bar_time"))


SLICED = ctes("base", "delta") + f"SELECT symbol, bar_time, session_date, {r('open high low close volume')} FROM (SELECT b.* FROM base b LEFT JOIN (SELECT symbol, min(bar_time) AS lo, max(bar_time) AS hi FROM delta GROUP BY symbol) c USING (symbol) WHERE lo IS NULL OR bar_time < lo OR bar_time > hi UNION ALL BY NAME SELECT * FROM delta)"


def upserted(s: SparkSession, d: str) -> DataFrame:
    raw = fx.raw(s, d).where("symbol IS NOT NULL")
    return rounded(merge.upsert(raw.where("source = 'a'"), raw.where("source <> 'a'"), ["symbol", "trading_date"], [F.col("source"), F.desc("volume"), F.desc("open")]))


UPSERTED = ctes(
    "raw",
    batch="SELECT * FROM raw WHERE source <> 'a' AND symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, trading_date ORDER BY source, volume DESC, open DESC) = 1",
    kept="SELECT r.* FROM raw r ANTI JOIN batch b ON r.symbol = b.symbol AND r.trading_date = b.trading_date WHERE r.source = 'a' AND r.symbol IS NOT NULL",
) + f"SELECT symbol, trading_date, source, {r('open high low close volume')} FROM (SELECT * FROM kept UNION ALL SELECT * FROM batch)"


def inserted(s: SparkSession, d: str) -> DataFrame:
    raw = fx.raw(s, d).where("symbol IS NOT NULL")
    return merge.insert_ignore(raw.where("source = 'a'").select("symbol", "trading_date"), raw.where("source <> 'a'").select("symbol", "trading_date"), ["symbol", "trading_date"])


def compacted(s: SparkSession, d: str) -> DataFrame:
    return rounded(merge.eod_compact(fx.base(s, d), fx.delta(s, d), F.lit(date(2024, 1, 26)), 20)[0])


COMPACTED = ctes("base", "delta", dd="SELECT * FROM delta WHERE session_date <= DATE '2024-01-26'") + f"SELECT symbol, bar_time, session_date, {r('open high low close volume')} FROM (SELECT b.* FROM base b LEFT JOIN (SELECT symbol, min(bar_time) AS lo, max(bar_time) AS hi FROM dd GROUP BY symbol) c USING (symbol) WHERE lo IS NULL OR bar_time < lo OR bar_time > hi UNION ALL BY NAME SELECT * FROM dd) WHERE session_date >= DATE '2024-01-06'"


def versions(s: SparkSession, d: str) -> DataFrame:
    daily = fx.bars(s, d)
    state = daily.where("symbol < 'Brand#2'").groupBy(F.col("symbol").alias("dataset_name")).agg(F.count("*").alias("version"), F.min("trading_date").alias("latest_data_ts")).withColumn("run_id", F.lit("r1"))
    return merge.bump_version(state, daily.where("symbol >= 'Brand#15'").groupBy(F.col("symbol").alias("dataset_name")).agg(F.max("trading_date").alias("latest_data_ts")).withColumn("run_id", F.lit("r2")))


VERSIONS = ctes("bars") + "SELECT dataset_name, coalesce(version, 0) + CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END AS version, CASE WHEN n IS NOT NULL THEN t2 ELSE t1 END AS latest_data_ts, CASE WHEN n IS NOT NULL THEN 'r2' ELSE 'r1' END AS run_id FROM (SELECT symbol AS dataset_name, count(*) AS version, min(trading_date) AS t1 FROM bars WHERE symbol < 'Brand#2' GROUP BY symbol) FULL JOIN (SELECT symbol AS dataset_name, max(trading_date) AS t2, 1 AS n FROM bars WHERE symbol >= 'Brand#15' GROUP BY symbol) USING (dataset_name)"


def _judged(s: SparkSession, d: str) -> DataFrame:
    return fx.raw(s, d).join(F.broadcast(fx.as_of(fx.bars(s, d))), F.lit(True))


def validated(part: int):
    def query(s: SparkSession, d: str) -> DataFrame:
        clean, _, counts = quality.validate(_judged(s, d), quality.OHLCV_RULES, ["symbol", "trading_date"], [F.col("source")])
        return rounded(clean.drop("as_of")) if part == 0 else counts

    return query


_CHECKS = {"symbol_present": "symbol IS NOT NULL", "positive_prices": "least(open, high, low, close) > 0", "ohlc_bounds": "high >= greatest(open, low, close) AND low <= least(open, high, close)", "volume_not_negative": "volume >= 0", "not_in_future": "trading_date <= (SELECT as_of FROM upto)"}
RULE_COUNTS = ctes("raw", "upto") + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n FROM raw WHERE NOT coalesce({c}, false) HAVING count(*) > 0" for n, c in _CHECKS.items())
CLEAN = ctes("raw", "upto") + f"SELECT symbol, trading_date, source, {r('open high low close volume')} FROM (SELECT * FROM raw WHERE {' AND '.join(f'coalesce({c}, false)' for c in _CHECKS.values())} QUALIFY row_number() OVER (PARTITION BY symbol, trading_date ORDER BY source) = 1)"


def integrity(s: SparkSession, d: str) -> DataFrame:
    return quality.integrity_metrics(fx.raw(s, d), ["symbol", "trading_date"])


INTEGRITY = ctes("raw") + """SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(a) AS BIGINT) AS null_rows, CAST(sum(b) AS BIGINT) AS non_positive_rows, CAST(sum(c) AS BIGINT) AS negative_volume_rows, CAST(sum(e) AS BIGINT) AS bad_bounds_rows FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS a, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS b, count(*) FILTER (WHERE volume < 0) AS c, count(*) FILTER (WHERE high < greatest(open, low, close) OR low > least(open, high, close)) AS e FROM raw GROUP BY symbol, trading_date)"""


def manifests(s: SparkSession, d: str) -> DataFrame:
    daily = fx.bars(s, d)
    return quality.build_manifest(daily, "daily", fx.as_of(daily), pending=daily.where("symbol = 'Brand#7'"))


MANIFESTS = ctes("bars", "upto") + "SELECT 'daily' AS dataset_name, symbol, min(trading_date) AS coverage_start, max(trading_date) AS coverage_end, count(*) AS row_count, symbol = 'Brand#7' AS needs_merge, CASE WHEN symbol = 'Brand#7' THEN 'pending_merge' WHEN (SELECT as_of FROM upto) - max(trading_date) <= 0 THEN 'up_to_date' WHEN (SELECT as_of FROM upto) - max(trading_date) <= 3 THEN 'awaiting_refresh_window' ELSE 'stale' END AS update_status FROM bars GROUP BY symbol"


def audit(s: SparkSession, d: str) -> DataFrame:
    daily = fx.bars(s, d)
    return quality.consistency_audit(ft.manifest(s, d), daily.where("NOT (symbol = 'Brand#3' AND trading_date > DATE'1998-01-01') AND symbol <> 'Brand#4'"), daily)


AUDIT = ctes("bars", mani=ft.MANIFEST) + """SELECT symbol, unnest(list_filter([CASE WHEN m.row_count IS NULL THEN 'missing_manifest' END, CASE WHEN fr IS NULL THEN 'missing_file' END, CASE WHEN tr IS NULL THEN 'missing_table' END, CASE WHEN m.row_count <> tr THEN 'manifest_row_count' END, CASE WHEN fr <> tr THEN 'file_row_count' END,
  CASE WHEN CAST(m.coverage_end AS DATE) <> te THEN 'manifest_coverage' END, CASE WHEN fe <> te THEN 'file_coverage' END], lambda i: i IS NOT NULL)) AS issue FROM mani m FULL JOIN (SELECT symbol, count(*) AS fr, max(trading_date) AS fe FROM bars WHERE NOT (symbol = 'Brand#3' AND trading_date > DATE '1998-01-01') AND symbol <> 'Brand#4' GROUP BY symbol) f USING (symbol) FULL JOIN (SELECT symbol, count(*) AS tr, max(trading_date) AS te FROM bars GROUP BY symbol) t USING (symbol)"""


def health(s: SparkSession, d: str) -> DataFrame:
    daily = fx.bars(s, d)
    expected = fx.as_of(daily).select(F.col("as_of").alias("expected"))
    return quality.health_summary({"daily": (daily, "trading_date"), "index": (fx.index_bars(s, d), "trading_date")}, expected)


_E, _F = _WD.format("(SELECT as_of FROM upto)"), _WD.format("floor")
HEALTH = ctes("bars", "idx", "upto") + f"SELECT dataset_name, floor, n_keys, missing_days, CASE WHEN missing_days = 0 THEN 'healthy' WHEN missing_days <= 1 THEN 'warning' ELSE 'stale' END AS status FROM (SELECT dataset_name, floor, n_keys, CAST(greatest(0, {_E} - {_F}) AS INT) AS missing_days FROM (SELECT 'daily' AS dataset_name, min(l) AS floor, count(*) AS n_keys FROM (SELECT max(trading_date) AS l FROM bars GROUP BY symbol) UNION ALL SELECT 'index', min(l), count(*) FROM (SELECT max(trading_date) AS l FROM idx GROUP BY symbol)))"


def outliers(s: SparkSession, d: str) -> DataFrame:
    return rounded(quality.outlier_and_missing(fx.raw(s, d), ["open", "close", "volume"], 3.0))


OUTLIERS = ctes("raw") + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, round(count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE + 3e-10, 6) + 0.0 AS missing_ratio, count(*) FILTER (WHERE abs(({c} - (SELECT avg({c}) FROM raw)) / (SELECT stddev_samp({c}) FROM raw)) > 3.0) AS n_outliers FROM raw" for c in ("open", "close", "volume"))


def generic_tests(s: SparkSession, d: str) -> DataFrame:
    """Failing rows of each generic test over the raw rows."""
    raw = fx.raw(s, d)
    tests = {"not_null": quality.not_null(raw, "symbol"), "non_negative": quality.non_negative(raw, "volume"), "ohlc_bounds": quality.ohlc_bounds(raw), "accepted_values": quality.accepted_values(raw, "source", ["a", "b"]), "not_in_values": quality.not_in_values(raw, "symbol", ["Brand#9"]), "unique": quality.unique(raw, ["symbol", "trading_date"])}
    return agg.stack({n: f.agg(F.count("*").alias("n_failing")) for n, f in tests.items()}, "test")


GENERIC = ctes("raw") + "SELECT 'not_null' AS test, count(*) AS n_failing FROM raw WHERE symbol IS NULL UNION ALL SELECT 'non_negative', count(*) FROM raw WHERE volume < 0 UNION ALL SELECT 'ohlc_bounds', count(*) FROM raw WHERE high < greatest(open, low, close) OR low > least(open, high, close) UNION ALL SELECT 'accepted_values', count(*) FROM raw WHERE source NOT IN ('a', 'b') UNION ALL SELECT 'not_in_values', count(*) FROM raw WHERE symbol = 'Brand#9' UNION ALL SELECT 'unique', count(*) FROM (SELECT 1 FROM raw GROUP BY symbol, trading_date HAVING count(*) > 1)"


def standardized(s: SparkSession, d: str) -> DataFrame:
    raw = fx.raw(s, d).where("symbol IS NOT NULL").withColumn("seq", F.col("source")).withColumns({c: F.col(c).cast("string") for c in ("open", "close")})
    return rounded(src.standardize_daily(raw, "std", F.lit(D0), F.lit(D2)))


STANDARD = ctes("raw") + f"SELECT symbol, trading_date, {r('open high low close volume')}, 'std' AS source FROM (SELECT symbol, trading_date, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, volume FROM raw WHERE symbol IS NOT NULL AND trading_date BETWEEN DATE '1996-06-28' AND DATE '1998-06-30' AND least(open, high, low, close) > 0 AND volume >= 0 QUALIFY row_number() OVER (PARTITION BY symbol, trading_date ORDER BY source DESC) = 1)"


def catalog(s: SparkSession, d: str) -> DataFrame:
    return src.catalog({n: table(s, d, n) for n in ("orders", "events", "part", "documents")})


CATALOG = " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE SELECT * FROM {n})) AS INT) AS n_columns" for n in ("orders", "events", "part", "documents"))


def ticks(s: SparkSession, d: str) -> DataFrame:
    return rounded(fx.intraday(s, d))


def checkpoints(s: SparkSession, d: str) -> DataFrame:
    return rounded(ev.checkpoint_projection(fx.event_log(s, d)).drop("payload_json"))


CHECKPOINTS = ctes("elog") + "SELECT symbol, event_id, event_ts, event_type, status, round(value + 3e-10, 6) + 0.0 AS value FROM elog WHERE event_type = 'checkpoint_updated' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_ts DESC, event_id DESC) = 1"


def projected(s: SparkSession, d: str) -> DataFrame:
    """Latest event of each key and projection, stacked."""
    tables = ev.project_events(fx.event_log(s, d).withColumns({"run_id": F.col("symbol"), "component": F.col("symbol")}))
    return agg.stack({k: t.select("symbol", "event_id", "event_ts", "status") for k, t in tables.items()}, "projection")


PROJECTED = ctes("elog") + "SELECT event_type AS projection, symbol, event_id, event_ts, status FROM elog QUALIFY row_number() OVER (PARTITION BY event_type, symbol ORDER BY event_ts DESC, event_id DESC) = 1"


def _alerts(s: SparkSession, d: str) -> DataFrame:
    e = fx.event_log(s, d)
    status = F.element_at(F.array(F.lit("open"), F.lit("acknowledged"), F.lit("resolved"), F.lit("open")), (F.col("event_id") % 4 + 1).cast("int"))
    return e.where("event_type = 'alert_state_change'").select(F.col("symbol").alias("alert_key"), "event_id", "event_ts", status.alias("status"))


_ALERTS = "SELECT symbol AS alert_key, event_id, event_ts, CASE event_id % 4 WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'resolved' ELSE 'open' END AS status FROM elog WHERE event_type = 'alert_state_change'"
ALERT_STATE = ctes("elog", al=_ALERTS, g="SELECT alert_key, min(event_ts) AS first_event_ts, max(event_ts) AS last_event_ts, arg_max(status, (event_ts, event_id)) AS status, max((event_ts, event_id)) FILTER (WHERE status = 'open') AS o, max((event_ts, event_id)) FILTER (WHERE status = 'acknowledged') AS a, max((event_ts, event_id)) FILTER (WHERE status = 'resolved') AS r, max(event_ts) FILTER (WHERE status = 'acknowledged') AS ta, max(event_ts) FILTER (WHERE status = 'resolved') AS tr FROM al GROUP BY alert_key") + "SELECT alert_key, status, first_event_ts, last_event_ts, CASE WHEN a IS NOT NULL AND (o IS NULL OR a > o) THEN ta END AS acknowledged_at, CASE WHEN r IS NOT NULL AND (o IS NULL OR r > o) AND (a IS NULL OR r > a) THEN tr END AS resolved_at FROM g"


def transitions(s: SparkSession, d: str) -> DataFrame:
    log = fx.event_log(s, d)
    firing = agg.stack({"f": ev.rule_consecutive_failures(log.where("event_type IN ('pipeline_run', 'source_request')")), "e": ev.rule_empty_payloads(log.where("event_type = 'source_request'").withColumn("value", F.col("value") - 20))})
    status = _alerts(s, d)
    was = agg.stack({k: ev.alert_state(status).select(F.concat(F.lit(k + "|"), "alert_key").alias("alert_key"), "status") for k in ("failures", "empty")})
    return ev.evaluate_rules(firing, was)


TRANSITIONS = ctes("elog", al=_ALERTS, st="SELECT alert_key, arg_max(status, (event_ts, event_id)) AS was FROM al GROUP BY alert_key",
    fi="SELECT 'failures|' || symbol AS alert_key, symbol, count(*) = 2 AND bool_and(status = 'failed') AS firing FROM (SELECT * FROM elog WHERE event_type IN ('pipeline_run', 'source_request') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_ts DESC, event_id DESC) <= 2) GROUP BY symbol UNION ALL SELECT 'empty|' || symbol, symbol, count(*) = 2 AND bool_and(coalesce(value - 20, 0) <= 0) FROM (SELECT * FROM elog WHERE event_type = 'source_request' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY event_ts DESC, event_id DESC) <= 2) GROUP BY symbol") + "SELECT * FROM (SELECT f.alert_key, CASE WHEN firing AND coalesce(was, 'none') <> 'open' THEN 'open' WHEN NOT firing AND was IN ('open', 'acknowledged') THEN 'resolved' END AS status FROM fi f LEFT JOIN st ON f.symbol = st.alert_key) WHERE status IS NOT NULL"


def gaps(s: SparkSession, d: str) -> DataFrame:
    bars = fx.intraday(s, d)
    return ev.missing_slots(bars, bars).groupBy("symbol").agg(F.count("*").alias("n_missing"), F.min("bar_time").alias("first_missing"))


GAPS = ctes("intra") + "SELECT symbol, count(*) AS n_missing, min(bar_time) AS first_missing FROM (SELECT * FROM (SELECT DISTINCT symbol FROM intra), (SELECT DISTINCT bar_time FROM intra) EXCEPT SELECT symbol, bar_time FROM intra) GROUP BY symbol"


def trailing(s: SparkSession, d: str) -> DataFrame:
    return rounded(x.trailing_period(fx.bars(s, d), "trading_date", "6M"))


def series(s: SparkSession, d: str) -> DataFrame:
    return rounded(x.chart_series(fx.bars(s, d), "trading_date", ["close", "volume"], keep=("symbol",)))


SERIES = ctes("bars") + "SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS time, series, round(value + 3e-10, 6) + 0.0 AS value, CASE WHEN value >= 0 THEN 'up' ELSE 'down' END AS color FROM (SELECT symbol, trading_date, 'close' AS series, close AS value FROM bars UNION ALL SELECT symbol, trading_date, 'volume', volume FROM bars)"

QUERIES = {
    "staging_projection": staging, "trading_calendar": calendar_gaps, "session_state": sessions, "asof_join": asof_quotes, "range_join_all": ranges, "range_join": ranges, "entry_current_prices": entry_prices, "period_return": returns_between, "manifest_mismatches": mismatches, "latest_date_rows": latest_rows, "latest_run_rows": run_rows,
    "coverage_report": coverage, "first_last_by": first_last, "conditional_aggregates": conditional, "duplicate_count": duplicates, "coverage_floor": floor_, "success_rate": rates, "status_counts": statuses, "covariance_pairs": covariances,
    "nav_series": lambda s, d: rounded(agg.nav_series(_nav(s, d)), 5), "nav_metrics": lambda s, d: rounded(agg.nav_metrics(agg.nav_series(_nav(s, d))), 5), "rolling_quantile": quantile_band, "key_difference": differences, "top_n_per_group": best_days, "order_by_rank": severity_order,
    "merge_delta_wins": merged("delta"), "merge_base_wins": merged("base"), "replace_slices": sliced, "upsert": upserted, "insert_ignore": inserted, "eod_compact": compacted, "bump_version": versions, "validate_clean": validated(0), "validate_counts": validated(1), "integrity_metrics": integrity, "generic_tests": generic_tests,
    "build_manifest": manifests, "consistency_audit": audit, "health_summary": health, "outlier_and_missing": outliers, "standardize_daily": standardized, "catalog": catalog, "build_bars": ticks, "checkpoint_projection": checkpoints, "project_events": projected, "alert_state": lambda s, d: ev.alert_state(_alerts(s, d)),
    "evaluate_rules": transitions, "missing_slots": gaps, "trailing_period": trailing, "chart_series": series,
}
OHLCV = r("open high low close volume")
ORACLES = {
    "staging_projection": STAGING, "trading_calendar": CALENDAR, "session_state": SESSIONS, "asof_join": ASOF, "range_join": RANGES, "range_join_all": RANGES, "entry_current_prices": ENTRY, "period_return": PERIOD, "manifest_mismatches": MISMATCH,
    "latest_date_rows": ctes("bars", "upto") + f"SELECT symbol, trading_date, {OHLCV} FROM bars WHERE trading_date = (SELECT as_of FROM upto)", "latest_run_rows": RUN_ROWS, "coverage_report": COVERAGE,
    "first_last_by": ctes("bars") + f"SELECT symbol, {r('first_open last_open first_close last_close')} FROM (SELECT symbol, arg_min(open, trading_date) AS first_open, arg_max(open, trading_date) AS last_open, arg_min(close, trading_date) AS first_close, arg_max(close, trading_date) AS last_close FROM bars GROUP BY symbol)",
    "conditional_aggregates": CONDITIONAL, "duplicate_count": ctes("raw") + "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM raw GROUP BY symbol, trading_date)",
    "coverage_floor": ctes("intra") + "SELECT min(l) AS floor, max(l) AS ceiling, count(*) AS n_keys FROM (SELECT max(bar_time) AS l FROM intra GROUP BY symbol)",
    "success_rate": ctes("elog") + "SELECT symbol, count(*) AS n_runs, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END) * 100 + 3e-10, 6) + 0.0 AS success_rate FROM elog GROUP BY symbol",
    "status_counts": ctes("elog") + "SELECT event_type, status, count(*) AS n FROM elog GROUP BY ALL", "covariance_pairs": COV,
    "nav_series": f"WITH nav AS ({_NAV}) SELECT run_id, trade_date, {r('nav market_value daily_return peak drawdown exposure', 5)} FROM ({_NAVS})", "nav_metrics": NAV_METRICS, "rolling_quantile": QUANTILE, "key_difference": DIFFERENCES,
    "top_n_per_group": ctes("bars") + "SELECT symbol, trading_date, round(volume + 3e-10, 6) + 0.0 AS volume, CAST(nth AS INT) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, trading_date) AS nth FROM bars) WHERE nth <= 3",
    "order_by_rank": ctes("elog") + "SELECT event_type, count(*) AS n, CAST(CASE event_type WHEN 'alert_state_change' THEN 1 WHEN 'pipeline_run' THEN 2 ELSE 3 END AS INT) AS rank FROM elog GROUP BY event_type ORDER BY rank, n DESC LIMIT 10",
    "merge_delta_wins": _merged_sql("delta"), "merge_base_wins": _merged_sql("base"), "replace_slices": SLICED, "upsert": UPSERTED,
    "insert_ignore": ctes("raw") + "SELECT symbol, trading_date FROM raw WHERE source = 'a' AND symbol IS NOT NULL UNION ALL (SELECT symbol, trading_date FROM raw WHERE source <> 'a' AND symbol IS NOT NULL EXCEPT SELECT symbol, trading_date FROM raw WHERE source = 'a')",
    "eod_compact": COMPACTED, "bump_version": VERSIONS, "validate_clean": CLEAN, "validate_counts": RULE_COUNTS, "integrity_metrics": INTEGRITY, "generic_tests": GENERIC, "build_manifest": MANIFESTS, "consistency_audit": AUDIT, "health_summary": HEALTH, "outlier_and_missing": OUTLIERS,
    "standardize_daily": STANDARD, "catalog": CATALOG, "build_bars": ctes("intra") + f"SELECT symbol, bar_time, session_date, {OHLCV} FROM intra", "checkpoint_projection": CHECKPOINTS, "project_events": PROJECTED, "alert_state": ALERT_STATE, "evaluate_rules": TRANSITIONS, "missing_slots": GAPS,
    "trailing_period": ctes("bars", "upto") + f"SELECT symbol, trading_date, {OHLCV} FROM bars WHERE trading_date >= (SELECT as_of FROM upto) - INTERVAL 6 MONTH", "chart_series": SERIES,
}
