"""Column expressions: staging, ratios, labels, JSON, hashing, calendars and sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Months and days of the trailing periods.
PERIOD_MONTHS = {"3M": 3, "6M": 6, "1Y": 12, "3Y": 36, "5Y": 60, "10Y": 120}
PERIOD_DAYS = {"5D": 5, "20D": 20, "60D": 60}


def stage(df: DataFrame, casts: dict[str, str], upper: tuple[str, ...] = ("symbol",), lower: tuple[str, ...] = ("interval",)) -> DataFrame:
    """Type-stable projection: the columns of casts, symbols in upper and intervals in lower case."""
    out = []
    for name, kind in casts.items():
        col = F.col(name).cast(kind)
        col = F.upper(col) if name in upper else F.lower(col) if name in lower else col
        out.append(col.alias(name))
    return df.select(*out)


def surrogate_key(*cols: str | Column, sep: str = "|") -> Column:
    """Parts joined by sep; null if any part is null."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.lit(sep)] if parts else []
        parts.append((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def in_set(col: Column, values: list, negate: bool = False) -> Column:
    return ~col.isin(values) if negate else col.isin(values)


def is_active(end_date: Column, as_of: Column | date) -> Column:
    return end_date.isNull() | (end_date >= (as_of if isinstance(as_of, Column) else F.lit(as_of)))


def bar_filter(symbols: list[str] | None = None, start: date | None = None, end: date | None = None, key: str = "symbol", time: str = "trading_date") -> Column:
    """Optional symbols, inclusive start and end."""
    kept = F.lit(True)
    if symbols:
        kept = kept & F.col(key).isin([s.upper() for s in symbols])
    if start is not None:
        kept = kept & (F.col(time) >= F.lit(start))
    if end is not None:
        kept = kept & (F.col(time) <= F.lit(end))
    return kept


def trailing_period(df: DataFrame, time_col: str, period_key: str) -> DataFrame:
    """Rows from the last time minus the period on; calendar months, or days, or ALL."""
    if period_key == "ALL":
        return df
    last = df.agg(F.max(time_col).alias("__last"))
    begin = F.add_months("__last", -PERIOD_MONTHS[period_key]) if period_key in PERIOD_MONTHS else F.date_sub("__last", PERIOD_DAYS[period_key])
    # one row
    return df.join(F.broadcast(last.select(begin.alias("__begin"))), F.col(time_col) >= F.col("__begin")).drop("__begin")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def safe_return(a: Column, b: Column) -> Column:
    return ratio(a, b) - 1


def clamp(col: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), col))


def label(rules: list[tuple[Column, object]], default: object) -> Column:
    out = F.when(*rules[0])
    for cond, value in rules[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def floor_lot(qty: Column, lot: int = 100) -> Column:
    return (F.floor(qty / lot) * lot).cast("bigint")


def day_diff(a: Column, b: Column) -> Column:
    return F.datediff(F.to_date(a), F.to_date(b))


def minute_of(ts: Column) -> Column:
    return F.minute(ts)


def neutral(col: Column, default: float = 0.5) -> Column:
    return F.coalesce(col, F.lit(default))


def to_unit_price(col: Column, mult: float = 1000.0, threshold: float = 1000.0) -> Column:
    return F.when((col > 0) & (col < threshold), col * mult).otherwise(col)


def json_field(col: Column, path: str, kind: str = "string") -> Column:
    """A field of a JSON text by path; null where the text isn't an object."""
    return F.get_json_object(F.when(F.try_parse_json(col).isNotNull() & F.ltrim(col).startswith("{"), col).otherwise("{}"), f"$.{path}").try_cast(kind)


def to_json_sorted(cols: dict[str, Column], digits: int = 4) -> Column:
    """A JSON object with sorted keys; numbers rounded, those that aren't finite null."""
    fields = []
    for name in sorted(cols):
        fields.append(cols[name].alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def finite(col: Column, digits: int = 4) -> Column:
    value = col.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.round(value, digits))


def extract_dates(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))


def parse_number(col: Column) -> Column:
    """The first number of a text, thousands commas dropped."""
    return F.regexp_extract(F.regexp_replace(col, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def sha1_id(*cols: Column) -> Column:
    return F.sha1(F.concat_ws("|", *[c.cast("string") for c in cols]))


def content_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def trading_calendar(spark: SparkSession, lo: date, hi: date, weekend: tuple[int, ...] = (1, 7)) -> DataFrame:
    """(day, nth): days that aren't weekend (1 is Sunday), numbered. One row a day."""
    days = spark.sql("SELECT explode(sequence(DATE'%s', DATE'%s')) AS day" % (lo, hi)).where(~F.dayofweek("day").isin(list(weekend)))
    return days.select("day", F.row_number().over(Window.orderBy("day")).alias("nth"))


def weekday_number(col: Column) -> Column:
    """Days Monday to Friday since 1970-01-05 (a Monday) up to and including col; weekends count as their Friday."""
    since = F.datediff(col, F.lit(date(1970, 1, 5)))
    week = F.floor(since / 7)
    return (week * 5 + F.least(since - week * 7, F.lit(4))).cast("int")


def trading_day_gap(a: Column, b: Column) -> Column:
    """Trading days in (a, b]."""
    return weekday_number(b) - weekday_number(a)


def add_trading_days(col: Column, n: Column | int) -> Column:
    """The n-th trading day after col (n >= 1; a weekend counts as its Friday)."""
    to = weekday_number(col) + (n if isinstance(n, Column) else F.lit(n))
    week = F.floor(to / 5)
    return F.date_add(F.lit(date(1970, 1, 5)), (week * 7 + (to - week * 5)).cast("int"))


def previous_trading_day(col: Column) -> Column:
    """The last trading day before col."""
    weekday = F.weekday(col)
    return F.date_sub(col, F.when(weekday == 0, 3).when(weekday == 6, 2).otherwise(1))


def session_state(ts: Column, morning: tuple[str, str] = ("09:15", "11:30"), afternoon: tuple[str, str] = ("13:00", "15:00")) -> Column:
    clock = F.date_format(ts, "HH:mm")
    return label(
        [(F.weekday(ts) >= 5, "closed"), (clock < morning[0], "pre"), (clock <= morning[1], "morning"), (clock < afternoon[0], "lunch"), (clock <= afternoon[1], "afternoon")], "post"
    )


def latest_slot(ts: Column, slots: list[str]) -> Column:
    """The latest of the day's HH:mm slots that isn't after ts; null before the first."""
    due = F.filter(F.array(*map(F.lit, sorted(slots))), lambda s: s <= F.date_format(ts, "HH:mm"))
    return F.array_max(due)


def due_slots(ts: Column, slots: list[str], n: int) -> Column:
    """The last n slots of the day that aren't after ts."""
    due = F.filter(F.array(*map(F.lit, sorted(slots))), lambda s: s <= F.date_format(ts, "HH:mm"))
    return F.slice(due, F.greatest(F.size(due) - n + 1, F.lit(1)), n)


def trend_label(px: Column, fast: Column, slow: Column) -> Column:
    return label([((px > fast) & (fast > slow), "uptrend"), ((px < fast) & (fast < slow), "downtrend")], "sideways")


def rsi_label(c: Column) -> Column:
    return label([(c.isNull(), "n/a"), (c >= 70, "overbought"), (c <= 30, "oversold"), (c >= 55, "bullish"), (c <= 45, "bearish")], "neutral")


def macd_label(m: Column, s: Column) -> Column:
    return label([(m.isNull() | s.isNull(), "n/a"), (m > s, "bullish cross"), (m < s, "bearish cross")], "flat")


def chart_series(df: DataFrame, time_col: str, value_cols: list[str], tz: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long form (series, time, value, color): epoch seconds of wall times in tz, or ISO dates; finite values only."""
    when = F.unix_timestamp(F.to_utc_timestamp(time_col, tz)).cast("string") if tz else F.date_format(time_col, "yyyy-MM-dd")
    long = df.select(*keep, when.alias("time"), *[F.col(c).cast("double").alias(c) for c in value_cols]).unpivot([*keep, "time"], value_cols, "series", "value")
    kept = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return kept.withColumn("color", F.when(F.col("value") >= 0, "up").otherwise("down"))
