"""Sources, sinks and normalisers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import floor_lot, to_unit_price
from ..operators.windows import dedupe_by_priority
from .lines import line_stream, not_blank, numbered, split_lines

PRICES = ("open", "high", "low", "close")
REQUIRED = ("event_id", "event_ts", "event_type")
EVENT_SCHEMA = "event_id string, event_ts string, level string, component string, event_type string, run_id string, dataset_name string, symbol string, status string, message string, payload_json string"


def read_bars(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet file, folder or glob."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_table(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def save(df: DataFrame, name: str, mode: str = "append") -> None:
    """Into a table by column name, made if absent. mode: append or replace."""
    spark = df.sparkSession
    if mode == "replace" or not spark.catalog.tableExists(name):
        df.write.mode("overwrite").saveAsTable(name)
        return
    df.select(spark.table(name).columns).write.mode("append").saveAsTable(name)


def materialize_by_key(df: DataFrame, key: str, path: str) -> None:
    """A folder for each key; only the keys of df are replaced. Rows of one key are spread by a salt, so that a large
    key is several files."""
    salted = df.repartition(F.col(key), F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(4)))
    salted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_raw(df: DataFrame, path: str, key: str = "symbol") -> None:
    df.write.mode("append").partitionBy(key).parquet(path)


def parse_events(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, dead): events of JSON lines with all required fields; other lines, whole, with the error and what else
    lines has (file and line). Blank lines are neither. The same for tables and streams."""
    origin = [c for c in lines.columns if c != value]
    parsed = lines.where(not_blank(value)).withColumn("e", F.from_json(F.col(value), EVENT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"e.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    wrong = F.when(F.col("e").isNull() | F.col("e._bad").isNotNull() | ~F.ltrim(F.col(value)).startswith("{"), "not a JSON object").when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    judged = parsed.withColumn("error", wrong)
    good = judged.where(F.col("error").isNull()).select("e.*").drop("_bad").withColumn("event_ts", F.to_timestamp("event_ts"))
    dead = judged.where(F.col("error").isNotNull()).select(F.col(value).alias("raw_line"), "error", *origin)
    return good, dead


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead) of JSON lines in files; dead letters with source_file and line. Good events aren't numbered."""
    lines, starts = split_lines(spark, path)
    good, dead = parse_events(lines)
    return good, numbered(dead, starts)


def stream_events(spark: SparkSession, path: str, marks: str) -> tuple[DataFrame, DataFrame]:
    """read_events() as streams over growing files, which go on after the last finished line. A started query of each
    needs its own folder of marks."""
    return parse_events(line_stream(spark, path, f"{marks}/good"))[0], parse_events(line_stream(spark, path, f"{marks}/dead"))[1]


#: Column names that holdings files use.
ALIASES = {"symbol": ("symbol", "ticker", "code"), "quantity": ("quantity", "qty", "volume", "shares"), "avg_cost": ("avg_cost", "cost", "price", "avg_price")}


def read_holdings(df: DataFrame, lot: int = 100) -> DataFrame:
    """Holdings of a text table: alias columns, units in thousands, whole lots; rows without symbol, lots or cost go."""
    names = {c.strip().lower(): c for c in df.columns}
    pick = {k: F.coalesce(*[F.col(f"`{names[a]}`") for a in al if a in names], F.lit(None)) for k, al in ALIASES.items()}
    numbers = lambda c: F.regexp_replace(c.cast("string"), ",", "").try_cast("double")
    out = df.select(F.upper(F.trim(pick["symbol"])).alias("symbol"), floor_lot(numbers(pick["quantity"]), lot).alias("quantity"), to_unit_price(numbers(pick["avg_cost"])).alias("avg_cost"))
    return out.where((F.col("symbol") != "") & (F.col("quantity") > 0) & (F.col("avg_cost") > 0))


def universe_from_list(spark: SparkSession, name: str, symbols: list[str], effective: str) -> DataFrame:
    rows = [(name, s.upper(), effective) for s in dict.fromkeys(symbols)]
    return spark.createDataFrame(rows, "universe_name string, symbol string, effective_date string").select("universe_name", "symbol", F.to_date("effective_date").alias("effective_date"), F.lit(None).cast("date").alias("end_date"))


def _repaired(df: DataFrame) -> DataFrame:
    """Numbers from text, impossible rows dropped, high and low widened to the prices."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in (*PRICES, "volume")}).where((F.least(*PRICES) > 0) & (F.col("volume") >= 0) & F.col("open").isNotNull() & F.col("close").isNotNull())
    return out.withColumns({"high": F.greatest(*PRICES), "low": F.least(*PRICES)})


def standardize_daily(df: DataFrame, source: str, lo: Column, hi: Column, order: str = "trading_date") -> DataFrame:
    """Rows of [lo, hi], repaired, the last of each symbol and date by its place in the file order column `seq`."""
    kept = _repaired(df.withColumn(order, F.to_date(order)).where((F.col(order) >= lo) & (F.col(order) <= hi)))
    return dedupe_by_priority(kept, ["symbol", order], ["seq"]).drop("seq").withColumn("source", F.lit(source))


def end_bound(bound: Column) -> Column:
    """A date-only end bound means the last microsecond of its day."""
    ts = bound.cast("timestamp_ntz")
    return F.when(ts == F.date_trunc("day", ts), ts + F.expr("INTERVAL '1' DAY - INTERVAL '0.000001' SECOND")).otherwise(ts)


def standardize_intraday(df: DataFrame, source: str, zone: str, lo: Column, hi: Column, time: str = "bar_time") -> DataFrame:
    """Zoned times become wall times of `zone`."""
    wall = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(time).cast("timestamp").cast("timestamp_ntz"))
    kept = _repaired(df.withColumn(time, wall).where((F.col(time) >= lo) & (F.col(time) <= end_bound(hi))))
    return dedupe_by_priority(kept, ["symbol", time], ["seq"]).drop("seq").withColumns({"session_date": F.to_date(time), "source": F.lit(source)})


def legacy_number(col: Column) -> Column:
    return F.coalesce(F.regexp_replace(col.cast("string"), ",", "").try_cast("double"), F.lit(0.0))


def standardize_legacy(df: DataFrame, source: str) -> DataFrame:
    """Dates as dd/MM/yyyy, thousands commas, volume matched plus negotiated."""
    out = df.withColumns({"trading_date": F.to_date("date", "dd/MM/yyyy"), "volume": legacy_number(F.col("matched_volume")) + legacy_number(F.col("negotiated_volume")), **{c: F.regexp_replace(F.col(c).cast("string"), ",", "") for c in PRICES}})
    return _repaired(out.select("symbol", "trading_date", *PRICES, "volume")).withColumn("source", F.lit(source))


def standardize_hourly(chunks: list[DataFrame], source: str) -> DataFrame:
    out = chunks[0]
    for chunk in chunks[1:]:
        out = out.unionByName(chunk, allowMissingColumns=True)
    return dedupe_by_priority(_repaired(out.withColumn("source", F.lit(source))), ["symbol", "bar_time", "source"], ["seq"]).drop("seq")


def export_manifest(manifest: DataFrame, path: str) -> None:
    manifest.orderBy("dataset_name", "symbol").write.mode("overwrite").parquet(path)


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], limit: int = 1000) -> DataFrame:
    """One SELECT over registered tables, at most limit rows."""
    if not re.match(r"\s*(select|with)\b", query, re.IGNORECASE) or ";" in query.rstrip().rstrip(";"):
        raise ValueError("one SELECT is allowed")
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(query.rstrip().rstrip(";")).limit(limit)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns), counted in one plan."""
    out = None
    for name, frame in tables.items():
        part = frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(frame.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out
