"""Data quality: row rules, generic tests, integrity metrics, manifests, freshness and health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import label, ratio, trading_day_gap


@dataclass(frozen=True)
class Rule:
    """check is SQL text that holds for good rows; null counts as bad."""

    name: str
    check: str
    severity: str = "error"


def load_rules(config: list[dict[str, str]]) -> list[Rule]:
    return [Rule(c["name"], c["check"], c.get("severity", "error")) for c in config]


OHLCV_RULES = [
    Rule("symbol_present", "symbol IS NOT NULL"), Rule("positive_prices", "least(open, high, low, close) > 0"), Rule("ohlc_bounds", "high >= greatest(open, low, close) AND low <= least(open, high, close)"),
    Rule("volume_not_negative", "volume >= 0"), Rule("not_in_future", "trading_date <= as_of"),
]


def failures(rules: list[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r.check), F.lit(False)), F.lit(r.name)) for r in rules]))


def validate(df: DataFrame, rules: list[Rule], target_keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, invalid, counts): rows that pass all rules of severity error, the first of each key in order; rows that
    fail one, with those rules' names; failing rows by rule of any severity, counted independently."""
    checked = df.withColumn("failed", failures([r for r in rules if r.severity == "error"]))
    w = Window.partitionBy(*target_keys).orderBy(*order)
    clean = checked.where(F.size("failed") == 0).drop("failed").withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    invalid = checked.where(F.size("failed") > 0)
    counts = df.select(F.explode(failures(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return clean, invalid, counts


def severity_report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, severity, n) of every rule, those without failing rows too, in one aggregation."""
    made = df.agg(*[F.count_if(~F.coalesce(F.expr(r.check), F.lit(False))).alias(r.name) for r in rules])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(r.name).alias("n")) for r in rules])
    return made.select(F.explode(rows).alias("r")).select("r.*")


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def accepted_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(values))


def not_in_values(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.where(F.col(col).isin(values))


def non_negative(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) < 0)


def ohlc_bounds(df: DataFrame) -> DataFrame:
    return df.where((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close")))


def integrity_metrics(df: DataFrame, keys: list[str], time_col: str = "trading_date", intraday: bool = False) -> DataFrame:
    """One row of counts. Keys are grouped first, so duplicates need no global distinct."""
    prices = ("open", "high", "low", "close")
    null = sum((F.col(c).isNull().cast("int") for c in (*prices, "volume")), F.lit(0)) > 0
    checks = {
        "null_rows": null, "non_positive_rows": F.least(*prices) <= 0, "negative_volume_rows": F.col("volume") < 0,
        "bad_bounds_rows": (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close")),
    }
    if intraday:
        checks |= {"off_grid_rows": F.minute(time_col) % 15 != 0, "session_mismatch_rows": F.to_date(time_col) != F.col("session_date")}
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in checks.items()])
    return per_key.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"), *[F.sum(n).alias(n) for n in checks])


def build_manifest(df: DataFrame, dataset: str, as_of: DataFrame, key: str = "symbol", time: str = "trading_date", grace_days: int = 3, pending: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """Coverage and status of each key. pending: keys with rows that wait for a merge. expected: keys that get a row
    of status empty if df has none of theirs."""
    found = df.groupBy(key).agg(F.min(time).alias("coverage_start"), F.max(time).alias("coverage_end"), F.count("*").alias("row_count"))
    if expected is not None:
        found = found.join(expected.select(key).distinct(), key, "full_outer").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    waits = pending.select(key).distinct().withColumn("needs_merge", F.lit(True)) if pending is not None else found.select(key).where(F.lit(False)).withColumn("needs_merge", F.lit(True))
    met = found.join(waits, key, "left").join(F.broadcast(as_of), F.lit(True))
    late = F.datediff("as_of", F.to_date("coverage_end"))
    status = label([(F.coalesce("needs_merge", F.lit(False)), "pending_merge"), (F.col("row_count") == 0, "empty"), (F.col("coverage_end").isNull(), "unknown"), (late <= 0, "up_to_date"), (late <= grace_days, "awaiting_refresh_window")], "stale")
    return met.select(F.lit(dataset).alias("dataset_name"), key, "coverage_start", "coverage_end", "row_count", F.coalesce("needs_merge", F.lit(False)).alias("needs_merge"), status.alias("update_status"))


def consistency_audit(manifest: DataFrame, files: DataFrame, table: DataFrame, key: str = "symbol", time: str = "trading_date") -> DataFrame:
    """Issues where manifest, files and table disagree, one row each."""
    f = files.groupBy(key).agg(F.count("*").alias("file_rows"), F.max(time).alias("file_end"))
    t = table.groupBy(key).agg(F.count("*").alias("table_rows"), F.max(time).alias("table_end"))
    met = manifest.select(key, F.col("row_count").alias("manifest_rows"), F.to_date("coverage_end").alias("manifest_end")).join(f, key, "full_outer").join(t, key, "full_outer")
    issues = F.array_compact(F.array(
        F.when(F.col("manifest_rows").isNull(), "missing_manifest"), F.when(F.col("file_rows").isNull(), "missing_file"), F.when(F.col("table_rows").isNull(), "missing_table"),
        F.when(F.col("manifest_rows") != F.col("table_rows"), "manifest_row_count"), F.when(F.col("file_rows") != F.col("table_rows"), "file_row_count"),
        F.when(F.col("manifest_end") != F.col("table_end"), "manifest_coverage"), F.when(F.col("file_end") != F.col("table_end"), "file_coverage"),
    ))
    return met.select(key, F.explode(issues).alias("issue"))


def health_summary(datasets: dict[str, tuple[DataFrame, str]], expected: DataFrame, warn: int = 1, key: str = "symbol") -> DataFrame:
    """Coverage floor of each dataset against the expected day (one row, `expected`)."""
    out = None
    for name, (df, time) in datasets.items():
        part = df.groupBy(key).agg(F.max(F.to_date(time)).alias("last")).agg(F.min("last").alias("floor"), F.count("*").alias("n_keys")).withColumn("dataset_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    out = out.join(F.broadcast(expected), F.lit(True)).withColumn("missing_days", F.greatest(trading_day_gap(F.col("floor"), F.col("expected")), F.lit(0)))
    return out.select("dataset_name", "floor", "n_keys", "missing_days", label([(F.col("missing_days") == 0, "healthy"), (F.col("missing_days") <= warn, "warning")], "stale").alias("status"))


def recommendation_freshness(recs: DataFrame, context: DataFrame) -> DataFrame:
    """Trading days by which the last recommendations lag behind the last context."""
    a, b = recs.agg(F.max("as_of_date").alias("rec_date")), context.agg(F.max("trading_date").alias("context_date"))
    return a.join(b, F.lit(True)).withColumn("lag_days", trading_day_gap(F.col("rec_date"), F.col("context_date")))


def outlier_and_missing(df: DataFrame, cols: list[str], z: float = 5.0) -> DataFrame:
    """(column, n_rows, missing_ratio, n_outliers), by one aggregation for means and one for counts."""
    stats = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    met = df.join(F.broadcast(stats), F.lit(True))
    counted = met.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_m") for c in cols], *[F.count_if(F.abs(ratio(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_std"))) > z).alias(f"{c}_o") for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), ratio(F.col(f"{c}_m").cast("double"), F.col("n").cast("double")).alias("missing_ratio"), F.col(f"{c}_o").alias("n_outliers")) for c in cols]))
    return counted.select(rows.alias("r")).select("r.*")


def assert_expectations(df: DataFrame, expectations: dict[str, tuple[Column, object]]) -> DataFrame:
    """(name, passed): aggregates against expected values."""
    made = df.agg(*[agg.alias(name) for name, (agg, _) in expectations.items()])
    return made.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n) == F.lit(v), F.lit(False)).alias("passed")) for n, (_, v) in expectations.items()])).alias("r")).select("r.*")
