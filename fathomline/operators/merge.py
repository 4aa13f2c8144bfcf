"""Incremental merging: upserts, slice replacement, merge on read, compaction, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import build_manifest


def append_new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], time: str | None = None) -> DataFrame:
    """Rows of incoming whose key is new, one of each. time: a key column; only stored rows between its first and last
    value in incoming take part, by scalar subqueries."""
    stored = existing
    if time is not None:
        assert time in keys, "the bounded column has to be a key"
        first, last = incoming.agg(F.min(time)), incoming.agg(F.max(time))
        stored = existing.where((F.col(time) >= first.scalar()) & (F.col(time) <= last.scalar()))
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def replace_slices(base: DataFrame, batch: DataFrame, key: str, time: str) -> DataFrame:
    """For each key of the batch, the stored rows between its first and last time give way to the batch's."""
    cuts = batch.groupBy(key).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    kept = base.join(cuts, key, "left").where(F.col("__lo").isNull() | (F.col(time) < F.col("__lo")) | (F.col(time) > F.col("__hi")))
    return kept.select(base.columns).unionByName(batch.select(base.columns))


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of the batch replace those of their key; of several of one key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    latest = batch.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    return base.join(latest.select(*keys), keys, "left_anti").select(base.columns).unionByName(latest.select(base.columns))


def insert_ignore(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(append_new_rows(base, batch, keys).select(base.columns))


def bump_version(state: DataFrame, change: DataFrame) -> DataFrame:
    """state (dataset_name, version, latest_data_ts, run_id) after a change (dataset_name, latest_data_ts, run_id)."""
    met = state.withColumnsRenamed({"latest_data_ts": "__ts", "run_id": "__run"}).join(change.withColumn("__new", F.lit(1)), "dataset_name", "full_outer")
    new = F.col("__new").isNotNull()
    return met.select("dataset_name", (F.coalesce("version", F.lit(0)) + F.coalesce("__new", F.lit(0))).cast("bigint").alias("version"), F.when(new, F.col("latest_data_ts")).otherwise(F.col("__ts")).alias("latest_data_ts"), F.when(new, F.col("run_id")).otherwise(F.col("__run")).alias("run_id"))


def trim(df: DataFrame, col: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows from cutoff on, and the count of those before."""
    return df.where(F.col(col) >= cutoff), df.where(F.col(col) < cutoff).agg(F.count("*").alias("n_deleted"))


def merge_on_read(base: DataFrame, delta: DataFrame, keys: list[str], prefer: str = "delta") -> DataFrame:
    first, second = (delta, base) if prefer == "delta" else (base, delta)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti").select(first.columns))


def eod_compact(base: DataFrame, delta: DataFrame, as_of: Column, lookback_days: int = 60, key: str = "symbol", time: str = "bar_time") -> tuple[DataFrame, DataFrame]:
    """Delta sessions up to as_of move into base, which keeps lookback_days; the rest of the delta stays."""
    done = delta.where(F.col("session_date") <= as_of)
    merged = replace_slices(base, done, key, time).where(F.col("session_date") >= F.date_sub(as_of, lookback_days))
    return merged, delta.where(F.col("session_date") > as_of)


def eod_reconcile(base: DataFrame, delta: DataFrame, state: DataFrame, as_of: Column, dataset: str, run_id: str, lookback_days: int = 60, key: str = "symbol", time: str = "bar_time") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(base, delta, manifest, state): compaction with the manifest of the new base and the dataset's next version."""
    merged, rest = eod_compact(base, delta, as_of, lookback_days, key, time)
    manifest = build_manifest(merged, dataset, merged.agg(F.max(F.to_date(time)).alias("as_of")), key, time)
    change = manifest.agg(F.max("coverage_end").alias("latest_data_ts")).select(F.lit(dataset).alias("dataset_name"), "latest_data_ts", F.lit(run_id).alias("run_id"))
    return merged, rest, manifest, bump_version(state, change)
