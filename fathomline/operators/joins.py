"""Joins over keyed, timed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_return
from .blocks import parts_of


def range_join(left: DataFrame, right: DataFrame, key: str, point: str, lo: str, hi: str, bucket: int) -> DataFrame:
    """Rows whose key agrees and whose left point lies in the right [lo, hi]. Right rows are copied into the buckets
    they cover, so that the join is on equal keys and buckets."""
    spread = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    placed = left.withColumn("__b", F.floor(F.col(point) / bucket))
    return placed.join(spread, [key, "__b"]).where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("__b")


def asof_latest(df: DataFrame, key: str, time: str, as_of: Column) -> DataFrame:
    """The last row of each key at or before as_of. Of several rows of one time, any is kept."""
    names = [c for c in df.columns if c != key]
    kept = df.where(F.col(time) <= as_of)
    return kept.groupBy(key).agg(F.max_by(F.struct(*names), F.col(time)).alias("r")).select(key, "r.*")


def first_on_or_after(df: DataFrame, key: str, time: str, when: Column) -> DataFrame:
    names = [c for c in df.columns if c != key]
    kept = df.where(F.col(time) >= when)
    return kept.groupBy(key).agg(F.min_by(F.struct(*names), F.col(time)).alias("r")).select(key, "r.*")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, cols: list[str], rows: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time. Both stand in one order, cut into parts
    of keys and times; a part takes the last right row of its own, or else the one carried into it."""
    a = left.select(key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("__seen"))
    b = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(*cols).alias("__seen"))
    parts = parts_of(a.unionByName(b), [key], ["__t", "__side"], rows)
    parts = parts.carried(__before=(F.max_by("__seen", F.when(F.col("__seen").isNotNull(), F.struct("__t", "__side"))), lambda c: F.last(c, True)))
    seen = F.coalesce(F.last("__seen", True).over(parts.so_far), "__before")
    return parts.rows.withColumn("__seen", seen).where("__side = 1").select("__row.*", *[F.col(f"__seen.{c}").alias(f"asof_{c}") for c in cols])


def entry_current_prices(bars: DataFrame, entry_date: Column, as_of: Column) -> DataFrame:
    """First close on or after entry and last close up to as_of, for symbols that have either."""
    entry = first_on_or_after(bars, "symbol", "trading_date", entry_date).select(F.col("symbol").alias("s1"), F.col("trading_date").alias("entry_date"), F.col("close").alias("entry_price"))
    current = asof_latest(bars, "symbol", "trading_date", as_of).select(F.col("symbol").alias("s2"), F.col("trading_date").alias("current_date"), F.col("close").alias("current_price"))
    return entry.join(current, F.col("s1") == F.col("s2"), "full_outer").select(F.coalesce("s1", "s2").alias("symbol"), "entry_date", "entry_price", "current_date", "current_price")


def period_return(df: DataFrame, start: Column, end: Column, by: str = "symbol") -> DataFrame:
    """Close at the last row up to end over the first row from start, in one aggregation."""
    kept = df.where((F.col("trading_date") >= start) & (F.col("trading_date") <= end))
    made = kept.groupBy(by).agg(F.min_by("close", "trading_date").alias("start_close"), F.max_by("close", "trading_date").alias("end_close"))
    return made.withColumn("period_return", safe_return(F.col("end_close"), F.col("start_close")))


def latest_run_rows(runs: DataFrame, rows: DataFrame, max_as_of: Column | None = None) -> DataFrame:
    """Rows of the last successful run."""
    good = runs.where("status = 'ok'") if max_as_of is None else runs.where((F.col("status") == "ok") & (F.col("as_of_date") <= max_as_of))
    return rows.join(F.broadcast(good.orderBy(F.desc("as_of_date"), F.desc("run_id")).limit(1).select("run_id")), "run_id", "left_semi")


def latest_date_rows(df: DataFrame, date_col: str) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.max(date_col).alias("__last"))), F.col(date_col) == F.col("__last")).drop("__last")


def catalog_with_counts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their number of columns."""
    return tables.join(columns.groupBy("table_name").agg(F.count("*").alias("n_columns")), "table_name", "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))


def manifest_mismatches(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest rows whose count or end differ from the data's."""
    met = manifest.join(actual, "symbol", "left")
    return met.where((F.col("row_count") != F.coalesce("actual_rows", F.lit(0))) | ~F.col("coverage_end").eqNullSafe(F.col("actual_end"))).select("symbol", "row_count", "actual_rows")


def term_overlap(query_terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, overlap) of arrays of distinct terms."""
    q = query_terms.select("query_id", F.explode("terms").alias("term"))
    d = doc_terms.select("doc_id", F.explode("terms").alias("term"))
    return d.join(q, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("overlap"))


def documents_with_chunks(docs: DataFrame, chunks: DataFrame, by: str = "source") -> DataFrame:
    """Documents and chunks by type; chunks are counted before the join."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"))
    return docs.join(counted, "doc_id", "left").groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_chunks"), F.sum(F.coalesce("chars", F.lit(0))).alias("n_chars"))
