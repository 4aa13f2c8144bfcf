"""Event streams: deduplication, projections, alert states, delta ingest. Batch and stream share the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.exprs import label
from ..operators.blocks import Parts, framed
from ..operators.merge import replace_slices, upsert

#: The folders of a stream's table, and the start of the empty file that names their number once all are in place.
BUCKET, MARK = "key_bucket", "_buckets-"

#: Event types and the key of the table that each one feeds.
PROJECTIONS = {"pipeline_run": "run_id", "source_request": "symbol", "checkpoint_updated": "symbol", "scheduler_heartbeat": "component", "alert_state_change": "symbol"}


def dedupe_events(events: DataFrame, id_col: str = "event_id", ts: str = "event_ts", watermark: str = "1 hour") -> DataFrame:
    if not events.isStreaming:
        return events.dropDuplicates([id_col])
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([id_col])


def latest(events: DataFrame, key: str, ts: str = "event_ts", id_col: str = "event_id") -> DataFrame:
    """The last event of each key; ties by id."""
    names = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(ts, id_col)).alias("r")).select(key, "r.*")


def checkpoint_projection(events: DataFrame) -> DataFrame:
    return latest(events.where("event_type = 'checkpoint_updated'"), "symbol")


def project_events(events: DataFrame, keys: dict[str, str] = PROJECTIONS) -> dict[str, DataFrame]:
    """Latest state tables by event type; other types feed none."""
    return {kind: latest(events.where((F.col("event_type") == kind) & F.col(key).isNotNull()), key) for kind, key in keys.items() if key in events.columns}


def alert_state(events: DataFrame, key: str = "alert_key") -> DataFrame:
    """Open clears acknowledgement and resolution, acknowledging clears the resolution, resolving keeps the
    acknowledgement. What holds at the end follows from the last times of each change, so no ordered fold is
    needed."""
    at = F.struct("event_ts", "event_id")
    when = lambda s: F.max(F.when(F.col("status") == s, at))
    other = F.max(F.when(~F.col("status").isin("acknowledged", "resolved") | F.col("status").isNull(), at))
    made = events.groupBy(key).agg(F.min("event_ts").alias("first_event_ts"), F.max("event_ts").alias("last_event_ts"), F.max_by("status", at).alias("status"), when("acknowledged").alias("a"), when("resolved").alias("r"), other.alias("o"))
    acked = F.col("a").isNotNull() & (F.col("o").isNull() | (F.col("a") > F.col("o")))
    done = F.col("r").isNotNull() & (F.col("o").isNull() | (F.col("r") > F.col("o"))) & (F.col("a").isNull() | (F.col("r") > F.col("a")))
    return made.select(key, "status", "first_event_ts", "last_event_ts", F.when(acked, F.col("a.event_ts")).alias("acknowledged_at"), F.when(done, F.col("r.event_ts")).alias("resolved_at"))


def manual_transition(alerts: DataFrame, key: Column, status: str, ts: Column) -> DataFrame:
    """An event that acknowledges or resolves the alerts that are key and not already so."""
    return alerts.where(key & (F.col("status") != status)).select("alert_key", F.lit(status).alias("status"), ts.alias("event_ts"), F.sha1(F.concat_ws("|", "alert_key", F.lit(status), ts.cast("string"))).alias("event_id"))


def rule_heartbeat(heartbeats: DataFrame, now: Column, grace: int = 120) -> DataFrame:
    lag = F.unix_timestamp(now) - F.unix_timestamp(F.max("event_ts"))
    return heartbeats.agg(lag.alias("lag")).select(F.lit("heartbeat").alias("alert_key"), (F.coalesce("lag", F.lit(1 << 30)) > grace).alias("firing"))


def rule_intraday_lag(bars: DataFrame, slot: Column, minutes: int = 30) -> DataFrame:
    floor = bars.groupBy("symbol").agg(F.max("bar_time").alias("last")).agg(F.min("last").alias("floor"))
    return floor.select(F.lit("intraday_lag").alias("alert_key"), ((F.unix_timestamp(slot) - F.unix_timestamp("floor")) > minutes * 60).alias("firing"))


def rule_eod_missing(bars: DataFrame, now: Column, cutoff: str = "18:00", time: str = "trading_date") -> DataFrame:
    due = (F.date_format(now, "HH:mm") >= cutoff) & (F.weekday(now) < 5)
    return bars.agg(F.max(time).alias("last")).select(F.lit("eod_missing").alias("alert_key"), (due & (F.to_date("last") < F.to_date(now))).alias("firing"))


def _all_of_last(df: DataFrame, keys: list[str], n: int, bad: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("event_ts"), F.desc("event_id"))
    last = df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= n)
    return last.groupBy(*keys).agg(((F.count("*") == n) & F.bool_and(bad)).alias("firing"))


def rule_consecutive_failures(runs: DataFrame, n: int = 2, key: str = "symbol") -> DataFrame:
    return _all_of_last(runs, [key], n, F.col("status") == "failed").select(F.concat(F.lit("failures|"), key).alias("alert_key"), "firing")


def rule_empty_payloads(requests: DataFrame, n: int = 2, key: str = "symbol", rows: str = "value") -> DataFrame:
    return _all_of_last(requests, [key], n, F.coalesce(F.col(rows), F.lit(0.0)) <= 0).select(F.concat(F.lit("empty|"), key).alias("alert_key"), "firing")


def rule_manifest_mismatch(mismatches: DataFrame) -> DataFrame:
    return mismatches.agg(F.count("*").alias("n")).select(F.lit("manifest_mismatch").alias("alert_key"), (F.col("n") > 0).alias("firing"))


def rule_pending_merge(manifest: DataFrame, as_of: Column) -> DataFrame:
    waits = F.col("needs_merge") & (F.to_date("coverage_end") < as_of)
    return manifest.agg(F.count_if(waits).alias("n")).select(F.lit("pending_merge").alias("alert_key"), (F.col("n") > 0).alias("firing"))


def evaluate_rules(firing: DataFrame, status: DataFrame) -> DataFrame:
    """Transitions: open unless already open (so an acknowledged alert opens again), resolve only what is open or
    acknowledged."""
    met = firing.join(status.select("alert_key", F.col("status").alias("was")), "alert_key", "left")
    to = label([(F.col("firing") & (F.coalesce("was", F.lit("none")) != "open"), "open"), (~F.col("firing") & F.col("was").isin("open", "acknowledged"), "resolved")], None)
    return met.withColumn("status", to).where(F.col("status").isNotNull()).select("alert_key", "status")


def ops_views(runs: DataFrame, alerts: DataFrame, bars: DataFrame) -> dict[str, DataFrame]:
    return {
        "active_alerts": alerts.where(F.col("status").isin("open", "acknowledged")),
        "recent_failures": runs.where("status = 'failed'").orderBy(F.desc("event_ts"), F.desc("event_id")).limit(50),
        "latest_job_status": latest(runs, "symbol"),
        "symbol_lag": bars.groupBy("symbol").agg(F.max("bar_time").alias("last_bar_time"), F.count("*").alias("n_bars")),
    }


def missing_slots(slots: DataFrame, seen: DataFrame, key: str = "symbol", time: str = "bar_time", rows: int | None = None) -> DataFrame:
    """(key, time) of the slots that a key of seen lacks, among those before its first and after its last too.

    Slots are numbered in order; a key's own numbers leave gaps, between one and the next and at both ends, and only
    the gaps are made into rows, so that the product of keys and slots never is.
    """
    numbered = slots.select(time).distinct().withColumn("__n", F.row_number().over(Window.orderBy(time)))  # a row a slot
    last = numbered.agg(F.coalesce(F.max("__n"), F.lit(0)).alias("__last"))
    own = seen.select(key, time).distinct().join(numbered, time).select(key, "__n").join(F.broadcast(last), F.lit(True))

    def gaps(parts: Parts, keys: list[str]) -> DataFrame:
        line = Window.partitionBy(*keys).orderBy("__n")
        behind = F.struct((F.col("__n") + 1).alias("from"), (F.coalesce(F.lead("__n").over(line), F.col("__last") + 1) - 1).alias("to"))
        ahead = F.when(F.lag("__n").over(line).isNull(), F.struct(F.lit(1).alias("from"), (F.col("__n") - 1).alias("to")))
        return parts.rows.withColumn("__gap", F.filter(F.array_compact(F.array(ahead, behind)), lambda g: g["from"] <= g["to"]))

    found = framed(own, key, "__n", 1, 1, gaps, rows).select(key, F.explode("__gap").alias("g"))
    return found.select(key, F.explode(F.sequence("g.from", "g.to")).alias("__n")).join(numbered, "__n").select(key, time)


def missing_dates(calendar: DataFrame, seen: DataFrame, day: str = "day", time: str = "trading_date") -> DataFrame:
    return calendar.join(seen.select(F.col(time).alias(day)).distinct(), day, "left_anti")


def delta_slice(source: DataFrame, stored: DataFrame, slot: Column, minutes: int = 15, overlap: int = 1, key: str = "symbol", time: str = "bar_time") -> DataFrame:
    """What a delta run reads of source: each key's bars from its last stored ones on (overlap of them once more, since
    they may have been open when they were read), up to the last bar that is complete at slot. Keys that aren't stored
    are read from their beginning."""
    seen = stored.groupBy(key).agg(F.max(time).alias("__last"))
    met = source.join(seen, key, "left")
    begin = F.col("__last") - F.expr(f"INTERVAL {minutes * (overlap - 1)} MINUTES")
    return met.where((F.col("__last").isNull() | (F.col(time) >= begin)) & (F.col(time) + F.expr(f"INTERVAL {minutes} MINUTES") <= slot)).drop("__last")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a table, in order. One without its writer's _SUCCESS file was never finished."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return []
    names = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("version=")]
    return sorted(int(n.getName().split("=")[1]) for n in names if files.exists(_files(spark, f"{n.toString()}/_SUCCESS")[1]))


def _inside(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, path)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []


def _drop(spark: SparkSession, path: str, names: list[str]) -> None:
    for name in names:
        files, place = _files(spark, f"{path}/{name}")
        files.delete(place, True)


def _n_buckets(names: list[str]) -> int | None:
    """The number of buckets that a table's mark names; none for a table that isn't cut into buckets yet."""
    marks = [int(name.removeprefix(MARK)) for name in names if name.startswith(MARK)]
    return marks[0] if marks else None


def current(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows of a stream's table: of its buckets once it is cut into them, else of its last whole version, else of
    the plain files that something else wrote. Where there is nothing, an empty table of the schema, or without one an
    error."""
    names = _inside(spark, path)
    if _n_buckets(names) is not None:
        found = [f"{path}/{name}" for name in names if name.startswith(f"{BUCKET}=")]
    elif known := versions(spark, path):
        return spark.read.parquet(f"{path}/version={known[-1]}")
    else:
        found = [f"{path}/{name}" for name in names if not name.startswith((".", "_", "version=", f"{BUCKET}="))]
    if found:
        return spark.read.option("basePath", path).parquet(*found).drop(BUCKET)
    if schema is None:
        raise ValueError(f"no table at {path}: it has no buckets, finished version or other files")
    return spark.createDataFrame([], schema)


def _replace_touched(batch: DataFrame, batch_id: int, path: str, checkpoint: str, keys: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int) -> None:
    """Merges a batch into the buckets that its keys fall into; other buckets' files are neither read nor written.

    The merged buckets are written beside the query's checkpoint first, then put in place by a dynamic partition
    overwrite. A failure before leaves the table as it was. One while they are put in place can leave buckets away
    until the same batch runs again, which takes what is beside the checkpoint, whatever the table holds by then; so a
    batch can be run any number of times. A table in another form is cut into buckets by its first batch, and read in
    the old form until all of them are in place.
    """
    spark = batch.sparkSession
    names = _inside(spark, path)
    known = _n_buckets(names)
    n = known or buckets
    bucket = F.pmod(F.hash(*keys), F.lit(n))
    ready = f"{checkpoint}/merged/batch-{batch_id}"
    if "_SUCCESS" not in _inside(spark, ready):
        base = current(spark, path, batch.schema)
        if known is not None:
            touched = [row[0] for row in batch.select(bucket).distinct().collect()]  # at most one number a bucket
            there = [f"{path}/{BUCKET}={k}" for k in touched if f"{BUCKET}={k}" in names]
            base = spark.read.schema(base.schema).parquet(*there) if there else spark.createDataFrame([], base.schema)
        merged(base, batch).withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.mode("overwrite").parquet(ready)
    if known is None:
        _drop(spark, path, [name for name in names if name.startswith(f"{BUCKET}=")])  # of a first batch that was stopped
    spark.read.parquet(ready).hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    if known is None:
        files, mark = _files(spark, f"{path}/{MARK}{n}")
        files.create(mark, True).close()
    _drop(spark, path, [name for name in _inside(spark, path) if not name.startswith((".", "_", f"{BUCKET}="))])  # the old form
    _drop(spark, f"{checkpoint}/merged", [name for name in _inside(spark, f"{checkpoint}/merged") if name != f"batch-{batch_id}"])


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: Callable[[], list[Column]], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps a table of the last row of each key, in buckets of keys; a batch rewrites the buckets of its keys. buckets
    counts for a new table only. The table has no column named key_bucket, and one writer at a time."""

    def merged(base: DataFrame, batch: DataFrame) -> DataFrame:
        return upsert(base, batch.unionByName(base.join(batch.select(*keys).distinct(), keys, "left_semi")), keys, order())

    def put(batch: DataFrame, batch_id: int) -> None:
        _replace_touched(batch, batch_id, path, checkpoint, keys, merged, buckets)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delta_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "symbol", time: str = "bar_time", buckets: int = 64) -> StreamingQuery:
    """Each batch replaces its keys' slices of the delta table: rows that are read again overwrite. Of several rows of
    a key and time in a batch the greatest is kept. The table holds the sessions since the last compaction, in buckets
    of keys, of which a batch rewrites its keys'. buckets counts for a new table only. The table has no column named
    key_bucket, and one writer at a time."""

    def merged(base: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in batch.columns if c not in (key, time)]
        one = batch.groupBy(key, time).agg(F.max(F.struct(*rest)).alias("r")).select(key, time, "r.*")
        return replace_slices(base, one, key, time)

    def put(batch: DataFrame, batch_id: int) -> None:
        _replace_touched(batch, batch_id, path, checkpoint, [key], merged, buckets)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
