"""The alert stream against the batch operators, and alerts that time alone opens."""

from __future__ import annotations

import glob
import os
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import aggregates as agg
from fathomline.plans import fixtures as fx
from fathomline.plans.relational import _alerts
from fathomline.streaming import alerts
from fathomline.streaming import events as ev

SF = "/root/testdata/sf0.001"


def run(stream: DataFrame, folder, name: str, **settings) -> list:
    """Timers ask for batches without data for ever; a stream that is to end does without."""
    out: list = []
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = alerts.alert_stream(stream, **settings).writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend((n, r) for r in b.collect())).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    ended = query.awaitTermination(90)
    query.stop()
    stream.sparkSession.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert ended
    return out


def log_in_files(spark, folder, files: int) -> DataFrame:
    """The event log as a stream of files in the order of time, one a batch."""
    log = fx.event_log(spark, SF)
    log.repartitionByRange(files, "event_ts").sortWithinPartitions("event_ts").write.parquet(f"{folder}/log")
    for n, file in enumerate(sorted(glob.glob(f"{folder}/log/part-*"))):
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # the source takes files by their time
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")


def status_column() -> F.Column:
    return F.element_at(F.array(F.lit("open"), F.lit("acknowledged"), F.lit("resolved"), F.lit("open")), (F.col("event_id") % 4 + 1).cast("int"))


def test_states_equal_the_batch_fold(spark, tmp_path):
    stream = log_in_files(spark, tmp_path, 4).where("event_type = 'alert_state_change'").withColumn("status", status_column())
    last: dict = {}
    out = run(alerts.changes(stream, F.col("symbol")), tmp_path, "c")
    for n, r in out:
        assert r["kind"] == "state"
        last[r["alert_key"]] = (n, r["status"], r["first_event_ts"], r["last_event_ts"], r["acknowledged_at"], r["resolved_at"])
    want = {r["alert_key"]: tuple(r)[1:] for r in ev.alert_state(_alerts(spark, SF)).collect()}
    assert {k: v[1:] for k, v in last.items()} == want and len({n for n, _ in out}) == 4


def both(log: DataFrame) -> DataFrame:
    runs = alerts.signals(log.where("event_type IN ('pipeline_run', 'source_request')"), F.concat(F.lit("failures|"), "symbol"), F.col("status") == "failed")
    requests = alerts.signals(log.where("event_type = 'source_request'"), F.concat(F.lit("empty|"), "symbol"), F.coalesce(F.col("value") - 20, F.lit(0.0)) <= 0)
    return runs.unionByName(requests)


def firing(log: DataFrame) -> DataFrame:
    runs = ev.rule_consecutive_failures(log.where("event_type IN ('pipeline_run', 'source_request')"))
    return agg.stack({"f": runs, "e": ev.rule_empty_payloads(log.where("event_type = 'source_request'").withColumn("value", F.col("value") - 20))})


def test_transitions_equal_those_of_the_batch_rules(spark, tmp_path):
    """All events in one batch, with what became of the alerts before."""
    log = fx.event_log(spark, SF)
    known = _alerts(spark, SF)
    keyed = agg.stack({k: known.withColumn("alert_key", F.concat(F.lit(f"{k}|"), "alert_key")) for k in ("failures", "empty")})
    rows = both(log).unionByName(alerts.changes(keyed, F.col("alert_key")))
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    out = run(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows"), tmp_path, "c")
    got = sorted((r["alert_key"], r["status"]) for _, r in out if r["kind"] == "transition")
    want = sorted((r["alert_key"], r["status"]) for r in ev.evaluate_rules(firing(log), ev.alert_state(keyed)).collect())
    assert got == want and {"open", "resolved"} == {s for _, s in got}


def test_batch_after_batch_equals_one_evaluation_after_the_other(spark, tmp_path):
    stream = log_in_files(spark, tmp_path, 3)
    out = run(both(stream), tmp_path, "c")
    files = glob.glob(f"{tmp_path}/log/part-*")
    read: list[str] = []
    status: dict[str, str] = {}
    want = []
    for n, file in enumerate(sorted(files, key=lambda f: spark.read.parquet(f).agg(F.min("event_ts")).first()[0])):
        read.append(file)
        touched = {r["alert_key"] for r in both(spark.read.parquet(file)).select("alert_key").distinct().collect()}
        was = spark.createDataFrame(list(status.items()) or [("none", "none")], "alert_key string, status string")
        for r in ev.evaluate_rules(firing(spark.read.parquet(*read)), was).collect():
            assert r["alert_key"] in touched
            want.append((n, r["alert_key"], r["status"]))
            status[r["alert_key"]] = r["status"]
    assert sorted((n, r["alert_key"], r["status"]) for n, r in out if r["kind"] == "transition") == sorted(want)
    assert {n for n, *_ in want} == {0, 1, 2}


def test_late_and_repeated_signals(spark, tmp_path):
    """Only the last two by time count; a row that comes twice is one."""
    at = datetime(2024, 1, 1)
    rows = [[(3, 3, "failed"), (3, 3, "failed")], [(1, 1, "failed")], [(2, 2, "failed")], [(9, 9, "ok")], [(4, 4, "failed")]]
    for n, batch in enumerate(rows):
        spark.createDataFrame([(i, at + timedelta(hours=h), s) for i, h, s in batch], "event_id long, event_ts timestamp_ntz, status string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema("event_id long, event_ts timestamp_ntz, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    out = run(alerts.signals(stream, F.lit("a"), F.col("status") == "failed"), tmp_path, "c")
    assert [(n, r["status"]) for n, r in out if r["kind"] == "transition"] == [(1, "open"), (3, "resolved")]


def waited(check, seconds: int = 60) -> bool:
    end = time.time() + seconds
    while time.time() < end and not check():
        time.sleep(0.3)
    return check()


def test_a_silent_heartbeat_opens_its_alert_without_an_event(spark, tmp_path):
    schema = "event_id long, event_ts timestamp_ntz, component string"
    (tmp_path / "beats").mkdir()
    beat = lambda n: spark.createDataFrame([(n, datetime.now(UTC).replace(tzinfo=None), "worker")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/beats")
    beat(1)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/beats")
    out: list = []
    made = alerts.alert_stream(alerts.beats(stream, F.concat(F.lit("heartbeat|"), "component")), grace_s=8)
    query = made.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.where("kind = 'transition'").collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        assert waited(lambda: [r["status"] for r in out] == ["open"]), (out, query.exception())
        assert out[0]["alert_key"] == "heartbeat|worker"
        beat(2)
        assert waited(lambda: [r["status"] for r in out][:2] == ["open", "resolved"]), (out, query.exception())
        assert waited(lambda: [r["status"] for r in out] == ["open", "resolved", "open"]), out
    finally:
        query.stop()


def test_resolved_alerts_are_forgotten(spark, tmp_path):
    """After that, two more failures open the alert anew, with a new first time."""
    schema = "event_id long, event_ts timestamp_ntz, status string"
    at = datetime(2024, 1, 1)
    (tmp_path / "runs").mkdir()
    put = lambda *rows: spark.createDataFrame([(i, at + timedelta(hours=i), s) for i, s in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")
    put((1, "failed"), (2, "failed"))
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/runs")
    out: list = []
    made = alerts.alert_stream(alerts.signals(stream, F.lit("failures|a"), F.col("status") == "failed"), forget_s=2)
    query = made.writeStream.outputMode("update").foreachBatch(lambda b, n: out.extend(b.where("kind = 'transition'").collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        assert waited(lambda: len(out) == 1)
        put((3, "ok"))
        assert waited(lambda: [r["status"] for r in out] == ["open", "resolved"])
        time.sleep(6)
        put((4, "failed"))
        time.sleep(4)
        assert len(out) == 2
        put((5, "failed"))
        assert waited(lambda: len(out) == 3) and out[2]["first_event_ts"] > out[0]["first_event_ts"]
    finally:
        query.stop()


@pytest.mark.parametrize("kind", ["changes", "signals", "beats"])
def test_empty_streams(spark, tmp_path, kind):
    schema = "event_id long, event_ts timestamp_ntz, status string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/none")
    made = {"changes": lambda: alerts.changes(stream, F.lit("a")), "signals": lambda: alerts.signals(stream, F.lit("a"), F.lit(True)), "beats": lambda: alerts.beats(stream, F.lit("a"))}[kind]()
    assert run(made, tmp_path, "c") == []
