"""Alerts as a stream: a state for each alert key, transitions at edges, timers for silence.

Signals of a rule (a run failed or didn't, a request was empty or not), changes of an alert (opened, acknowledged,
resolved by hand or by another program) and heartbeats of a component meet under their alert key. A batch's rows are
taken in together, then the rule is judged once, as a batch run of events.evaluate_rules() would: an alert that fires
opens unless it is open (so an acknowledged one opens again), one that doesn't fire is resolved if it was open or
acknowledged. Order is by time and id, not by arrival, so late and repeated rows change nothing that they shouldn't.

A heartbeat sets a timer; when nothing came for the grace time, the timer opens the alert without a new event. A
component that never sent one has no key here; events.rule_heartbeat() over a table sees that. A resolved alert may be
forgotten after a while, with its signals.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SIGNAL, CHANGE, BEAT = "signal", "change", "beat"
_INPUT = ["alert_key", "kind", "at", "id", "status", "bad"]
#: Microseconds since 1970 and ids: of the first event, of the last one and its status, of the last opening (or other
#: change), acknowledgement and resolution, and of the last heartbeat.
_ALERT = "first_at bigint, last_at bigint, last_id bigint, status string, o_at bigint, o_id bigint, a_at bigint, a_id bigint, r_at bigint, r_id bigint, beat_at bigint"
_NAMES = [c.split()[0] for c in _ALERT.split(", ")]
OUTPUT = "alert_key string, kind string, status string, at bigint, first_at bigint, last_at bigint, acknowledged_at bigint, resolved_at bigint"


def _micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def signals(events: DataFrame, key: Column, bad: Column, ts: str = "event_ts", id_col: str = "event_id") -> DataFrame:
    """Rows of a rule that fires when the last n of a key are all bad."""
    return events.select(key.alias("alert_key"), F.lit(SIGNAL).alias("kind"), _micros(ts).alias("at"), F.col(id_col).cast("bigint").alias("id"), F.lit(None).cast("string").alias("status"), F.coalesce(bad, F.lit(False)).alias("bad"))


def changes(events: DataFrame, key: Column, status: str = "status", ts: str = "event_ts", id_col: str = "event_id") -> DataFrame:
    """Rows that say what became of an alert."""
    return events.select(key.alias("alert_key"), F.lit(CHANGE).alias("kind"), _micros(ts).alias("at"), F.col(id_col).cast("bigint").alias("id"), F.col(status).alias("status"), F.lit(None).cast("boolean").alias("bad"))


def beats(events: DataFrame, key: Column, ts: str = "event_ts", id_col: str = "event_id") -> DataFrame:
    return events.select(key.alias("alert_key"), F.lit(BEAT).alias("kind"), _micros(ts).alias("at"), F.col(id_col).cast("bigint").alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("boolean").alias("bad"))


class Alert:
    """What is known of one alert."""

    def __init__(self, row: tuple | None):
        self.known: dict[str, Any] = dict(zip(_NAMES, row, strict=True)) if row else dict.fromkeys(_NAMES)

    def change(self, at: int, number: int, status: str | None) -> None:
        k = self.known
        k["first_at"] = at if k["first_at"] is None else min(at, k["first_at"])
        if k["last_at"] is None or (at, number) >= (k["last_at"], k["last_id"]):
            k["last_at"], k["last_id"], k["status"] = at, number, status
        part = {"acknowledged": "a", "resolved": "r"}.get(status or "", "o")
        if k[f"{part}_at"] is None or (at, number) > (k[f"{part}_at"], k[f"{part}_id"]):
            k[f"{part}_at"], k[f"{part}_id"] = at, number

    def _after(self, part: str, *others: str) -> int | None:
        own = (self.known[f"{part}_at"], self.known[f"{part}_id"])
        if own[0] is None or any(self.known[f"{o}_at"] is not None and (self.known[f"{o}_at"], self.known[f"{o}_id"]) >= own for o in others):
            return None
        return own[0]

    def judged(self, fires: bool, now: int) -> str | None:
        """The transition that a rule's answer makes, if any."""
        status = self.known["status"]
        to = "open" if fires and status != "open" else "resolved" if not fires and status in ("open", "acknowledged") else None
        if to:
            last = self.known["last_at"]
            self.change(now if last is None else max(now, last), (self.known["last_id"] or 0) + 1, to)
        return to

    def row(self, key: str, kind: str, status: str | None, at: int) -> tuple:
        k = self.known
        return key, kind, status, at, k["first_at"], k["last_at"], self._after("a", "o"), self._after("r", "o", "a")

    def values(self) -> tuple:
        return tuple(self.known[n] for n in _NAMES)


class AlertProcessor(StatefulProcessor):
    """last: signals that a rule looks at; grace_s: seconds without a heartbeat that open its alert; forget_s: seconds
    after which a resolved alert without news is forgotten (never, if None)."""

    def __init__(self, last: int = 2, grace_s: int = 120, forget_s: int | None = None):
        self.last, self.grace_s, self.forget_s = last, grace_s, forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alert = handle.getValueState("alert", _ALERT)
        self.seen = handle.getListState("seen", "at bigint, id bigint, bad boolean")

    def close(self) -> None:
        pass

    def _timer(self, at_ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(at_ms))

    def _written(self, key: str, alert: Alert, to: str | None, changed: bool, now_ms: int) -> Iterator[pd.DataFrame]:
        self.alert.update(alert.values())
        if alert.known["beat_at"] is not None:
            due = alert.known["beat_at"] // 1000 + self.grace_s * 1000 + 1
            if due > now_ms:
                self._timer(due)
        elif self.forget_s is not None and alert.known["status"] == "resolved":
            self._timer(now_ms + self.forget_s * 1000)
        rows = ([alert.row(key, "transition", to, now_ms * 1000)] if to else []) + ([alert.row(key, "state", alert.known["status"], now_ms * 1000)] if to or changed else [])
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")], dtype=object)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        alert = Alert(self.alert.get() if self.alert.exists() else None)
        signalled, changed, recent = False, False, set()
        if self.seen.exists():
            recent = {tuple(r) for r in self.seen.get()}
        for frame in rows:
            for kind, at, number, status, bad in zip(frame["kind"], frame["at"], frame["id"], frame["status"], frame["bad"], strict=True):
                at, number = int(at), int(number)
                if kind == SIGNAL:
                    recent.add((at, number, bool(bad)))
                    signalled = True
                elif kind == CHANGE:
                    alert.change(at, number, status if isinstance(status, str) else None)
                    changed = True
                else:
                    alert.known["beat_at"] = max(at, alert.known["beat_at"] or at)
            if len(recent) > 10_000:  # of a large batch only the last count
                recent = set(sorted(recent)[-self.last :])
        kept = sorted(recent)[-self.last :]
        fires = None
        if signalled or kept:
            self.seen.put(kept)
            fires = len(kept) == self.last and all(bad for *_, bad in kept)
        elif alert.known["beat_at"] is not None:
            fires = now_ms * 1000 - alert.known["beat_at"] > self.grace_s * 1_000_000
        yield from self._written(key[0], alert, alert.judged(fires, now_ms * 1000) if fires is not None else None, changed, now_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        alert = Alert(self.alert.get() if self.alert.exists() else None)
        if alert.known["beat_at"] is None:
            if alert.known["status"] == "resolved":
                self.alert.clear()
                self.seen.clear()
            return
        silent = now_ms * 1000 - alert.known["beat_at"] > self.grace_s * 1_000_000
        yield from self._written(key[0], alert, alert.judged(silent, now_ms * 1000), False, now_ms)


def alert_stream(rows: DataFrame, last: int = 2, grace_s: int = 120, forget_s: int | None = None) -> DataFrame:
    """Of a stream of signals, changes and beats: a row of kind `transition` for each edge that a rule or a timer finds,
    and a row of kind `state` for each alert that changed, with the times of events.alert_state(). To be written in
    update mode, by a trigger that goes on: a stream that ends (availableNow) waits for timers for ever unless
    spark.sql.streaming.noDataMicroBatches.enabled is off. The session's state store must keep timers: that is set here."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    made = rows.select(*_INPUT).groupBy("alert_key").transformWithStateInPandas(AlertProcessor(last, grace_s, forget_s), OUTPUT, "Update", "processingTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return made.select("alert_key", "kind", "status", time("at").alias("at"), time("first_at").alias("first_event_ts"), time("last_at").alias("last_event_ts"), time("acknowledged_at").alias("acknowledged_at"), time("resolved_at").alias("resolved_at"))
