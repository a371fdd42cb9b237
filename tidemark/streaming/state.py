"""Keyed state machines over ordered outcomes, for streams and (the same step) for batches.

Each machine is a pure step: (state, event) -> (state, output), plus a rule that says when a state lapses by itself. As a stream it is a
stateful processor in event time: a key's state is one typed value, a timer is set for the moment at which it lapses, and a state that
equals the start is not kept at all, so what is stored are the keys that are in trouble now and not all keys ever seen.

Rows of a key are applied in (ts, seq) order within a micro-batch, so a key's rows of one micro-batch are sorted in memory; between micro-batches they are
applied as they come. Where states lapse, rows that come later than the watermark (which starts at 1970) are dropped by Spark.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

Step = Callable[[tuple, Any], tuple[tuple, tuple]]


@dataclass(frozen=True)
class Machine:
    """`lapses`: microseconds of event time at which a state turns into the start by itself, or None.
    `lapsed`: what is then put out, or None for nothing."""

    start: tuple
    state_schema: str
    out_schema: str  # columns after key, ts, seq
    step: Step
    lapses: Callable[[tuple], int | None] | None = None
    lapsed: tuple | None = None

    @property
    def out_names(self) -> list[str]:
        return [c.split()[0] for c in self.out_schema.split(", ")]


def _apply(machine: Machine, key: tuple, state: tuple, rows: Iterable[Any]) -> tuple[tuple, list[tuple]]:
    out = []
    for e in sorted(rows, key=lambda e: (e.ts, e.seq)):
        state, made = machine.step(state, e)
        out.append((*key, e.ts, e.seq, *made))
    return state, out


def _schema(events: DataFrame, keys: list[str], machine: Machine) -> T.StructType:
    return T.StructType([T.StructField(c, events.schema[c].dataType) for c in [*keys, "ts", "seq"]] + T.StructType.fromDDL(machine.out_schema).fields)


class _Processor(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str]) -> None:
        self.machine, self.row = machine, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("state", self.machine.state_schema)
        if self.machine.lapses:
            self.timer = handle.getValueState("timer", "at bigint")  # the timer that is set, in milliseconds

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        kept = self.value.get()
        state, out = _apply(self.machine, key, self.machine.start if kept is None else tuple(kept), rows)
        if state == self.machine.start:
            self.value.clear()
        else:
            self.value.update(state)
        if self.machine.lapses:
            self._set_timer(self.machine.lapses(state))
        return iter([self.row(*r) for r in out])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.value.clear()
        self.timer.clear()
        if self.machine.lapsed is None:
            return iter([])
        return iter([self.row(*key, _when(expiredTimerInfo.getExpiryTimeInMs()), None, *self.machine.lapsed)])

    def _set_timer(self, at: int | None) -> None:
        was = self.timer.get()
        now = None if at is None else -(-at // 1000)  # timers count milliseconds: the first at which the state has lapsed
        if was is not None and was[0] != now:
            self.handle.deleteTimer(was[0])
            self.timer.clear()
        if now is not None and (was is None or was[0] != now):
            self.handle.registerTimer(now)
            self.timer.update((now,))

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """One output row per event, and one (seq null, ts the moment) for each state that lapses with an output. `events` carries a watermark on ts."""
    needed = [f.split()[0] for f in machine.state_schema.split(", ")]
    if {*needed} & {*keys}:
        raise ValueError(f"state fields {needed} and keys {keys} must differ")
    # Stateful processors need this store; a session that brings another one is set to it.
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = _schema(events, keys, machine)
    return events.groupBy(*keys).transformWithState(_Processor(machine, schema.fieldNames()), schema, "Append", "EventTime" if machine.lapses else "None")


def run_batch(events: DataFrame, keys: list[str], machine: Machine) -> DataFrame:
    """The batch twin: every key from its start, without lapses at the end."""
    schema = _schema(events, keys, machine)

    def fn(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_apply(machine, key, machine.start, frame.itertuples(index=False))[1], columns=schema.fieldNames())

    return events.groupBy(*keys).applyInPandas(fn, schema)


def _micros(ts: datetime.datetime) -> int:
    """Microseconds since the epoch. Rows carry local times without a zone, frames UTC times (pandas takes those without a zone as such)."""
    return round(ts.timestamp() * 1_000_000)


def _when(millis: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(millis / 1000)


def host_circuit(threshold: int = 3, open_sec: float = 900) -> Machine:
    """Events (host, ts, seq, failed). Consecutive failures open a host; a success clears the count but not an
    open state; each failure past the threshold stamps the opening anew; more than `open_sec` later it is
    closed with a clear count. Expiry is judged in event time: before each event, and by a timer where none comes."""
    lasts = round(open_sec * 1_000_000)

    def step(state: tuple, e: Any) -> tuple[tuple, tuple]:
        failures, opened = state
        now = _micros(e.ts)
        if opened is not None and now - opened > lasts:
            failures, opened = 0, None
        if e.failed:
            failures += 1
            if failures >= threshold:
                opened = now
        else:
            failures = 0
        return (failures, opened), (failures, opened is not None)

    return Machine((0, None), "failures int, opened bigint", "failures int, open boolean", step, lambda s: None if s[1] is None else s[1] + lasts + 1, (0, False))


def watchdog(limit: int = 5) -> Machine:
    """Events (key, ts, seq, outcome): 'breach' alarms at once, `limit` consecutive 'failure's do, 'ok' resets."""

    def step(state: tuple, e: Any) -> tuple[tuple, tuple]:
        run = state[0] + 1 if e.outcome == "failure" else 0 if e.outcome == "ok" else state[0]
        return (run,), (run, e.outcome == "breach" or run >= limit)

    return Machine((0,), "run int", "run int, alarm boolean", step)


def throttle(interval_sec: float) -> Machine:
    """Events (key, ts, seq, delivered): pass an alert, then none for the interval; only a delivered one starts the clock.
    Once the interval is over nothing has to be remembered, so the state lapses."""
    lasts = round(interval_sec * 1_000_000)

    def step(state: tuple, e: Any) -> tuple[tuple, tuple]:
        last, now = state[0], _micros(e.ts)
        send = last is None or now - last >= lasts
        return (now if send and e.delivered else last,), (send,)

    return Machine((None,), "last bigint", "sent boolean", step, lambda s: None if s[0] is None else s[0] + lasts)


def ledger() -> Machine:
    """Events (article_id, ts, seq, outcome): running status and attempts; 'stale' resets the count."""

    def step(state: tuple, e: Any) -> tuple[tuple, tuple]:
        attempts = 0 if e.outcome == "stale" else state[1] + 1
        return (e.outcome, attempts), (e.outcome, attempts)

    return Machine((None, 0), "status string, attempts int", "status string, attempts int", step)


def image_queue() -> Machine:
    """Events (article_id, source_url, ts, seq, event): ok, dead or error count an attempt; requeue and kill are the operator's moves."""

    def step(state: tuple, e: Any) -> tuple[tuple, tuple]:
        status, attempts = state
        if e.event == "requeue":
            if status in ("dead", "error"):
                status, attempts = "pending", 0
        elif e.event == "kill":
            status = "dead" if status in ("pending", "error") else status
        else:
            status, attempts = e.event, attempts + 1
        return (status, attempts), (status, attempts)

    return Machine(("pending", 0), "status string, attempts int", "status string, attempts int", step)
