"""Leases and reservations over a stream, with timers: what the batch fold of operators/timed.py gives, whatever the order in which
events come within the watermark's delay.

A key's events wait in list state until the watermark has passed them, and are then taken in order of time and id; a
timer is set for each. The end of a lease or reservation is a timer too, so it comes without any event of its key.
Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.timed import OUTCOMES, Step, advance, lease_step, reservation_step

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TimedProcessor(StatefulProcessor):
    """Waiting events as (at_ms, event_id, inputs as JSON), and the state of the step as JSON."""

    def __init__(self, key: str, inputs: list[str], step: Step):
        self.key, self.inputs, self.step = key, inputs, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_ms long, event_id long, event string")
        self.now = handle.getValueState("now", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.appendValue((row["at_ms"], row["event_id"], json.dumps([row[c] for c in self.inputs])))
            self.handle.registerTimer(row["at_ms"])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(e) for e in self.waiting.get()) if self.waiting.exists() else []
        due = [e for e in waiting if e[0] <= until]
        state = json.loads(self.now.get()[0]) if self.now.exists() else None
        before, out = state, []
        for at, event_id, event in due:
            for state, row in advance(self.step, state, at):
                out.append(row)
            state, (outcome, number) = self.step(state, tuple(json.loads(event)), at)
            out.append((at, event_id, outcome, number))
        for state, row in advance(self.step, state, until):
            out.append(row)
        if due:
            self.waiting.put(waiting[len(due) :]) if len(due) < len(waiting) else self.waiting.clear()
        if state != before:
            self.now.update((json.dumps(state),))
            if state and state[0] is not None and state[0] > until:
                self.handle.registerTimer(state[0])
        for at, event_id, outcome, number in out:
            yield Row(**{self.key: key[0], "at_ms": at, "event_id": event_id, "outcome": outcome, "number": number})

    def close(self) -> None:
        pass


def timed_stream(events: DataFrame, key: str, inputs: list[str], step: Step, delay: str = "10 minutes") -> DataFrame:
    """key and OUTCOMES of a stream of events (key, at_ms, event_id, inputs). Events later than the watermark are dropped by Spark."""
    rows = events.select(key, "at_ms", "event_id", *inputs, F.timestamp_millis("at_ms").alias("_at")).withWatermark("_at", delay)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {OUTCOMES}"
    return rows.groupBy(key).transformWithState(TimedProcessor(key, inputs, step), schema, "append", "eventTime")


def lease_stream(events: DataFrame, lease_ms: int = 120_000, most_attempts: int = 3, delay: str = "10 minutes") -> DataFrame:
    """events: job_id, at_ms, event_id, event, owner."""
    return timed_stream(events, "job_id", ["event", "owner"], lease_step(lease_ms, most_attempts), delay)


def reservation_stream(events: DataFrame, reserved_ms: int, started_ms: int, delay: str = "10 minutes") -> DataFrame:
    """events: reservation_id, at_ms, event_id, event, tokens."""
    return timed_stream(events, "reservation_id", ["event", "tokens"], reservation_step(reserved_ms, started_ms), delay)
