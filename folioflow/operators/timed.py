"""Folds over events in which time itself is an event: a lease or a reservation ends when nothing happens.

A step takes a key's state, an event (None when the state's deadline has come) and the time; it gives the next state
and an outcome. A state is a list whose first item is its deadline in milliseconds, or None. A deadline comes before an event of the same time.
The batch form is here, the form with timers is in streaming/timers.py; both apply advance() and the same steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .jobs import RETRY_MINUTES

State = list | None
Step = Callable[[State, tuple | None, int], tuple[State, tuple]]

#: Of each outcome: the event (null for a deadline), its time, what came of it, and a number: attempts of a job, or tokens charged.
OUTCOMES = "at_ms long, event_id long, outcome string, number long"


def advance(step: Step, state: State, until: int) -> Iterator[tuple[State, tuple]]:
    """State and outcome row after each deadline up to `until`."""
    while state and state[0] is not None and state[0] <= until:
        at = state[0]
        state, (outcome, number) = step(state, None, at)
        yield state, (at, None, outcome, number)


def lease_step(lease_ms: int, most_attempts: int = 3) -> Step:
    """A job's leases. The state is [end of the lease, status, attempts, owner, time from which it may be claimed]. Events are
    (event, owner): claim, renew, complete, fail. Only the owner of a running job renews or ends it. A job whose lease ends
    may be claimed again; after its last attempt it fails."""

    def step(state: State, event: tuple | None, at: int) -> tuple[State, tuple]:
        _, status, attempts, owner, run_at = state or [None, "queued", 0, None, None]
        end = state[0] if state else None
        if event is None:
            spent = attempts >= most_attempts
            return [None, "failed" if spent else "queued", attempts, None, run_at], ("lease_exhausted" if spent else "lease_ended", attempts)
        kind, caller = event
        own = status == "running" and caller is not None and owner == caller
        if kind == "claim":
            if status == "queued" and (run_at is None or run_at <= at):
                return [at + lease_ms, "running", attempts + 1, caller, run_at], ("claimed", attempts + 1)
            return [end, status, attempts, owner, run_at], ("refused", attempts)
        if not own:
            return [end, status, attempts, owner, run_at], ("lease_lost", attempts)
        if kind == "renew":
            return [at + lease_ms, status, attempts, owner, run_at], ("renewed", attempts)
        if kind == "complete":
            return [None, "succeeded", attempts, None, None], ("completed", attempts)
        if attempts >= most_attempts:
            return [None, "failed", attempts, None, None], ("failed", attempts)
        return [None, "queued", attempts, None, at + RETRY_MINUTES[min(attempts, len(RETRY_MINUTES)) - 1] * 60_000], ("requeued", attempts)

    return step


def reservation_step(reserved_ms: int, started_ms: int) -> Step:
    """A reservation of tokens. The state is [when it counts as stale, status, tokens, charge]. Events are (event, tokens): reserve, start, settle
    (with the tokens used, null if unknown), release. A reservation not started in time is released at no cost; one started and
    not settled in time is charged in full. Settling again gives the same charge."""

    def step(state: State, event: tuple | None, at: int) -> tuple[State, tuple]:
        end, status, tokens, charged = state or [None, "none", 0, 0]
        if event is None:
            started = status == "request_started"
            cost = tokens if started else 0
            return [None, "settled" if started else "released", tokens, cost], ("settled_stale" if started else "released_stale", cost)
        kind, amount = event
        same = [end, status, tokens, charged]
        if kind == "reserve":
            if status != "none" or amount is None:
                return same, ("ignored", 0)
            return [at + reserved_ms, "reserved", amount, 0], ("reserved", 0)
        if kind == "start":
            if status == "reserved":
                return [at + started_ms, "request_started", tokens, 0], ("request_started", 0)
            return same, ("error" if status in ("none", "released") else "unchanged", 0)
        if kind == "settle" and status == "settled":
            return same, ("unchanged", charged)
        if kind == "settle" and status in ("reserved", "request_started"):
            cost = tokens if amount is None else min(tokens, amount)
            return [None, "settled", tokens, cost], ("settled", cost)
        if kind == "release" and status == "reserved":
            return [None, "released", tokens, 0], ("released", 0)
        return same, ("error", 0)

    return step


def timed_scan(events: DataFrame, key: str, inputs: list[str], step: Step, until_ms: int) -> DataFrame:
    """key and OUTCOMES of all events (key, at_ms, event_id, inputs) and of the deadlines up to until_ms, which is to be no
    earlier than the events. Rows of a key are read as a stream in order of at_ms and event_id; a key is one task's work, with one state."""
    rows = events.select(key, "at_ms", "event_id", *inputs)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, {OUTCOMES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, any_key, key_type = None, None, False, None
        for batch in batches:
            key_type = batch.schema.field(key).type
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (key, "at_ms", "event_id", *inputs)]
            for k, at, event_id, *event in zip(*columns, strict=True):
                if any_key and k != now:
                    out += [(now, *row) for _, row in advance(step, state, until_ms)]
                    state = None
                now, any_key = k, True
                for state, row in advance(step, state, at):  # noqa: B020
                    out.append((k, *row))
                state, (outcome, number) = step(state, tuple(event), at)
                out.append((k, at, event_id, outcome, number))
            yield _batch(out, key, key_type)
        if any_key:
            yield _batch([(now, *row) for _, row in advance(step, state, until_ms)], key, key_type)

    return rows.repartition(key).sortWithinPartitions(key, "at_ms", "event_id").mapInArrow(run, schema)


def _batch(rows: list[tuple], key: str, key_type: pa.DataType) -> pa.RecordBatch:
    types = [key_type, pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[key, "at_ms", "event_id", "outcome", "number"])
