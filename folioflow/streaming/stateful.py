"""Budget admission, queue requests and login windows over a stream: the same steps as in batch, with the state
of each key kept by Structured Streaming between micro-batches.

Rows of a key are taken in order within a micro-batch; a row that comes in a later micro-batch follows those
before, whatever its time, as a live service would treat it. The state of a key that sees nothing for
`idle` is dropped (a day's budget, a finished job); pass None to keep it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.budget import ADMITTED, admission_step
from ..operators.jobs import ALLOWED, ENQUEUED, enqueue_step, login_step
from ..operators.scan import Step


def stream_scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: str, step: Step, idle_ms: int | None = None) -> DataFrame:
    """Like operators.scan.ordered_scan, over a stream, in append mode."""
    more = StructType.fromDDL(outputs)
    schema = StructType([*df.schema.fields, *more.fields])

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state: Any = json.loads(held.get[0]) if held.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        found = []
        for row in rows[inputs].astype(object).where(rows[inputs].notna(), None).itertuples(index=False, name=None):
            state, out = step(state, row)
            found.append(out)
        held.update((json.dumps(state, default=str),))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)
        for i, name in enumerate(more.names):
            rows[name] = [x[i] for x in found]
        yield rows[schema.names]

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", timeout)


def admit_stream(requests: DataFrame, limit: int, idle_ms: int | None = 2 * 86_400_000) -> DataFrame:
    """requests (usage_date, at, reservation_id, tokens) with admitted and used_after."""
    return stream_scan(requests, ["usage_date"], ["at", "reservation_id"], ["tokens"], ADMITTED, admission_step(limit), idle_ms)


def login_stream(attempts: DataFrame, most_failures: int = 5, minutes: int = 15, idle_ms: int | None = 86_400_000) -> DataFrame:
    """attempts (user_id, at_us, attempt_id, ok) with allowed."""
    return stream_scan(attempts, ["user_id"], ["at_us", "attempt_id"], ["at_us", "ok"], ALLOWED, login_step(most_failures, minutes), idle_ms)


def enqueue_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Queue events (dedupe_key, at_us, event_id, event, priority, run_at_us) with action and job_number."""
    return stream_scan(events, ["dedupe_key"], ["at_us", "event_id"], ["event", "priority", "run_at_us"], ENQUEUED, enqueue_step, idle_ms)
