"""Daily token budget: calendar days, greedy admission, settlement, stale reservations, availability."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BUDGET_OFFSET_HOURS
from .scan import ordered_scan


def usage_date(at: Column, hours: int = BUDGET_OFFSET_HOURS) -> Column:
    return F.to_date(at + F.expr(f"INTERVAL {hours} HOURS"))


def next_reset(at: Column, hours: int = BUDGET_OFFSET_HOURS) -> Column:
    return F.date_add(usage_date(at, hours), 1).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")


def strict_reservation(body: Column, most_output: int) -> Column:
    """Tokens to reserve for a request: a token for each UTF-8 byte, and the largest output."""
    return F.octet_length(body) + F.lit(most_output)


ADMITTED = "admitted boolean, used_after long"


def admission_step(limit: int):
    """Step of the fold: a request is admitted if it fits into what is left; a refused one takes nothing."""

    def step(used: int | None, row: tuple) -> tuple[int, tuple]:
        used, (tokens,) = used or 0, row
        fits = tokens is not None and used + tokens <= limit
        used += tokens if fits else 0
        return used, (fits, used)

    return step


def admit(requests: DataFrame, limit: int, *, key: str = "usage_date", order: tuple[str, str] = ("at", "reservation_id")) -> DataFrame:
    """requests with `admitted` and `used_after`: in order, a request is admitted if it fits into what is
    left of its day; a refused one takes nothing, so a smaller one may still fit later. A request without a
    number of tokens is refused. Each depends on those before, so a day is one task's stream (see scan.py):
    linear in its requests, with one number as state."""
    rows = requests.select(key, *order, "tokens")
    return ordered_scan(rows, [key], list(order), ["tokens"], ADMITTED, admission_step(limit))


def charge(reserved: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """What a settled reservation costs: what was used, at most the reservation, and all of it where usage is unknown."""
    return F.least(reserved, F.coalesce(input_tokens + output_tokens, reserved))


def day_totals(ledger: DataFrame) -> DataFrame:
    """usage_date, reserved, charged: open reservations count in full, settled ones by their charge."""
    cost = charge(F.col("tokens"), F.col("input_tokens"), F.col("output_tokens"))
    return ledger.groupBy("usage_date").agg(
        F.sum(F.when(F.col("status").isin("reserved", "request_started"), F.col("tokens")).otherwise(0)).cast("long").alias("reserved"),
        F.sum(F.when(F.col("status") == "settled", cost).otherwise(0)).cast("long").alias("charged"),
    )


def settle(ledger: DataFrame, reports: DataFrame) -> DataFrame:
    """What each report (reservation_id, reported_input, reported_output) does: outcome and charge. An open reservation is settled by charge();
    a settled one keeps its charge; a released or unknown one, or a negative report, is an error. Reports of one reservation
    are the same."""
    rows = reports.join(ledger.select("reservation_id", "status", "tokens", "input_tokens", "output_tokens"), "reservation_id", "left")
    used = F.least(F.coalesce("reported_input", F.lit(0)), F.coalesce("reported_output", F.lit(0)))
    before, now = charge(F.col("tokens"), F.col("input_tokens"), F.col("output_tokens")), charge(F.col("tokens"), F.col("reported_input"), F.col("reported_output"))
    outcome = (
        F.when(used < 0, "invalid_report").when(F.col("status").isNull(), "missing_reservation").when(F.col("status") == "released", "released_reservation")
        .when(F.col("status") == "settled", "unchanged").otherwise("settled")
    )
    cost = F.when(outcome == "settled", now).when(outcome == "unchanged", before)
    return rows.select("reservation_id", outcome.alias("outcome"), cost.cast("long").alias("charged"))


def reconcile_stale(ledger: DataFrame, reserved_before: datetime, started_before: datetime) -> DataFrame:
    """The ledger with old reservations released at no cost, and requests started long ago settled in full."""
    stale = F.col("status")
    released = (stale == "reserved") & (F.col("at") <= F.lit(reserved_before))
    settled = (stale == "request_started") & (F.col("at") <= F.lit(started_before))
    return ledger.withColumns(
        {
            "new_status": F.when(released, "released").when(settled, "settled").otherwise(stale),
            "charge": F.when(released, 0).when(settled, F.col("tokens")).cast("long"),
        }
    )


def start_requests(ledger: DataFrame) -> DataFrame:
    """What starting each reservation's request gives: a new state, none if it has begun already, an error if it was released."""
    status = F.col("status")
    return ledger.withColumn("outcome", F.when(status == "reserved", "request_started").when(status == "released", "error").otherwise("unchanged"))


def availability(totals: DataFrame, limit: int) -> DataFrame:
    left = F.greatest(F.lit(0), F.lit(limit) - F.col("reserved") - F.col("charged")).cast("long")
    return totals.select("usage_date", left.alias("remaining"), (left == 0).alias("exhausted"))
