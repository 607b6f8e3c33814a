"""The job queue as data: merging requests, what would be claimed, retries, and schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import ordered_scan

RETRY_MINUTES = (1, 5, 30)


def merge_requests(requests: DataFrame) -> DataFrame:
    """One queued job for each dedupe key: the highest priority and the earliest time asked for, and
    whether a later request promoted it."""
    first = F.min_by(F.struct("priority", "run_at"), F.struct("requested_at", "job_id"))
    merged = requests.groupBy("dedupe_key").agg(
        F.min_by("job_id", F.struct("requested_at", "job_id")).alias("job_id"), F.max("priority").alias("priority"), F.min("run_at").alias("run_at"), F.count("*").alias("requests"), first.alias("_first")
    )
    promoted = (F.col("priority") > F.col("_first.priority")) | (F.col("run_at") < F.col("_first.run_at"))
    return merged.withColumn("promoted", promoted).drop("_first")


def claimable(jobs: DataFrame, now: datetime) -> DataFrame:
    """Jobs that a worker may take at `now`, by queue in the order of taking (`place` from 1)."""
    at = F.lit(now)
    due = ((F.col("status") == "queued") & (F.col("run_at") <= at)) | ((F.col("status") == "running") & (F.col("lease_until") <= at))
    w = Window.partitionBy("queue").orderBy(F.col("priority").desc(), "run_at", "job_id")
    return jobs.where((F.col("attempts") < F.col("max_attempts")) & due).withColumn("place", F.row_number().over(w))


def next_jobs(jobs: DataFrame, now: datetime, most: int = 10) -> DataFrame:
    """The first `most` claimable jobs of each queue. Spark keeps only that many rows of a queue before
    the shuffle (a window group limit), so a long queue isn't gathered."""
    return claimable(jobs, now).where(F.col("place") <= most)


def exhausted_leases(jobs: DataFrame, now: datetime) -> DataFrame:
    """Running jobs whose lease ended after their last attempt; they fail."""
    return jobs.where((F.col("status") == "running") & (F.col("lease_until") <= F.lit(now)) & (F.col("attempts") >= F.col("max_attempts"))).withColumn("error", F.lit("lease_exhausted"))


def retry_delay_minutes(attempt: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in RETRY_MINUTES]), F.least(F.greatest(attempt, F.lit(1)), F.lit(3)).cast("int"))


def after_failure(jobs: DataFrame, now: datetime) -> DataFrame:
    """State after a failed run: queued again later, or failed after the last attempt."""
    last = F.col("attempts") >= F.col("max_attempts")
    later = F.lit(now) + F.make_dt_interval(mins=retry_delay_minutes(F.col("attempts")))
    return jobs.withColumns({"new_status": F.when(last, "failed").otherwise("queued"), "new_run_at": F.when(~last, later)})


def deferred(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("attempts", F.greatest(F.col("attempts") - 1, F.lit(0)))


def refresh_offset(page_id: Column) -> Column:
    """Second of the day at which a page is refreshed: spread evenly by the hash of its id."""
    head = F.conv(F.substring(F.sha2(page_id.cast("string"), 256), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(86400))


def daily_refreshes(pages: DataFrame, day: str) -> DataFrame:
    """A refresh job for each active page within the UTC day."""
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    offset = refresh_offset(F.col("page_id"))
    return pages.where(F.col("status") == "active").select(
        "page_id", F.concat(F.lit("refresh:"), F.col("page_id").cast("string"), F.lit(f":{day}")).alias("dedupe_key"), (start + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))).alias("run_at"),
        F.lit(10).alias("priority"),
    )


def maintenance(days: DataFrame) -> DataFrame:
    """type, dedupe_key of the jobs that each `day` has once: a discovery and a cleanup."""
    kinds = F.explode(F.array(F.lit("discover"), F.lit("cleanup"))).alias("type")
    return days.select("day").distinct().select("day", kinds).select("type", F.concat_ws(":", "type", F.col("day").cast("string")).alias("dedupe_key"))


def discovery_jobs(discovered: DataFrame) -> DataFrame:
    """A fetch job for each discovered page; those with a date of change come first."""
    return discovered.select("canonical_url", F.concat(F.lit("fetch:"), "canonical_url").alias("dedupe_key"), F.when(F.col("last_modified").isNotNull(), 20).otherwise(10).alias("priority"))


def page_requests(pages: DataFrame, now: datetime, high: bool, fresh_hours: int = 24) -> DataFrame:
    """Pages to fetch on request: not those with a version that were checked in the last day."""
    fresh = (F.col("checked_at") > F.lit(now) - F.expr(f"INTERVAL {fresh_hours} HOURS")) & F.col("current_version").isNotNull()
    return pages.where(~F.coalesce(fresh, F.lit(False))).select("page_id", F.lit(100 if high else 10).alias("priority"))


def reader_requests(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Translation jobs for what a reader sees untranslated: pending or failed blocks, at high priority."""
    rows = blocks.where("translatable").join(translations.select("block_id", "status"), "block_id", "left")
    some = rows.where(F.coalesce("status", F.lit("pending")).isin("pending", "failed"))
    return some.select("block_id", F.concat_ws(":", F.lit("translate"), F.col("block_id").cast("string"), "fingerprint").alias("dedupe_key"), F.lit(100).alias("priority"))


def retranslations(blocks: DataFrame, running: DataFrame, prompt: int, glossary: int) -> DataFrame:
    """dedupe_key and action of retranslating blocks: enqueued, or deduplicated where a job is open."""
    key = F.concat_ws(":", F.lit("retranslate"), F.col("block_id").cast("string"), F.lit(str(prompt)), F.lit(str(glossary)))
    rows = blocks.select("block_id", key.alias("dedupe_key"))
    open_ = running.select("dedupe_key").distinct().withColumn("_open", F.lit(True))
    return rows.join(open_, "dedupe_key", "left").select("block_id", "dedupe_key", F.when(F.col("_open"), "deduplicated").otherwise("enqueued").alias("action"))


def spaced_starts(requests: DataFrame, interval_ms: int, span_ms: int = 3_600_000) -> DataFrame:
    """Start of each request of a host when starts keep `interval_ms` apart:
    start_i = max(arrival_i, start_(i-1) + interval), which is a running maximum of arrival - i * interval.

    It is taken in two levels, so that a host's requests are dealt over many tasks: within each `span_ms` of
    a host's arrivals, and over one row for each of those spans."""
    keys = ["host", "_span"]
    w = Window.partitionBy(*keys).orderBy("arrival_ms", "request_id")
    inside = requests.withColumn("_span", F.floor(F.col("arrival_ms") / span_ms)).withColumn("_i", F.row_number().over(w) - 1)
    inside = inside.withColumn("_most", F.max(F.col("arrival_ms") - F.col("_i") * interval_ms).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = requests.withColumn("_span", F.floor(F.col("arrival_ms") / span_ms)).withColumn("_i", F.row_number().over(w) - 1).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max(F.col("arrival_ms") - F.col("_i") * interval_ms).alias("_high")
    )
    before = Window.partitionBy("host").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counted = spans.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    reached = counted.withColumn("_before", F.max(F.col("_high") - F.col("_offset") * interval_ms).over(before)).select(
        F.col("host").alias("_host"), F.col("_span").alias("_at"), "_offset", "_before"
    )
    joined = inside.join(reached, F.col("host").eqNullSafe(F.col("_host")) & F.col("_span").eqNullSafe(F.col("_at")))
    start = F.greatest(F.col("_before"), F.col("_most") - F.col("_offset") * interval_ms) + (F.col("_offset") + F.col("_i")) * interval_ms
    return joined.withColumn("start_ms", start).select(*requests.columns, "start_ms")


ALLOWED = "allowed boolean"


def login_step(most_failures: int, minutes: int):
    """Step of the fold: the state is when the window began and the failures in it."""
    span = minutes * 60_000_000

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
        at, ok = row
        anchor, failures = state if state and at < state[0] + span else (None, 0)
        if failures >= most_failures:
            return (anchor, failures), (False,)
        if ok:
            return None, (True,)
        return (at if anchor is None else anchor, failures + 1), (True,)

    return step


def login_allowed(attempts: DataFrame, most_failures: int = 5, minutes: int = 15) -> DataFrame:
    """user_id, at_us, attempt_id, ok, allowed: a window is anchored at the first failure after a success or
    after the last window's end; within it, attempts after `most_failures` failures are refused. An attempt
    without an outcome is a failure."""
    rows = attempts.select("user_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "attempt_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    return ordered_scan(rows, ["user_id"], ["at_us", "attempt_id"], ["at_us", "ok"], ALLOWED, login_step(most_failures, minutes))


ENQUEUED = "action string, job_number int"


def enqueue_step(state: list | None, row: tuple) -> tuple[list, tuple]:
    """Step of the fold over a dedupe key's events; the state is the number, status, priority and time of its
    last job. A request makes a job unless one is open; it may promote a queued one, not a running one."""
    number, status, priority, run_at = state or (0, "none", 0, 0)
    event, wanted, at = row
    if event == "enqueue":
        if status not in ("queued", "running"):
            number, status, priority, run_at, action = number + 1, "queued", wanted, at, "created"
        elif status == "queued" and (wanted > priority or at < run_at):
            priority, run_at, action = max(priority, wanted), min(run_at, at), "promoted"
        else:
            action = "deduplicated"
    elif event == "claim":
        action = "claimed" if status == "queued" else "ignored"
        status = "running" if status == "queued" else status
    elif event == "requeue":
        action = "requeued" if status == "running" else "ignored"
        status, run_at = ("queued", at) if status == "running" else (status, run_at)
    else:
        action = "finished" if status == "running" else "ignored"
        status = "finished" if status == "running" else status
    return [number, status, priority, run_at], (action, number)


def enqueue(events: DataFrame) -> DataFrame:
    """Queue events (dedupe_key, at_us, event_id, event, priority, run_at_us) with action and job_number.
    event: enqueue, claim, requeue (a retry or deferral) or finish (success or last failure)."""
    return ordered_scan(events, ["dedupe_key"], ["at_us", "event_id"], ["event", "priority", "run_at_us"], ENQUEUED, enqueue_step)


def renew_leases(jobs: DataFrame, owners: DataFrame, now: datetime, seconds: int = 120) -> DataFrame:
    """job_id, renewed, new_lease_until of owners' calls (job_id, owner): only the owner of a running job whose lease hasn't ended
    renews it."""
    rows = owners.select("job_id", F.col("owner").alias("_caller")).join(jobs.select("job_id", "status", "owner", "lease_until"), "job_id", "left")
    own = F.coalesce((F.col("status") == "running") & (F.col("owner") == F.col("_caller")) & (F.col("lease_until") > F.lit(now)), F.lit(False))
    return rows.select("job_id", own.alias("renewed"), F.when(own, F.lit(now) + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))).cast("timestamp_ntz").alias("new_lease_until"))
