"""Operations overview: queue counts, failures, sessions, glossary history, alerts, and the documented reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUS_ORDER = ("failed", "running", "queued", "succeeded")


def status_rank(column: str = "status"):
    return F.coalesce(*[F.when(F.col(column) == s, F.lit(i)) for i, s in enumerate(STATUS_ORDER)], F.lit(len(STATUS_ORDER)))


def by_queue_status(jobs: DataFrame) -> DataFrame:
    """Jobs by queue and status, in order of queue and urgency."""
    counts = jobs.groupBy("queue", "status").agg(F.count("*").alias("jobs"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy("queue", status_rank(), "status")))


def recent_failures(jobs: DataFrame, limit: int = 5) -> DataFrame:
    return jobs.where(F.col("status") == "failed").orderBy(F.col("run_at").desc(), F.col("job_id").desc()).limit(limit).select("job_id", "queue", "type", "run_at")


def recent_jobs(jobs: DataFrame, statuses: list[str], limit: int = 20, chars: int = 200) -> DataFrame:
    """Latest jobs in some states, with the start of their message."""
    some = jobs.where(F.col("status").isin(statuses)).orderBy(F.col("run_at").desc(), F.col("job_id").desc()).limit(limit)
    return some.select("job_id", "queue", "type", "status", "attempts", F.left("message", F.lit(chars)).alias("message"), "run_at")


def active_sessions(sessions: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    return sessions.join(users.select("user_id"), "user_id").where(F.col("expires_at") > F.lit(now)).agg(F.count("*").alias("active_sessions"))


def expired_sessions(sessions: DataFrame, now: datetime) -> DataFrame:
    """What stays after expired sessions are deleted."""
    return sessions.where(F.col("expires_at") > F.lit(now))


def sessions_after(sessions: DataFrame, deletes: DataFrame) -> DataFrame:
    """What stays after `deletes` (kind, session_id, user_id): `session` deletes one session, `user` all of a user, `others` all of a user but that
    session. Each kind is an anti-join."""
    one = deletes.where("kind = 'session'").select("session_id")
    users = deletes.where("kind = 'user'").select("user_id")
    others = deletes.where("kind = 'others'").select(F.col("user_id").alias("_user"), F.col("session_id").alias("_kept"))
    left = sessions.join(one, "session_id", "left_anti").join(users, "user_id", "left_anti")
    return left.join(others, (F.col("user_id") == F.col("_user")) & (F.col("session_id") != F.col("_kept")), "left_anti")


def glossary_history(versions: DataFrame, terms: DataFrame, limit: int = 10) -> DataFrame:
    """Newest versions with their number of terms (0 where there are none)."""
    counts = versions.join(terms.select("version", "term_id"), "version", "left").groupBy("version", "active").agg(F.count("term_id").alias("terms"))
    return counts.orderBy(F.col("version").desc()).limit(limit)


def alerts(providers: DataFrame, prompts: DataFrame, glossaries: DataFrame, jobs: DataFrame, writable: bool = True) -> DataFrame:
    """place, alert: what needs attention, in a fixed order. Built from one-row aggregates."""
    one = (
        providers.agg(F.coalesce(F.bool_or("enabled"), F.lit(False)).alias("provider"))
        .crossJoin(prompts.agg(F.coalesce(F.bool_or("active"), F.lit(False)).alias("prompt")))
        .crossJoin(glossaries.agg(F.coalesce(F.bool_or("active"), F.lit(False)).alias("glossary")))
        .crossJoin(jobs.agg(F.count_if(F.col("status") == "failed").alias("failed")))
    )
    raised = F.array_compact(
        F.array(
            F.when(~F.col("provider"), "no_enabled_provider"), F.when(~F.col("prompt"), "no_active_prompt"), F.when(~F.col("glossary"), "no_active_glossary"),
            F.when(F.col("failed") > 0, F.concat(F.lit("failed_jobs:"), F.col("failed").cast("string"))), F.when(F.lit(not writable), "database_not_writable"),
        )
    )
    return one.select(F.posexplode(raised).alias("place", "alert"))


def fetch_log_after_expiry(log: DataFrame, now: datetime) -> DataFrame:
    """Stored bodies that aren't past their time."""
    return log.where(F.col("expires_at") > F.lit(now))
