"""Leases and reservations: the batch fold against a plain model, and the stream with timers against the batch fold."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators.timed import lease_step, reservation_step, timed_scan
from folioflow.streaming import timers

UNTIL = 10_000_000
JOBS = "job_id long, at_ms long, event_id long, event string, owner string, _part int"
TOKENS = "reservation_id long, at_ms long, event_id long, event string, tokens long, _part int"


def job_events(n=500, seed=2):
    rng = random.Random(seed)
    return [(rng.randrange(12), rng.randrange(0, 900_000, 10_000), i, rng.choice(["claim", "claim", "renew", "renew", "complete", "fail"]), rng.choice(["a", "a", "b", None]), rng.randrange(3)) for i in range(n)]


def token_events(n=400, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(60), rng.randrange(0, 600_000, 10_000), i, rng.choice(["reserve", "reserve", "start", "settle", "release"]), rng.choice([None, 5, 50, 500]), rng.randrange(3)) for i in range(n)]


def slow_leases(events, lease_ms, most):
    """Straight from the rules, a second model: time goes on in steps of 10 seconds."""
    out = []
    for job in {e[0] for e in events}:
        own = sorted((e for e in events if e[0] == job), key=lambda e: e[1:3])
        status, attempts, owner, ends, from_ = "queued", 0, None, None, 0
        for now in range(0, UNTIL + 1, 10_000):
            if status == "running" and ends <= now:
                status = "failed" if attempts >= most else "queued"
                out.append((job, ends, None, "lease_exhausted" if status == "failed" else "lease_ended", attempts))
            while own and own[0][1] == now:
                _, _, i, kind, caller, _ = own.pop(0)
                if kind == "claim":
                    word = "claimed" if status == "queued" and from_ <= now else "refused"
                    if word == "claimed":
                        status, attempts, owner, ends = "running", attempts + 1, caller, now + lease_ms
                elif status != "running" or caller is None or caller != owner:
                    word = "lease_lost"
                elif kind == "renew":
                    word, ends = "renewed", now + lease_ms
                elif kind == "complete":
                    word, status = "completed", "succeeded"
                elif attempts >= most:
                    word, status = "failed", "failed"
                else:
                    word, status, from_ = "requeued", "queued", now + [1, 5, 30][attempts - 1] * 60_000
                out.append((job, now, i, word, attempts))
    return set(out)


@pytest.mark.parametrize("lease_ms", [30_000, 120_000])
def test_leases_in_batch(spark, lease_ms):
    events = job_events()
    found = timed_scan(spark.createDataFrame(events, JOBS).repartition(3), "job_id", ["event", "owner"], lease_step(lease_ms), UNTIL).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == slow_leases(events, lease_ms, 3)
    assert lease_ms < 100_000 or {r.outcome for r in found} >= {"lease_ended", "lease_exhausted", "renewed", "completed", "requeued"}


def test_reservations_in_batch(spark):
    rows = [(1, 0, 0, "reserve", 30, 0), (1, 50, 1, "start", None, 0), (1, 60, 2, "settle", 12, 0), (2, 0, 3, "reserve", 30, 0), (2, 200, 4, "start", None, 0), (3, 0, 5, "reserve", 30, 0), (3, 90, 6, "start", None, 0),
            (4, 5, 7, "settle", 1, 0), (5, 0, 8, "reserve", 9, 0), (5, 1, 9, "reserve", 9, 0), (5, 2, 10, "release", None, 0), (6, 0, 11, "reserve", 9, 0), (6, 1, 12, "start", None, 0), (6, 2, 13, "settle", None, 0), (6, 3, 14, "settle", 1, 0), (7, 0, 15, "reserve", 9, 0), (7, 1, 16, "settle", 4, 0), (7, 2, 17, "release", None, 0)]
    found = timed_scan(spark.createDataFrame(rows, TOKENS), "reservation_id", ["event", "tokens"], reservation_step(100, 300), 1000).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r[0], r[1], r[2] or -1)):
        by.setdefault(r[0], []).append((r["at_ms"], r["outcome"], r["number"]))
    assert by == {
        1: [(0, "reserved", 0), (50, "request_started", 0), (60, "settled", 12)], 2: [(0, "reserved", 0), (100, "released_stale", 0), (200, "error", 0)],
        3: [(0, "reserved", 0), (90, "request_started", 0), (390, "settled_stale", 30)], 4: [(5, "error", 0)], 5: [(0, "reserved", 0), (1, "ignored", 0), (2, "released", 0)],
        6: [(0, "reserved", 0), (1, "request_started", 0), (2, "settled", 9), (3, "unchanged", 9)], 7: [(0, "reserved", 0), (1, "settled", 4), (2, "error", 0)],
    }


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, timers.ROCKS_DB)
    yield
    spark.conf.set(name, before)


DAY = 86_400_000  # a stream's watermark begins at 0, so its events come later than that


def later(spark, events, schema):
    return spark.createDataFrame([(e[0], e[1] + DAY, *e[2:]) for e in events], schema)


def through(spark, tmp_path, df, make, name):
    folder = tmp_path / "in"
    for k in range(4):
        df.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    return spark.table(name).collect()


def test_lease_stream_with_shuffled_batches(spark, tmp_path, rocks):
    events = later(spark, [*job_events(), (-1, UNTIL + 3_600_000, 10_000, "claim", "z", 3)], JOBS)  # the last one moves the watermark on
    found = through(spark, tmp_path, events, lambda s: timers.lease_stream(s, 120_000, delay="1 hour"), "lease_rows")
    wanted = timed_scan(events.where("job_id >= 0"), "job_id", ["event", "owner"], lease_step(120_000), UNTIL + DAY).collect()
    assert {tuple(r) for r in found if r["job_id"] >= 0} == {tuple(r) for r in wanted} and len(found) == len(wanted)


def test_reservation_stream_with_shuffled_batches(spark, tmp_path, rocks):
    events = later(spark, [*token_events(), (-1, UNTIL + 3_600_000, 10_000, "reserve", 1, 3)], TOKENS)
    found = through(spark, tmp_path, events, lambda s: timers.reservation_stream(s, 100_000, 300_000, delay="1 hour"), "reservation_rows")
    wanted = timed_scan(events.where("reservation_id >= 0"), "reservation_id", ["event", "tokens"], reservation_step(100_000, 300_000), UNTIL + DAY).collect()
    assert {tuple(r) for r in found if r["reservation_id"] >= 0} == {tuple(r) for r in wanted} and len(found) == len(wanted)
    assert {r["outcome"] for r in wanted} >= {"settled_stale", "released_stale", "settled", "released"}
