"""The streaming folds give what the batch folds give, over several micro-batches."""

from pyspark.sql import functions as F

from folioflow.operators import budget, jobs
from folioflow.streaming import stateful


def through(spark, tmp_path, df, parts, make, name):
    """Rows of a stream that reads df in `parts` files, one a micro-batch."""
    folder = tmp_path / "in"
    for k in range(parts):
        df.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(df.drop("_part").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_budget_stream(spark, tmp_path):
    rows = spark.range(60).selectExpr("concat('d', id % 2) as usage_date", "timestamp_seconds(id) as at", "id as reservation_id", "1 + id * 7 % 23 as tokens", "cast(id div 20 as int) as _part")
    found = through(spark, tmp_path, rows, 3, lambda s: stateful.admit_stream(s, 100), "budget_rows")
    wanted = budget.admit(rows, 100).collect()
    assert {(r.reservation_id, r.admitted, r.used_after) for r in found} == {(r.reservation_id, r.admitted, r.used_after) for r in wanted}


def test_login_and_queue_streams(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 3 as user_id", "id * 50000000 as at_us", "id as attempt_id", "id % 11 = 0 as ok", "cast(id div 20 as int) as _part")
    found = through(spark, tmp_path / "a", rows, 2, lambda s: stateful.login_stream(s, 2, 5), "login_rows")
    wanted = jobs.login_allowed(rows.withColumn("at", F.timestamp_micros("at_us")), 2, 5).collect()
    assert {(r.attempt_id, r.allowed) for r in found} == {(r.attempt_id, r.allowed) for r in wanted}
    events = spark.range(40).selectExpr("concat('k', id % 2) as dedupe_key", "id as at_us", "id as event_id", "element_at(array('enqueue','enqueue','claim','finish'), cast(id div 2 % 4 + 1 as int)) as event",
                                        "cast(id % 7 as int) as priority", "100 - id as run_at_us", "cast(id div 20 as int) as _part")
    found = through(spark, tmp_path / "b", events, 2, stateful.enqueue_stream, "queue_rows")
    wanted = jobs.enqueue(events).collect()
    assert {(r.event_id, r.action, r.job_number) for r in found} == {(r.event_id, r.action, r.job_number) for r in wanted}
