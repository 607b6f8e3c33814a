"""Greedy admission of a day whose requests are too many for one task.

In order, a request is admitted if it fits into what is left of its day; a refused one takes nothing. Each outcome depends on
those before, but runs of outcomes don't: of the requests that are no larger than what is left, all are admitted up to the first at
which their running sum exceeds it. So a round looks at the undecided requests of all days at once: it sums them by blocks of
consecutive requests, finds each day's block in which the sum goes over, and opens these blocks only. What is left then is less than the
request that didn't fit, larger requests can't be admitted any more, and the next round goes on behind it
with the others. A day's outcome is a few segments (from, to, left): a request in a segment is admitted if it is no larger than `left`.

Sizes that end a round decrease strictly, so rounds end; with sizes spread over a range what is left shrinks by a factor in each round, and so
do the undecided requests. Sizes can be chosen so that rounds are many; after `most_rounds` the undecided rest of such
days goes through the ordered scan of budget.admit(), with the same result.

A block is a fixed number of rows, running sums are taken within blocks and over one row a block, and a day's
segments are joined back by day: no day is gathered in a task. Defined results as in budget.admit(): a request without
a number of tokens is refused; a null day is a day; days with a negative request go through the ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .scan import ordered_scan

END = (1 << 63) - 1


def _of(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Joined by day; `other` has its day as _day."""
    return df.join(other, F.col("day").eqNullSafe(F.col("_day")), how)


def _round(undecided: DataFrame, left: DataFrame) -> DataFrame:
    """_day, to, left_after of every day with undecided requests: where the round ends (END: nowhere) and what is left then.
    undecided: day, at, block, tokens, all with tokens <= left; left: _day, left."""
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = undecided.groupBy("day", "block").agg(F.sum("tokens").alias("sum")).withColumn("before", before)
    blocks = _of(blocks, left)
    over = F.col("before") + F.col("sum") > F.col("left")
    crossing = blocks.groupBy("_day", "left").agg(
        F.min_by(F.struct("block", "before"), F.when(over, F.col("block"))).alias("c"), F.sum("sum").alias("all")
    )
    crossing = stored(crossing, "crossing")
    opened = crossing.where(F.col("c").isNotNull()).select("_day", "left", F.col("c.block").alias("_block"), "c.before")
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy("day", "block").orderBy("at"))
    inside = undecided.join(opened, F.col("day").eqNullSafe(F.col("_day")) & (F.col("block") == F.col("_block"))).withColumn("sum", running)
    ends = inside.groupBy("_day", "left", "before").agg(F.min(F.when(F.col("sum") > F.col("left"), F.col("at"))).alias("to"), F.max(F.when(F.col("sum") <= F.col("left"), F.col("sum"))).alias("reached"))
    ended = ends.select("_day", "to", (F.col("left") - F.coalesce("reached", "before")).alias("left_after"))
    return ended.union(crossing.where(F.col("c").isNull()).select("_day", F.lit(END).alias("to"), (F.col("left") - F.col("all")).alias("left_after")))


def _rest_step(used: int | None, row: tuple) -> tuple[int, tuple]:
    tokens, left = row
    fits = (used or 0) + tokens <= left
    return (used or 0) + (tokens if fits else 0), (fits,)


def admit_in_rounds(requests: DataFrame, limit: int, *, key: str = "usage_date", order: tuple[str, str] = ("at", "reservation_id"), block_bits: int = 14, most_rounds: int = 24) -> DataFrame:
    """The rows and results of budget.admit(), with each day dealt over many tasks."""
    sorted_rows = requests.select(key, *order, "tokens").repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = stored(sorted_rows.select(F.struct(key, *order).alias("_row"), F.col(key).alias("day"), "tokens", F.monotonically_increasing_id().alias("at")), "requests")
    block = F.shiftright("at", block_bits).alias("block")
    negative = stored(rows.where(F.col("tokens") < 0).select(F.col("day").alias("_day")).distinct(), "negative-days")
    left = rows.select(F.col("day").alias("_day")).distinct().select("_day", F.lit(limit).cast("long").alias("left"))
    left = stored(left.join(negative.select(F.col("_day").alias("_n")), F.col("_day").eqNullSafe(F.col("_n")), "left_anti"), "left")
    undecided = _of(rows.select("day", "at", block, "tokens").where(F.col("tokens") <= limit), left.select("_day"), "left_semi")
    undecided, segments, rounds = stored(undecided, "undecided"), [], 0
    start = left.select("_day", F.lit(-1).cast("long").alias("from"), "left")
    while rounds < most_rounds and not undecided.isEmpty():
        rounds += 1
        ended = stored(_round(undecided, start.select("_day", "left")), "round")
        segments.append(start.join(ended.select(F.col("_day").alias("_d"), "to", "left_after"), F.col("_day").eqNullSafe(F.col("_d"))).select("_day", "from", "to", "left"))
        start = stored(ended.where(F.col("to") < END).select("_day", F.col("to").alias("from"), F.col("left_after").alias("left")), "start")
        # what came before the end is decided, and what is larger than what is left is refused
        undecided = stored(_of(undecided, start).where((F.col("at") > F.col("from")) & (F.col("tokens") <= F.col("left"))).select("day", "at", "block", "tokens"), "undecided")
    if not segments:
        segments = [start.select("_day", "from", F.lit(-1).cast("long").alias("to"), "left")]
    every = segments[0]
    for one in segments[1:]:
        every = every.union(one)
    by_day = every.groupBy("_day").agg(F.collect_list(F.struct("from", "to", "left")).alias("segments"))  # most_rounds at most
    # the ordered scan: the rest of days with too many rounds, and days with negative requests
    scanned = _of(rows.select("day", "at", "tokens").where(F.col("tokens").isNotNull()), negative, "left_semi").withColumn("left", F.lit(limit).cast("long"))
    if not undecided.isEmpty():
        scanned = scanned.union(_of(undecided.select("day", "at", "tokens"), start.select("_day", "left")).select("day", "at", "tokens", "left"))
    taken = ordered_scan(scanned, ["day"], ["at"], ["tokens", "left"], "fits boolean", _rest_step).where("fits").select(F.col("at").alias("_taken"))
    fits: Column = F.exists("segments", lambda s: (F.col("at") > s["from"]) & (F.col("at") < s["to"]) & (F.col("tokens") <= s["left"]))
    decided = _of(rows, by_day, "left").join(taken, F.col("at") == F.col("_taken"), "left").select(
        "_row", "day", "tokens", "at", block, (F.coalesce(fits, F.lit(False)) | F.col("_taken").isNotNull()).alias("admitted")
    )
    decided = stored(decided.withColumn("_use", F.when(F.col("admitted"), F.col("tokens")).otherwise(0)), "decided")
    used = decided.groupBy("day", "block").agg(F.sum("_use").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("day").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = used.select(F.col("day").alias("_day"), F.col("block").alias("_block"), before.alias("before"))
    inside = decided.withColumn("_sum", F.sum("_use").over(Window.partitionBy("day", "block").orderBy("at")))
    out = inside.join(used, F.col("day").eqNullSafe(F.col("_day")) & (F.col("block") == F.col("_block")))
    return out.select("_row.*", "tokens", "admitted", (F.col("before") + F.col("_sum")).alias("used_after"))
