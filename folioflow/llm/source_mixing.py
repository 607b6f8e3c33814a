"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. The document rates w_i nearest to the base rates q_i in
relative entropy (by word) that meet the token constraints are exponentially tilted,
w_i = min(cap, q_i * exp(lambda_s)); lambda_s solves the convex dual by Newton's method. The dual
needs only the words of a source at each base rate, so documents are aggregated once and every
source's Newton iteration is a fold over its own short row: sources are solved in parallel, none
on the driver.

Rates become copies by rounding down and adding one copy where a hash of the document, scaled by
its fraction, is under the source's threshold. The threshold comes from three histograms of 256 bins
for each source, so the words taken miss the target by about half a document at most, however
large the source. Base rates have three decimals, so a source has a bounded number of cells.

Defined results: null text has size 0; a null source is a source of its own, last in order; repeated
rows are drawn alike; sources without words have target 0. Reruns give the same copies, as only the
rows' values enter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, by_place, stored

BINS, DIGITS = 256, 3
KEYS = BINS**DIGITS
LAW_COLUMNS = ("_size", "_base_rate", "_draw")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")).cast("long")


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base_rate: Column | None = None) -> DataFrame:
    """The documents with _size (words), _base_rate (to 3 decimals) and _draw (a hash in [0, 1))."""
    rate = F.lit(1.0) if base_rate is None else F.round(F.greatest(base_rate, F.lit(0.001)), 3)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 40)) / float(1 << 40)
    return docs.withColumns({"_size": n_words(F.col(text_col)), "_base_rate": rate, "_draw": draw})


def language_rate(lang: Column, first: str = "en", others: float = 1.25) -> Column:
    """Base rate of a document by language: those in the first one and in none count 1, others more."""
    return F.when(F.coalesce(lang != first, F.lit(False)), F.lit(others)).otherwise(F.lit(1.0))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with _place, from 0 by code point, null last: sorted by range, so no task has all sources; the
    driver sees a number of rows for each partition."""
    order = F.col("source").asc_nulls_last()
    placed = stored(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    offset, begin = 0, []
    for r in sorted(placed.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).agg(F.count("*").alias("n")).collect()):
        begin.append((r["p"], offset))
        offset += r["n"]
    starts = F.broadcast(sources.sparkSession.createDataFrame(begin, "_p int, _offset long"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, F.shiftright("_at", 33).cast("int") == F.col("_p")).withColumn("_place", F.col("_offset") + inside).drop("_at", "_p", "_offset")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, cells and target: weights repeat over the sources by code point; targets sum to
    `share` of all words and stop at `cap` times their source, the excess going to the others by weight.

    Words by weight rise to a common level, except in sources that are full. Each round sums over all sources
    what the full ones take, which sets the level for the rest; sources only ever become full, and a few
    rounds do."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_place"), F.lit(len(weights))))
    rows = ranked(sizes).withColumns({"_w": weight, "_full": cap * F.col("source_size")})
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full_before = 0.0, -1
    while True:
        over = F.lit(level) * F.col("_w") > F.col("_full")
        spent, left, full = rows.agg(
            F.coalesce(F.sum(F.when(over, F.col("_full"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)), F.count_if(over)
        ).first()
        if full == full_before or not left:
            break
        level, full_before = (total - spent) / left, full
    reached = F.col("_full") if not left else F.least(F.col("_full"), F.col("_w") * level)
    return rows.select("source", "source_size", "cells", reached.alias("target"))


def tilt(cells: Column, target: Column, cap: float, steps: int = 60) -> Column:
    """lambda of a source: Newton steps on the dual. cells: array of (rate, words). The state holds the
    bounds between which the root is known to lie; a step that leaves them is halved to their middle."""

    def total(value: Callable[[Column], Column]) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda t, c: t + c["words"] * value(c["rate"]))

    def step(s: Column, _: Column) -> Column:
        tilted = lambda r: r * F.exp(s["at"])
        here = F.struct(
            s["at"].alias("at"), s["low"].alias("low"), s["high"].alias("high"), total(lambda r: F.least(F.lit(cap), tilted(r))).alias("mass"),
            total(lambda r: F.when(tilted(r) < cap, tilted(r)).otherwise(0.0)).alias("slope"),
        )

        def moved(h: Column) -> Column:
            low, high = F.when(h["mass"] < target, h["at"]).otherwise(h["low"]), F.when(h["mass"] < target, h["high"]).otherwise(h["at"])
            newton = h["at"] - F.try_divide(h["mass"] - target, h["slope"])
            inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
            at = F.when(h["mass"] == target, h["at"]).when(inside, newton).otherwise((low + high) / 2)
            return F.struct(at.alias("at"), low.alias("low"), high.alias("high"))

        return F.element_at(F.transform(F.array(here), moved), 1)

    words = F.aggregate(cells, F.lit(0.0), lambda t, c: t + c["words"])
    first = F.struct(F.lit(0.0).alias("at"), F.lit(-40.0).alias("low"), F.lit(40.0).alias("high"))
    return F.when(words <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda s: s["at"]))


def _rate(cap: float) -> Column:
    return F.least(F.lit(cap), F.col("_base_rate") * F.exp(F.col("_lambda")))


def _key(cap: float) -> Column:
    """Order in which documents of a source get their extra copy: 0 to KEYS - 1; null if there is none to get."""
    part = _rate(cap) - F.floor(_rate(cap))
    return F.when(part > 0, F.least(F.floor(F.col("_draw") / part * (KEYS / 4)), F.lit(KEYS - 1)).cast("long"))


def plan(sizes: DataFrame, source_col: str, *, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """A row for each source: source, source_size, target, _lambda and _threshold of the rounding, found digit
    by digit: a histogram of BINS bins for each source, then one of the bin in which its words are reached."""
    cells = sizes.groupBy(F.col(source_col).alias("source"), "_base_rate").agg(F.sum("_size").cast("double").alias("words"))
    by_source = cells.groupBy("source").agg(
        F.sum("words").cast("long").alias("source_size"), F.collect_list(F.struct(F.col("_base_rate").alias("rate"), "words")).alias("cells")
    )
    solved = stored(
        targets(by_source, weights, share, cap).withColumn("_lambda", tilt(F.col("cells"), F.col("target"), cap)).drop("cells"), "mix-tilt"
    )
    drawn = _joined(sizes.select(F.col(source_col).alias("_source"), *LAW_COLUMNS), solved, "_source").withColumn("_k", _key(cap))
    whole = drawn.groupBy("source").agg(F.sum(F.floor(_rate(cap)) * F.col("_size")).alias("whole"))
    state = stored(
        solved.select(F.col("source").alias("_s"), "target").join(whole, F.col("_s").eqNullSafe(F.col("source")))
        .select("source", (F.col("target") - F.col("whole")).alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("round_up")), "mix-digit",
    )
    for digit in range(DIGITS):
        below = BINS ** (DIGITS - 1 - digit)
        inside = drawn.join(
            state.select(F.col("source").alias("_of"), "prefix"),
            F.col("source").eqNullSafe(F.col("_of")) & F.col("_k").isNotNull() & (F.expr(f"_k div {below * BINS}") == F.col("prefix")),
        )
        bins = inside.groupBy("source", F.pmod(F.expr(f"_k div {below}"), F.lit(BINS)).alias("bin")).agg(F.sum("_size").cast("double").alias("words"))
        by_bin = bins.groupBy(F.col("source").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("bin", "words"))).alias("bins"))
        reached = state.join(by_bin, F.col("source").eqNullSafe(F.col("_of")), "left").withColumn("at", _crossing(F.col("bins"), F.col("need")))
        state = stored(
            reached.select(
                "source", F.when(F.col("at.found"), F.col("need") - F.col("at.before")).otherwise(F.col("need")).alias("need"),
                F.when(F.col("at.found"), F.col("prefix") * BINS + F.col("at.bin")).alias("prefix"),
                (F.col("at.found") & (2 * (F.col("need") - F.col("at.before")) >= F.col("at.words"))).alias("round_up"),
            ),
            "mix-digit",
        )
    # where the words of all keys are too few, every document with a fraction gets its copy
    threshold = F.when(F.col("prefix").isNotNull(), F.col("prefix") + F.col("round_up").cast("long")).when(F.col("need") > 0, F.lit(KEYS)).otherwise(F.lit(0))
    found = state.select(F.col("source").alias("_of"), threshold.cast("long").alias("_threshold"))
    return stored(solved.join(found, F.col("source").eqNullSafe(F.col("_of"))).drop("_of"), "mix-plan")


def _crossing(bins: Column, need: Column) -> Column:
    """struct(found, bin, words, before) of the bin in which the words by bin reach what is needed."""
    first = F.struct(F.lit(False).alias("found"), F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("words"), F.lit(0.0).alias("before"))

    def step(s: Column, x: Column) -> Column:
        here = (s["before"] <= need) & (need < s["before"] + x["words"])
        return F.when(s["found"], s).otherwise(
            F.struct(here.alias("found"), x["bin"].alias("bin"), x["words"].alias("words"), F.when(here, s["before"]).otherwise(s["before"] + x["words"]).alias("before"))
        )

    return F.coalesce(F.aggregate(bins, first, step), first)


def _joined(docs: DataFrame, sources: DataFrame, source_col: str) -> DataFrame:
    return docs.join(sources, F.col(source_col).eqNullSafe(F.col("source")))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, cap: float = 2.0, base_rate: Column | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (0 to cap) of every document. With
    `carry`, those columns unchanged, and _copies."""
    with_size = sized(docs, id_col=id_col, text_col=text_col, base_rate=base_rate)
    slim = stored(with_size.select(F.col(id_col).alias("_doc_id"), F.col(source_col).alias("_source"), *LAW_COLUMNS), "mix-sizes")
    sources = plan(slim, "_source", weights=weights, share=share, cap=cap)
    rows = slim
    if carry:
        rows = with_size.select(*[F.col(c).alias(f"_carry_{c}") for c in carry], F.col(id_col).alias("_doc_id"), F.col(source_col).alias("_source"), *LAW_COLUMNS)
    extra = F.coalesce((_key(cap) < F.col("_threshold")).cast("long"), F.lit(0))
    results = [
        F.col("_doc_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target",
        _rate(cap).alias("rate"), (F.floor(_rate(cap)) + extra).cast("long").alias("copies"),
    ]
    joined = _joined(rows, sources, "_source")
    return joined.select(*[F.col(f"_carry_{c}").alias(c) for c in carry], *([results[-1].alias("_copies")] if carry else results))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", base_rate: Column | None = None, **options) -> DataFrame:
    """The documents, repeated by their copies; same columns."""
    with_rate = docs if base_rate is None else docs.select("*", base_rate)
    held, name = by_place(with_rate)
    own = held.columns[: len(docs.columns)]
    rate = None if base_rate is None else F.col(held.columns[-1])
    out = mix(held, id_col=name[id_col], text_col=name[text_col], source_col=name[source_col], base_rate=rate, carry=tuple(own), **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    return out.where(F.col("_copies") > 0).withColumn("_copy", times).select(*own).toDF(*docs.columns)
