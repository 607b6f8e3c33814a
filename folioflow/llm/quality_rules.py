"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, measure, comparison, threshold). Measures are Column expressions over
the text; `quality_rules` puts all of them and the verdict into a single select, so Spark reads
the text once, shuffles nothing and runs no user function.

Defined results: a null or blank text has zero for every count and fails the base rule on length.
Repeated rows give repeated results. Columns of the input other than the id and text are ignored,
so their names can't clash with the results. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, ascii_lower

SYMBOLS = "#*$%&|<>"
#: Fixed word list: frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were with "
    "auf auch das dem den der des die ein eine einen er es für im ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
    "al como con del el ella en es esta la las lo los más no para pero por que se su una y"
).split()


class Rule(NamedTuple):
    name: str
    measure: str
    keep_if: str  # "<=" or ">="
    threshold: float


#: All ratios are by word unless the name says otherwise. A document is kept if every rule holds.
RULES = (
    Rule("symbols", "symbol_ratio", "<=", 0.1),
    Rule("exclamations", "exclamation_ratio", "<=", 0.5),
    Rule("capitals", "capital_ratio", "<=", 0.3),
    Rule("mean_word_low", "mean_word_chars", ">=", 2.0),
    Rule("mean_word_high", "mean_word_chars", "<=", 25.0),
    Rule("stop_words", "stop_ratio", ">=", 0.02),
    Rule("repeated_lines", "dup_line_ratio", "<=", 0.5),
    Rule("bullet_lines", "bullet_line_ratio", "<=", 0.9),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: a lambda variable isn't computed again wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the same array.

    The windows are first compared as hashes. Where all differ, so do the windows and nothing is sorted;
    otherwise they are compared as strings: (window, position) pairs are sorted, neighbours compared, and the covered words
    counted from the gaps between the repeated windows' positions: n log n, whatever repeats.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        at = _let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, k: F.get(p, k - 1)["w"].eqNullSafe(x["w"]) | F.get(p, k + 1)["w"].eqNullSafe(x["w"])),
                    lambda x: x["i"],
                )
            ),
        )
        return _let(
            at,
            lambda a: F.aggregate(
                F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(
            F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 3, F.lit(0).cast("long")).otherwise(
            F.when(_let(hashes, lambda x: F.size(F.array_distinct(x)) == F.size(x)), F.lit(0).cast("long")).otherwise(_let(windows, covered))
        )

    return _let(words, of)


def _count(text: Column, chars: str) -> Column:
    """Number of characters of a regex class, given without brackets."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The counts that the rules and the report use."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": words,
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": _count(text, SYMBOLS),
        "n_capitals": _count(text, "A-Z"),
        "n_exclamations": _count(text, "!"),
        "lines": lines,
    }


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
    stop_words: tuple[str, ...] | list[str] = STOP_WORDS, min_words: int = 50, most_repeated_percent: int = 50,
) -> DataFrame:
    """One row per document: the id, the base counts, every measure of the rules, the names of the
    rules that failed, `base_failed` and `kept`."""
    base = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in measures(F.col(text_col)).items()])
    n = F.size("words").cast("long")
    per_word = lambda c: c / F.greatest(n, F.lit(1))
    n_lines = F.greatest(F.size("lines"), F.lit(1))
    counted = base.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        per_word(F.col("n_symbols")).alias("symbol_ratio"),
        per_word(F.col("n_exclamations")).alias("exclamation_ratio"),
        (F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_ratio"),
        per_word(F.col("word_chars")).alias("mean_word_chars"),
        per_word(F.size(F.filter("words", lambda w: (F.length(w) <= max(map(len, stop_words))) & ascii_lower(w).isin(list(stop_words))))).alias("stop_ratio"),
        ((F.size("lines") - F.size(F.array_distinct("lines"))) / n_lines).alias("dup_line_ratio"),
        (F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•|]"))) / n_lines).alias("bullet_line_ratio"),
    )
    failed = F.array_compact(
        F.array(
            *[
                F.when(~(F.col(r.measure) <= r.threshold if r.keep_if == "<=" else F.col(r.measure) >= r.threshold), F.lit(r.name))
                for r in rules
            ]
        )
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated_percent * F.col("n_words"))
    return counted.select("*", failed.alias("failed_rules"), base_failed.alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
