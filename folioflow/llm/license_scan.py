"""License scan with ordered signature rules, in DataFrame functions only.

Text is normalised to lower-case alphanumeric words joined by single spaces. A cheap gate lets only
texts with some rule's keyword pass; in those, each rule whose keyword occurs is matched. The ends of
its matches are marked in the text, so that the marked words' numbers are the word intervals. Intervals
are ordered (start ascending, longest first, then rule priority), and every detection that lies within
another one is suppressed, however many there are: only those that begin at most the longest interval
earlier can hold it, so time stays in proportion to the text and its matches. Nothing is shuffled, so a
hot key or group costs nothing extra.

Defined results: a null or blank text has no words and no detections; score is 0. Repeated rows
give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM
from .license_rules import Signature, signatures

#: Phrases that are reported at every place, whatever the rules say about it.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Characters that no normalised text holds.
_START, _END = "\x01", "\x02"
SPAN = "struct<start:bigint,last:bigint,priority:int,label:string,rule:string,weight:double>"


def normalised(text: Column) -> Column:
    """Words joined by single spaces, without a space at the ends; A-Z are lower-cased. lower() does the same
    and is faster than translate(): other letters are word characters in either case, and the only two that
    it would turn into ASCII letters are replaced before."""
    safe = F.coalesce(text, F.lit(""))
    for c in ("\u212a", "\u0130"):
        safe = F.replace(safe, F.lit(c), F.lit("\u00aa"))
    return F.trim(F.regexp_replace(F.lower(safe), NON_ALNUM, " "))


def any_of(words: list[str]) -> str:
    """Regex of some words with their common beginnings folded, so that most are ruled out at one letter."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    inside = "|".join(re.escape(c) + any_of(rest) for c, rest in heads.items())
    return f"(?:{inside}){'?' if '' in words else ''}" if inside else ""


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once: a lambda variable isn't computed again wherever it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(padded: Column, rule: Column) -> Column:
    """Word intervals of a rule's matches, in one pass over the text's words."""
    marked = F.split(F.regexp_replace(padded, rule["pattern"], F.lit(f"{_START}$0{_END}")), " ")
    ends = F.filter(
        F.transform(marked, lambda w, i: F.struct((i - 1).cast("long").alias("at"), F.startswith(w, F.lit(_START)).alias("first"), F.endswith(w, F.lit(_END)).alias("last"))),
        lambda x: x["first"] | x["last"],
    )
    spans = _let(
        ends,
        lambda e: F.zip_with(
            F.filter(e, lambda x: x["first"]), F.filter(e, lambda x: x["last"]),
            lambda a, b: F.struct(
                a["at"].alias("start"), b["at"].alias("last"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["rule"].alias("rule"),
                rule["weight"].alias("weight"),
            ).cast(SPAN),
        ),
    )
    return F.when(F.rlike(padded, rule["pattern"]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _not_contained(spans: Column) -> Column:
    """Spans that lie in no other, each start's longest (of least priority number) before the rest."""
    ordered = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["last"]).alias("before"), s["priority"].alias("priority"), s.alias("span")))
    )
    firsts = _let(ordered, lambda o: F.transform(F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["start"] < x["start"])), lambda x: x["span"]))
    longest = lambda f: F.array_max(F.transform(f, lambda x: x["last"] - x["start"])).cast("int") + 1

    def outer(f: Column) -> Column:
        return _let(
            longest(f),
            lambda m: F.filter(
                f, lambda x, i: ~F.exists(F.slice(f, F.greatest(i - m, F.lit(0)) + 1, F.least(i, m)), lambda y: y["last"] >= x["last"])
            ),
        )

    return _let(firsts, outer)


def _rule_table(rules: list[Signature]) -> Column:
    """The rules by keyword as one array (a constant, parsed when the plan is optimised)."""
    by: dict[str, list[dict]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append({"rule": r.rule, "label": r.label, "pattern": r.pattern, "priority": r.priority, "weight": r.weight})
    table = [{"keyword": f" {k} ", "rules": some} for k, some in by.items()]
    return F.from_json(F.lit(json.dumps(table)), "array<struct<keyword:string,rules:array<struct<rule:string,label:string,pattern:string,priority:int,weight:double>>>>")


def license_scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Signature, ...] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """doc_id, n_words, `places` (every place of a base phrase) and `detections` (the rules' spans
    that no other span contains), both arrays of SPAN with word numbers from 0, last included."""
    rules = signatures() if rules is None else rules
    phrases = BASE_PHRASES if phrases is None else phrases
    base = [Signature(f"base-{i}", label, p.split()[0], f"(?<= ){p}(?= )", i, 1.0) for i, (p, label) in enumerate(phrases.items())]
    keywords = sorted({r.keyword for r in (*rules, *base)})
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).select(
        "doc_id",
        F.when(F.col("norm") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("norm")) + 1).alias("n_words"),
        F.concat(F.lit(" "), "norm", F.lit(" ")).alias("padded"),
    )
    gate = F.col("padded").rlike(f" {any_of(keywords)} ")
    none = F.array().cast(f"array<{SPAN}>")

    def matches(some: list[Signature]) -> Column:
        tried = F.filter(_rule_table(some), lambda k: F.contains(F.col("padded"), k["keyword"]))
        return F.flatten(F.transform(F.flatten(F.transform(tried, lambda k: k["rules"])), lambda r: _spans(F.col("padded"), r)))

    return (
        norm.withColumn("gated", gate)
        .select(
            "doc_id", "n_words",
            F.when(F.col("gated"), matches(base)).otherwise(none).alias("places"),
            F.when(F.col("gated"), matches(list(rules))).otherwise(none).alias("found"),
        )
        .select("doc_id", "n_words", "places", F.when(F.size("found") == 0, none).otherwise(_not_contained(F.col("found"))).alias("detections"))
    )
