"""Protection of terms in text to be translated, restoring them, and checks of the model's output.

Spans count code points. Span selection runs on Arrow batches with the term list in the task; the
checks and the restoring are Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

PLACEHOLDER = "⟦P[0-9]{4,}⟧"
PROTECTED = "struct<text:string,error:string,tokens:array<struct<placeholder:string,value:string,start:int,end:int>>>"


TOKEN_TYPE = pa.struct([("placeholder", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
PLACEHOLDER_TYPE = pa.struct([("text", pa.string()), ("error", pa.string()), ("tokens", pa.list_(TOKEN_TYPE))])


def nested_out(spans: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], str | None]:
    """Valid spans by start, without those inside another; an error for bad or partly overlapping ones."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start == end:
            continue  # a link without visible text protects nothing
        if start < 0 or end < start or end > length:
            return [], "invalid_span"
        if out and start < out[-1][1]:
            if end > out[-1][1]:
                return [], "overlapping_spans"
            continue
        out.append((start, end))
    return out, None


def same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def inside_word(text: str, start: int, end: int) -> bool:
    """Whether a place's first or last letter goes on in a word outside it."""
    return (start > 0 and _in_word(text[start - 1]) and _in_word(text[start])) or (end < len(text) and _in_word(text[end]) and _in_word(text[end - 1]))


def term_list(terms: list[str]) -> list[str]:
    """Normal forms of a glossary's terms: trimmed, lower-cased, each once, none empty."""
    return sorted({t.strip().lower() for t in terms if t.strip()})


def term_spans(text: str, terms: list[str], locked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of all places of all terms that touch neither a word's letters nor a locked span, those chosen leftmost first and
    then longest, none over another."""
    low, found = same_length_lower(text), []
    for term in terms:
        start = low.find(term)
        while start >= 0:
            end = start + len(term)
            if not inside_word(text, start, end) and not any(start < b and a < end for a, b in locked):
                found.append((start, end))
            start = low.find(term, start + 1)
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def not_translatable() -> dict:
    return {"text": None, "error": "not_translatable", "tokens": []}


def protect(text: str, spans: list[tuple[int, int]], terms: list[str]) -> dict:
    return protect_at(text, spans, lambda held: term_spans(text, terms, held))


def protect_at(text: str, spans: list[tuple[int, int]], find: Callable[[list[tuple[int, int]]], list[tuple[int, int]]]) -> dict:
    """The text with placeholders for the parser's spans and for what find(locked spans, in order) gives."""
    locked, error = nested_out(spans, len(text))
    if error:
        return {"text": None, "error": error, "tokens": []}
    marked = "⟦P" in text
    held = locked + [m.span() for m in re.finditer(PLACEHOLDER, text) if not any(m.start() < b and a < m.end() for a, b in locked)] if marked else locked
    chosen = sorted(locked + find(sorted(held)))
    out, tokens, at, number = [], [], 0, 0
    for start, end in chosen:
        number += 1
        while marked and f"⟦P{number:04d}⟧" in text:
            number += 1
        name = f"⟦P{number:04d}⟧"
        out += [text[at:start], name]
        tokens.append({"placeholder": name, "value": text[start:end], "start": start, "end": end})
        at = end
    return {"text": "".join([*out, text[at:]]), "error": None, "tokens": tokens}


def span_lists(column: pa.Array) -> list[list[tuple[int, int]]]:
    """The pairs of a column of lists of struct(start, end)."""
    flat, offsets = column.values, column.offsets.to_pylist()
    pairs = list(zip(flat.field("start").to_pylist(), flat.field("end").to_pylist(), strict=True))
    return [pairs[a:b] for a, b in pairwise(offsets)]


def protected_batch(batch: pa.RecordBatch, find: Callable[[int, str, list[tuple[int, int]]], list[tuple[int, int]]]) -> pa.RecordBatch:
    """block_id and `protected` of rows (block_id, block_type, source_text, spans); find(row, text, locked spans) gives the terms' places."""
    done = []
    for i, (kind, text, own) in enumerate(zip(batch.column("block_type").to_pylist(), batch.column("source_text").to_pylist(), span_lists(batch.column("spans")), strict=True)):
        bare = kind == "code" or text is None
        done.append(not_translatable() if bare else protect_at(text, own, lambda held, i=i, text=text: find(i, text, held)))
    tokens = [t for d in done for t in d["tokens"]]
    fields = [pa.array([t[f.name] for t in tokens], f.type) for f in TOKEN_TYPE]
    offsets = pa.array([0, *accumulate(len(d["tokens"]) for d in done)], pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, fields=list(TOKEN_TYPE)))
    out = pa.StructArray.from_arrays([pa.array([d["text"] for d in done], pa.string()), pa.array([d["error"] for d in done], pa.string()), lists], fields=list(PLACEHOLDER_TYPE))
    return pa.RecordBatch.from_arrays([batch.column("block_id"), out], names=["block_id", "protected"])


def protect_blocks(blocks: DataFrame, terms: list[str], spans_col: str | None = None) -> DataFrame:
    """blocks (block_id, block_type, source_text) with `protected`, a struct PROTECTED; code isn't translated."""
    known = term_list(terms)
    spans = F.col(spans_col) if spans_col else F.array().cast("array<struct<start:int,end:int>>")
    rows = blocks.select("block_id", "block_type", "source_text", spans.alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield protected_batch(batch, lambda _, text, held: term_spans(text, known, held))

    return rows.mapInArrow(run, f"block_id long, protected {PROTECTED}")


def restore_error(translated: Column, tokens: Column) -> Column:
    """Null, or the first of: an unknown, duplicate, missing or reordered placeholder."""
    found = F.regexp_extract_all(translated, F.lit(f"({PLACEHOLDER})"), 1)
    return bound(found, lambda f: bound(F.transform(tokens, lambda t: t["placeholder"]), lambda e: _order_error(f, e)))


def _order_error(found: Column, expected: Column) -> Column:
    as_expected = (found == expected) & (F.size(F.array_distinct(expected)) == F.size(expected))
    count = lambda p: F.size(F.filter(found, lambda x: x == p))
    wrong = F.filter(F.transform(expected, lambda p: F.when(count(p) > 1, "duplicate_placeholder").when(count(p) == 0, "missing_placeholder")), lambda x: x.isNotNull())
    first = F.get(wrong, F.lit(0))
    return F.when(as_expected, F.lit(None)).when(F.size(F.array_except(found, expected)) > 0, "unknown_placeholder").otherwise(
        F.coalesce(first, F.when(found != expected, "reordered_placeholder"))
    )


def restore(translated: Column, tokens: Column) -> Column:
    return F.aggregate(tokens, translated, lambda text, t: F.replace(text, t["placeholder"], t["value"]))


def validate_output(body: Column, tokens: Column, most_bytes: int) -> Column:
    """struct(text, error): size, strict JSON with only translatedText, not blank, then the placeholders."""
    def error(b: Column, text: Column, parsed: Column) -> Column:
        keys = F.json_object_keys(b)
        shape = F.is_variant_null(parsed).isNull() | keys.isNull() | (keys != F.array(F.lit("translatedText"))) | (F.schema_of_variant(parsed) != "OBJECT<translatedText: STRING>")
        return (
            F.when(F.octet_length(b) > most_bytes, "response_too_large").when(F.coalesce(shape, F.lit(True)), "invalid_json")
            .when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), "empty_translation").otherwise(restore_error(text, tokens))
        )

    def checked(b: Column, text: Column, parsed: Column) -> Column:
        return bound(error(b, text, parsed), lambda e: F.struct(F.when(e.isNull(), restore(text, tokens)).alias("text"), e.alias("error")))

    return bound(body, lambda b: bound(F.get_json_object(b, "$.translatedText"), lambda text: bound(F.try_parse_json(b), lambda parsed: checked(b, text, parsed))))


def render_prompt(template: str, heading: Column, before: Column, text: Column, after: Column) -> Column:
    """The template with its mark replaced by four tagged lines of JSON."""
    if "{{sourceText}}" not in template:
        raise ValueError("the template lacks {{sourceText}}")
    line = lambda tag, c: F.concat(F.lit(f"{tag}: "), F.coalesce(F.to_json(F.struct(c.alias("value"))), F.lit("null")))
    block = F.concat_ws("\n", line("heading", heading), line("before", before), line("text", text), line("after", after))
    return F.replace(F.lit(template), F.lit("{{sourceText}}"), block)
