"""Text normal forms, search patterns and fingerprints as Column expressions.

Prose folds spaces, tabs and line ends. Lengths count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space cut at the ends: what counts as such in Unicode, and the byte order mark.
ENDS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"
#: What makes inline code a file's path, and what an identifier.
FILE_END = r"(?i)\.(?:toml|json|yaml|yml|tsx|ts|jsx|js|liquid|graphql|md)$"
IDENTIFIER = r"^[A-Z][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_line_endings(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"\r\n?", "\n")


def bound(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for a row however often `use` names it."""
    return F.get(F.transform(F.array(_c(value)), use), F.lit(0))


def normalize_prose(text: Column | str) -> Column:
    """One space for each run of spaces, tabs and line ends; white space of any kind cut at the ends. Patterns run only
    over texts that hold what they replace."""
    holds = lambda t, *marks: F.greatest(*[F.contains(t, F.lit(m)) for m in marks]) if len(marks) > 1 else F.contains(t, F.lit(marks[0]))
    replaced = lambda t, marks, pattern, by: F.when(holds(t, *marks), F.regexp_replace(t, pattern, by)).otherwise(t)
    cut = lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(2))).rlike(ENDS), F.regexp_replace(t, f"^{ENDS}+|{ENDS}+$", "")).otherwise(t)
    spaces = lambda t: bound(replaced(t, ("\t", "  "), "[ \\t]+", " "), lines)
    lines = lambda t: bound(replaced(t, ("\n",), " *\\n+ *", " "), cut)
    return bound(text, lambda t: bound(replaced(t, ("\r",), r"\r\n?", "\n"), spaces))


def normalize_multiline(text: Column | str) -> Column:
    """Line endings made \\n, white space cut at the ends of the whole."""
    return F.regexp_replace(normalize_line_endings(text), f"^{ENDS}+|{ENDS}+$", "")


def normalize_query(query: str) -> str:
    return re.sub(r"[\s﻿]+", " ", query).strip()


def search_terms(query: str) -> list[str]:
    return [t for t in normalize_query(query).split(" ") if t]


def like_pattern(query: str) -> str:
    return f"%{re.sub(r'([%_' + chr(92) * 2 + '])', chr(92) * 2 + r'\1', normalize_query(query))}%"


def looks_like_identifier(query: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_$][\w.$:-]*", query, re.ASCII)) and bool(re.search(r"[A-Z_.$:-]", query))


def contains_folded(value: Column | str, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(_c(value)), F.lit(query.lower())), F.lit(False))


def candidate_limit(limit: float) -> int:
    return 0 if limit <= 0 else min(1000, max(50, int(limit) * 25))


def json_text(value: Column | str) -> Column:
    """A string as JSON."""
    return bound(F.to_json(F.struct(_c(value).alias("v"))), lambda whole: F.substring(whole, F.lit(6), F.length(whole) - 6))


def block_fingerprint(block_type: Column | str, text: Column | str, payload: Column | str) -> Column:
    """SHA-256 of the block's canonical JSON: type, text, payload (canonical JSON already, see canonical.py) and
    whether it is translated. Prose is folded, code only gets its line endings made equal. Place and heading
    path don't count."""
    kind = _c(block_type)
    value = F.when(kind == "code", normalize_line_endings(text)).otherwise(normalize_prose(text))
    return F.sha2(
        F.concat(
            F.lit('{"type":'), json_text(kind), F.lit(',"sourceText":'), json_text(value), F.lit(',"payload":'), _c(payload),
            F.lit(',"translatable":'), F.when(kind == "code", "false").otherwise("true"), F.lit("}"),
        ),
        256,
    )


def config_hash(*parts: Column | str) -> Column:
    """SHA-256 of the JSON array of some strings, such as a prompt's template and model, or a request's body."""
    return F.sha2(F.to_json(F.array(*[_c(p).cast("string") for p in parts])), 256)


def glossary_hash(term: Column | str) -> Column:
    """Aggregate: SHA-256 of a glossary's normal terms, each once, in order."""
    return F.sha2(F.to_json(F.array_sort(F.collect_set(F.lower(F.trim(_c(term)))))), 256)


def page_fingerprint(ordinal: Column | str, block_type: Column | str, fingerprint: Column | str) -> Column:
    """Aggregate: SHA-256 of the ordered types and fingerprints of a page's blocks."""
    items = F.array_sort(F.collect_list(F.struct(_c(ordinal).alias("ordinal"), _c(block_type).alias("type"), _c(fingerprint).alias("contentFingerprint"))))
    return F.sha2(F.to_json(F.transform(items, lambda x: F.struct(x["type"].alias("type"), x["contentFingerprint"].alias("contentFingerprint")))), 256)


def classify_inline_code(value: Column | str) -> Column:
    v = _c(value)
    return (
        F.when(v.rlike(r"\s"), "inline_code").when(v.rlike(r"[\\/]") | v.rlike(FILE_END), "file_path")
        .when(v.rlike(IDENTIFIER), "identifier").otherwise("inline_code")
    )


def recognizable_text(body: Column | str) -> Column:
    """A heading line, two paragraphs or 80 characters."""
    b = _c(body)
    paragraphs = F.size(F.filter(F.split(b, r"\n\s*\n"), lambda p: F.trim(p) != ""))
    return b.rlike(r"(?m)^#{1,6}\s+\S") | (paragraphs >= 2) | (F.length(F.trim(b)) >= 80)


def table_rows(text: Column | str) -> Column:
    """Rows of cells of a table kept as tab-separated text."""
    return F.transform(F.split(_c(text), "\n"), lambda r: F.split(r, "\t"))


def cut_message(text: Column | str, most: int = 2000) -> Column:
    return F.left(_c(text), F.lit(most))
