"""Canonical JSON of a block's payload: keys in order, strings in their normal form, no white space."""

from __future__ import annotations

import json
import re
from typing import Any

_ENDS = r"[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def line_ends(text: str) -> str:
    return re.sub(r"\r\n?", "\n", text)


def prose(text: str) -> str:
    one = re.sub(r" *\n+ *", " ", re.sub(r"[ \t]+", " ", line_ends(text)))
    return re.sub(rf"\A{_ENDS}+|{_ENDS}+\Z", "", one)


def canonical(value: Any, fold: bool) -> Any:
    """The value with all its strings in normal form (prose, or line ends only) and keys in order."""
    if isinstance(value, str):
        return prose(value) if fold else line_ends(value)
    if isinstance(value, (list, tuple)):
        return [canonical(x, fold) for x in value]
    if isinstance(value, dict):
        return {k: canonical(value[k], fold) for k in sorted(value)}
    return value


def canonical_json(value: Any, fold: bool = True) -> str:
    return json.dumps(canonical(value, fold), ensure_ascii=False, separators=(",", ":"))
