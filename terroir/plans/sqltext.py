"""Helpers that build DuckDB SQL text for the oracles (templates, number formats, checksums)."""

from __future__ import annotations

import re

_FIELD = re.compile(r"\{(\w+)\}")


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def template(text: str, **exprs: str) -> str:
    """``"a {x} b"`` -> ``concat('a ', <x>, ' b')``."""
    parts, pos = [], 0
    for m in _FIELD.finditer(text):
        if m.start() > pos:
            parts.append(q(text[pos:m.start()]))
        parts.append(exprs[m.group(1)])
        pos = m.end()
    if pos < len(text):
        parts.append(q(text[pos:]))
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def fmt1(x: str) -> str:
    """One decimal, half-up on the printed decimal form (matches Java ``%.1f``)."""
    return f"cast(cast(round(cast(cast({x} as varchar) as decimal(38, 10)), 1) as decimal(38, 1)) as varchar)"


def cap(x: str) -> str:
    """Python ``str.capitalize``."""
    return f"concat(upper(substr({x}, 1, 1)), lower(substr({x}, 2)))"


def compact(*items: str) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def nonempty(lst: str, default: str) -> str:
    return f"CASE WHEN len({lst}) = 0 THEN [{q(default)}] ELSE {lst} END"


def ck(text: str) -> str:
    """Numeric checksum of a text: first 8 hex digits of its md5."""
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def joined(lst: str, sep: str = " | ") -> str:
    return f"array_to_string({lst}, {q(sep)})"
