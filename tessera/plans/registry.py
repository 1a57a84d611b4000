"""Planned queries by normalised text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

_PARTS = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(--[^\n]*|/\*.*?\*/)|([^'\"`]+?(?=--|/\*|'|\"|`|$))", re.S)

_KEYWORD = re.compile(
    r"\b(select|from|where|group|by|order|having|limit|offset|distinct|all|as|and|or|not|in|is|null|like|ilike|between|exists|case|when|then|else|end|join|inner|left|right|full|outer|cross|semi|anti|natural|using|on"
    r"|union|intersect|except|with|recursive|over|partition|rows|range|asc|desc|nulls|first|last|values|true|false|cast)\b",
    re.IGNORECASE,
)


def key(text: str) -> str:
    """MD5 of the text with white space folded, comments dropped and keywords in lower case; names keep their case, which results show."""
    out = []
    for quoted, comment, plain in _PARTS.findall(text):
        part = quoted or (" " if comment else _KEYWORD.sub(lambda m: m[0].lower(), re.sub(r"\s+", " ", plain)))
        part = part.lstrip(" ") if out and out[-1].endswith(" ") and not quoted else part
        if part:
            out.append(part)
    return hashlib.md5(re.sub(r" +(?=[,)])|(?<=[(,]) +", "", "".join(out)).strip().rstrip("; ").encode()).hexdigest()


class Registry:
    """Keeps what a text planned to, and counts hits and misses."""

    def __init__(self):
        self.kept: dict[str, object] = {}
        self.hits = self.misses = 0

    def get(self, text: str, make: Callable[[], object], over: dict[str, object] | None = None):
        """What ``text`` planned to ``over`` the same tables, else what ``make`` gives."""
        name, over = key(text), dict(over or {})
        seen = self.kept.get(name)
        if seen and seen[0].keys() == over.keys() and all(seen[0][t] is over[t] for t in over):
            self.hits += 1
        else:
            self.kept[name] = (over, make())
            self.misses += 1
        return self.kept[name][1]

    def clear(self) -> None:
        self.kept.clear()
