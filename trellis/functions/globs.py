"""Glob patterns as regular expressions, for `rlike` on executors and for Python's `re` alike.

`*` stays within a folder, `**` crosses folders (`**/` may also be nothing), `?` is any one character, `[a-z]` and
`[!a-z]` or `[^a-z]` are sets; a `[` that isn't closed stands for itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import quoted

_TOKEN = re.compile(r"(?P<deep>\*\*/?)|(?P<star>\*)|(?P<one>\?)|\[(?P<no>[!^]?)(?P<set>[^\]]+)\]|(?P<plain>.)", re.S)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of the glob."""
    def piece(m: re.Match) -> str:
        if m["deep"]:
            return "(?:.*/)?" if m["deep"].endswith("/") else ".*"
        if m["star"]:
            return "[^/]*"
        if m["one"]:
            return "."
        if m["set"]:
            ranges = re.sub(r"([^A-Za-z0-9-])", r"\\\1", m["set"])
            return f"[{'^' if m['no'] else ''}{ranges}]"
        return quoted(m["plain"])

    return rf"(?s)\A{''.join(piece(m) for m in _TOKEN.finditer(pattern))}\z"


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches_glob(path, p)
    return out


def glob_match(pattern: str, path: str) -> bool:
    """The same on the driver."""
    return re.match(glob_regex(pattern).replace(r"\z", r"\Z"), path) is not None
