"""Column functions over texts; all of them compile to JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as numbers: decimal with optional fraction and exponent, infinities, not-a-number.
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"

#: File endings and their content types, first match wins.
CONTENT_TYPES = [
    (".zig", "text/zig"), (".md", "text/markdown"), (".txt", "text/plain"), (".json", "application/json"), (".toml", "application/toml"), (".yaml", "application/yaml"), (".yml", "application/yaml"),
    (".c", "text/c"), (".h", "text/c"), (".cpp", "text/cpp"), (".hpp", "text/cpp"), (".rs", "text/rust"), (".py", "text/python"), (".js", "text/javascript"), (".ts", "text/typescript"),
]


def quoted(text: str) -> str:
    """text as a pattern that matches just it, in Java's and in RE2's grammar."""
    return re.sub(r"([^A-Za-z0-9_\x80-\U0010ffff])", r"\\\1", text)


def number(text: Column) -> Column:
    """The number that a text stands for; null if it isn't one."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def compare(a: Column, b: Column) -> Column:
    """Sign of a against b: by number if both texts are numbers (not-a-number equals every number), by bytes otherwise."""
    x, y = number(a), number(b)
    by_number = F.when(F.isnan(x) | F.isnan(y), 0).when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(x.isNotNull() & y.isNotNull(), by_number).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))


def metadata_text(metadata: Column, field: str) -> Column:
    """The field's text by position: after `"field":`, blanks and quotes, up to the next quote or comma; else empty.

    Works on broken JSON too, finds nested fields, and cuts texts at commas.
    """
    return F.coalesce(F.regexp_extract(metadata, f'"{quoted(field)}":[ "]*([^",]*)', 1), F.lit(""))


def metadata_typed(metadata: Column, field: str) -> Column:
    """The top-level field of a JSON object as text; empty where it is missing, null or the JSON is broken."""
    path = f"$['{field}']" if "'" not in field else f'$["{field}"]'
    return F.coalesce(F.try_variant_get(F.try_parse_json(metadata), path, "string"), F.lit(""))


def keyword_score(content: Column, query: str) -> Column:
    """Share of the query's words (parted by single blanks; an empty word is in every text) that content holds; float."""
    if not query:
        return F.lit(0.0).cast("float")
    words = query.split(" ")
    hits = sum((F.contains(content, F.lit(w)).cast("int") for w in words[1:]), F.contains(content, F.lit(words[0])).cast("int"))
    return F.when(content.isNull() | (content == ""), F.lit(0.0)).otherwise(hits / F.lit(float(len(words)))).cast("float")


def call_count(text: Column, name: str) -> Column:
    """How often `name(` stands in text without a letter, digit or underscore before it; definitions count too."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_]){quoted(name)}\(")), F.lit(0)).cast("long")


def content_type(path: Column) -> Column:
    out = F.when(F.endswith(path, F.lit(CONTENT_TYPES[0][0])), CONTENT_TYPES[0][1])
    for end, kind in CONTENT_TYPES[1:]:
        out = out.when(F.endswith(path, F.lit(end)), kind)
    return out.otherwise("text/plain")
