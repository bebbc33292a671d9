"""Boolean filters over blocks, compiled once to a Column, with pages and totals.

`semantics="contract"` reads metadata as JSON; `"literal"` extracts a field's text by position (see `metadata_text`).
All compared texts are non-null, so conditions are two-valued.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUMBER, compare, metadata_text, metadata_typed
from ..model import InvalidQuery

MAX_RESULTS, DEFAULT_RESULTS = 10_000, 1000


class Target(IntEnum):
    CONTENT = 1
    SOURCE_URI = 2
    METADATA_FIELD = 3
    VERSION = 4
    CONTENT_LENGTH = 5


class Operator(IntEnum):
    EQUAL = 1
    NOT_EQUAL = 2
    GREATER = 3
    GREATER_EQUAL = 4
    LESS = 5
    LESS_EQUAL = 6
    CONTAINS = 7
    STARTS_WITH = 8
    ENDS_WITH = 9


def decode(kind: type[IntEnum], code: int) -> IntEnum:
    try:
        return kind(code)
    except ValueError:
        raise InvalidQuery("InvalidFilter", f"{kind.__name__} {code}") from None


class Expression:
    """A node of a filter; `&`, `|` and `~` combine them."""

    def column(self, semantics: str = "contract") -> Column:
        raise NotImplementedError

    def __and__(self, other: Expression | None) -> Expression:
        return self if other is None else _Both(self, other, True)

    def __or__(self, other: Expression | None) -> Expression:
        return self if other is None else _Both(self, other, False)

    def __invert__(self) -> Expression:
        return _Not(self)


@dataclass(frozen=True)
class _Both(Expression):
    left: Expression
    right: Expression
    all: bool

    def column(self, semantics: str = "contract") -> Column:
        a, b = self.left.column(semantics), self.right.column(semantics)
        return a & b if self.all else a | b


@dataclass(frozen=True)
class _Not(Expression):
    inner: Expression

    def column(self, semantics: str = "contract") -> Column:
        return ~self.inner.column(semantics)


@dataclass(frozen=True)
class Condition(Expression):
    target: Target
    operator: Operator
    value: str
    field: str | None = None

    def text(self, semantics: str) -> Column:
        """The compared text; null columns count as empty."""
        if self.target == Target.METADATA_FIELD:
            if not self.field:
                raise InvalidQuery("InvalidFilter", "a metadata condition needs a field")
            return (metadata_text if semantics == "literal" else metadata_typed)(F.col("metadata_json"), self.field)
        if self.target == Target.VERSION:
            return F.coalesce(F.col("version").cast("string"), F.lit(""))
        if self.target == Target.CONTENT_LENGTH:
            return F.coalesce(F.octet_length("content"), F.lit(0)).cast("string")
        return F.coalesce(F.col("content" if self.target == Target.CONTENT else "source_uri"), F.lit(""))

    def column(self, semantics: str = "contract") -> Column:
        """The condition as two-valued expression; in a shape that Parquet scans take over where the stored text is compared as such."""
        text, op = self.text(semantics), self.operator
        stored = {Target.CONTENT: F.col("content"), Target.SOURCE_URI: F.col("source_uri")}.get(self.target)
        if op >= Operator.CONTAINS:
            if not self.value:
                return F.lit(True)
            part = {Operator.CONTAINS: F.contains, Operator.STARTS_WITH: F.startswith, Operator.ENDS_WITH: F.endswith}[op]
            return part(text, F.lit(self.value)) if stored is None else stored.isNotNull() & part(stored, F.lit(self.value))
        plain = not re.match(NUMBER, self.value)  # then only texts are compared
        if plain and stored is not None and self.value and op <= Operator.NOT_EQUAL:
            same = stored.eqNullSafe(self.value)
            return same if op == Operator.EQUAL else ~same
        a, b = (text, F.lit(self.value)) if plain else (compare(text, F.lit(self.value)), F.lit(0))
        return {Operator.EQUAL: a == b, Operator.NOT_EQUAL: a != b, Operator.GREATER: a > b, Operator.GREATER_EQUAL: a >= b, Operator.LESS: a < b, Operator.LESS_EQUAL: a <= b}[op]


def content(op: Operator, value: str) -> Condition:
    return Condition(Target.CONTENT, op, value)


def source_uri(op: Operator, value: str) -> Condition:
    return Condition(Target.SOURCE_URI, op, value)


def metadata(field: str, op: Operator, value: str) -> Condition:
    return Condition(Target.METADATA_FIELD, op, value, field)


def version(op: Operator, value: int | str) -> Condition:
    return Condition(Target.VERSION, op, str(value))


def content_length(op: Operator, value: int | str) -> Condition:
    return Condition(Target.CONTENT_LENGTH, op, str(value))


@dataclass(frozen=True)
class FilterStats:
    scanned: int
    matched: int
    returned: int
    finished: bool


@dataclass(frozen=True)
class FilteredResult:
    """A page of matches in order of id; totals are counted when they are asked for."""

    blocks: DataFrame
    matches: DataFrame
    source: DataFrame
    where: Column
    offset: int
    max_results: int

    @property
    def total_matches(self) -> int:
        return self.matches.count()

    @property
    def has_more(self) -> bool:
        """Whether matches follow this page: one row past it is looked for, not all of them."""
        return not self.matches.select("id").orderBy("id").offset(self.offset + self.max_results).limit(1).isEmpty()

    def stats(self) -> FilterStats:
        """From one pass over the blocks."""
        n = self.source.agg(F.count("*").alias("all"), F.count_if(self.where).alias("matched")).first()
        returned = min(max(n.matched - self.offset, 0), self.max_results)
        return FilterStats(n["all"], n.matched, returned, n.matched <= self.offset + returned)

    def __iter__(self):
        return self.blocks.toLocalIterator(prefetchPartitions=False)


def matching(blocks: DataFrame, where: Expression, semantics: str = "contract") -> DataFrame:
    return blocks.where(where.column(semantics))


def filter_blocks(blocks: DataFrame, where: Expression, max_results: int = DEFAULT_RESULTS, offset: int = 0, semantics: str = "contract") -> FilteredResult:
    if max_results == 0:
        raise InvalidQuery("EmptyQuery")
    if not 0 < max_results <= MAX_RESULTS:
        raise InvalidQuery("ResultsLimitExceeded", str(max_results))
    if offset < 0:
        raise InvalidQuery("InvalidOffset", str(offset))
    found = matching(blocks, where, semantics)
    page = found.orderBy("id").offset(offset).limit(max_results)
    return FilteredResult(page, found, blocks, where.column(semantics), offset, max_results)


def contains_text(blocks: DataFrame, text: str, **kw) -> FilteredResult:
    return filter_blocks(blocks, content(Operator.CONTAINS, text), **kw)


def with_source_uri(blocks: DataFrame, uri: str, **kw) -> FilteredResult:
    return filter_blocks(blocks, source_uri(Operator.EQUAL, uri), **kw)


def with_metadata(blocks: DataFrame, field: str, value: str, **kw) -> FilteredResult:
    return filter_blocks(blocks, metadata(field, Operator.EQUAL, value), **kw)


def totals(blocks: DataFrame, where: Expression, offset: int, max_results: int, semantics: str = "contract") -> DataFrame:
    """One row (total_matches, returned, has_more) by counting alone."""
    n = F.count("*")
    returned = F.least(F.greatest(n - offset, F.lit(0)), F.lit(max_results))
    return matching(blocks, where, semantics).agg(n.alias("total_matches"), returned.cast("long").alias("returned"), (n > offset + returned).alias("has_more"))
