"""Keyword search: the share of a query's words that a block holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_score
from ..model import InvalidQuery

MAX_RESULTS, DEFAULT_RESULTS, DEFAULT_THRESHOLD = 500, 100, 0.7


def validate(query: str, max_results: int, threshold: float) -> None:
    if not query:
        raise InvalidQuery("EmptyQuery")
    if not 1 <= max_results <= MAX_RESULTS:
        raise InvalidQuery("ResultsLimitExceeded", str(max_results))
    if not 0 <= threshold <= 1:
        raise InvalidQuery("InvalidThreshold", str(threshold))


def scores(blocks: DataFrame, query: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """All blocks with a score of at least the threshold (compared as floats)."""
    return blocks.withColumn("score", keyword_score(F.col("content"), query)).where(F.col("score") >= F.lit(threshold).cast("float"))


def keyword_search(blocks: DataFrame, query: str, max_results: int = DEFAULT_RESULTS, threshold: float = DEFAULT_THRESHOLD, semantics: str = "contract") -> DataFrame:
    """The best blocks by score, ties by id; `"literal"` takes the first hits in order of id and sorts those."""
    validate(query, max_results, threshold)
    hits = scores(blocks, query, threshold)
    if semantics == "literal":
        hits = hits.orderBy("id").limit(max_results)
    return hits.orderBy(F.col("score").desc(), "id").limit(max_results)


def total_matches(blocks: DataFrame, query: str, threshold: float = DEFAULT_THRESHOLD) -> int:
    return scores(blocks, query, threshold).count()
