"""Metadata indexes, their statistics, code counts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import call_count, metadata_text, metadata_typed

#: Source texts over this many bytes are left out of call counts.
MAX_SOURCE = 1 << 20


def field_of(name: str, semantics: str = "contract") -> Column:
    return (metadata_text if semantics == "literal" else metadata_typed)(F.col("metadata_json"), name)


def field_values(blocks: DataFrame, field: str, semantics: str = "contract") -> DataFrame:
    """(id, value) of blocks whose metadata has the field."""
    return blocks.select("id", field_of(field, semantics).alias("value")).where("value <> ''")


def metadata_index(blocks: DataFrame, field: str, semantics: str = "contract") -> DataFrame:
    """(value, id), clustered by value: the index as a table, so that a value that most blocks have has many rows, not one."""
    return field_values(blocks, field, semantics).select("value", "id").distinct()


def lookup_index(index: DataFrame, value: str) -> DataFrame:
    return index.where(F.col("value") == value).select("id")


def distinct_values(blocks: DataFrame, field: str, semantics: str = "contract") -> DataFrame:
    return field_values(blocks, field, semantics).select("value").distinct()


def value_counts(blocks: DataFrame, field: str, semantics: str = "contract") -> DataFrame:
    return field_values(blocks, field, semantics).groupBy("value").agg(F.count("*").alias("n"))


def index_statistics(blocks: DataFrame, field: str, semantics: str = "contract") -> DataFrame:
    """One row: unique values, entries, most of one value, selectivity (unique / entries) and whether the index pays:
    below one half, and no value with half of the entries."""
    s = value_counts(blocks, field, semantics).agg(F.count("*").alias("unique_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"), F.coalesce(F.max("n"), F.lit(0)).alias("max_per_value"))
    share = F.when(F.col("total_entries") > 0, F.col("unique_values") / F.col("total_entries")).otherwise(F.lit(0.0))
    return s.withColumn("selectivity", share).withColumn("is_selective", (F.col("selectivity") < 0.5) & (F.col("max_per_value") < F.floor(F.col("total_entries") / 2)))


def count_calls(blocks: DataFrame, names: list[str]) -> DataFrame:
    """(name, calls) over all contents of at most MAX_SOURCE bytes, in one scan."""
    small = blocks.where(F.octet_length("content") <= MAX_SOURCE)
    sums = small.agg(*(F.coalesce(F.sum(call_count(F.col("content"), n)), F.lit(0)).alias(f"n{i}") for i, n in enumerate(names)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"n{i}").alias("calls")) for i, n in enumerate(names)))).alias("x")).select("x.*")


def code_statistics(sources: DataFrame) -> DataFrame:
    """One row for source texts (data): files, free functions, methods (indented or taking self), structs."""
    line = sources.select(F.explode(F.split("data", "\n")).alias("line")).withColumn("t", F.trim("line"))
    is_fn = F.col("t").rlike(r"^(pub )?fn ")
    method = is_fn & (F.col("line").rlike(r"^(    |\t)") | F.contains("line", F.lit("self: ")))
    s = line.agg(F.count_if(is_fn & ~method).alias("functions"), F.count_if(method).alias("methods"), F.count_if(F.col("t").rlike(r"^pub const .*struct")).alias("structs"))
    return s.withColumn("files", sources.agg(F.count("*").alias("n")).scalar())


def memory_usage(blocks: DataFrame) -> DataFrame:
    """One row: bytes of all texts of all blocks."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in ("metadata_json", "content")), F.coalesce(F.octet_length("source_uri"), F.lit(0)).cast("long"))
    return blocks.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def snapshot(blocks: DataFrame) -> DataFrame:
    """(id, version, content_hash, content_length) in order of id: what golden files keep."""
    return blocks.select("id", "version", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("content_length")).orderBy("id")


def metric_columns() -> list[Column]:
    """Counters over the rows of an operation log."""
    op = F.col("op")
    size = F.octet_length("source_uri").cast("long") + F.octet_length("metadata_json") + F.octet_length("content")
    return [
        F.count_if(op == 1).alias("blocks_written"), F.count_if(op == 2).alias("blocks_deleted"), F.count_if(op == 3).alias("edges_added"), F.count_if(op == 4).alias("edges_removed"),
        F.count(F.lit(1)).alias("wal_writes"), F.coalesce(F.sum(F.when(op == 1, size)), F.lit(0)).alias("total_bytes_written"),
    ]


def metrics_of(ops: DataFrame) -> DataFrame:
    """One row of counters over an operation log."""
    return ops.agg(*metric_columns())


def filter_by_index(blocks: DataFrame, index: DataFrame, value: str, where=None, semantics: str = "contract") -> DataFrame:
    """Blocks that the index has under the value, and that a filter takes as well."""
    hits = blocks.join(lookup_index(index, value), "id", "left_semi")
    return hits if where is None else hits.where(where.column(semantics))
