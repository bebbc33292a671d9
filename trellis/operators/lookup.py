"""Lookups of blocks and edges by id, existence, counts and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Direction, InvalidQuery, parse_id

MAX_IDS = 1000


def requested(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ord, id) of the wanted ids; at most MAX_IDS, so that this side can always be broadcast."""
    if not ids:
        raise InvalidQuery("EmptyQuery")
    if len(ids) > MAX_IDS:
        raise InvalidQuery("TooManyIds", str(len(ids)))
    rows = [(i, parse_id(x)) for i, x in enumerate(ids)]
    return blocks.sparkSession.createDataFrame(rows, T.StructType([T.StructField("ord", T.LongType()), T.StructField("id", T.StringType())]))


def find_block(blocks: DataFrame, id_: str) -> DataFrame:
    return blocks.where(F.col("id") == parse_id(id_))


def find_blocks(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Blocks in the order asked for (column ord); ids asked for twice come twice, missing ones not at all.

    The scan gets the ids as a filter, which Parquet's statistics and bloom filters can use.
    """
    want = requested(blocks, ids)
    hits = blocks.where(F.col("id").isin(sorted({parse_id(x) for x in ids})))
    return hits.join(F.broadcast(want), "id").select("ord", *(F.col(c) for c in blocks.columns)).orderBy("ord")


def block_exists(blocks: DataFrame, id_: str) -> bool:
    """False for malformed ids too."""
    try:
        return not find_block(blocks, id_).isEmpty()
    except InvalidQuery:
        return False


def existing(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ord, id, exists) for each id asked for."""
    found = blocks.where(F.col("id").isin(sorted({parse_id(x) for x in ids}))).select("id", F.lit(True).alias("found")).distinct()
    return requested(blocks, ids).join(found, "id", "left").select("ord", "id", F.coalesce("found", F.lit(False)).alias("exists"))


def count_existing(blocks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row n: how many of the ids exist, repeats counted."""
    return existing(blocks, ids).agg(F.count_if(F.col("exists")).alias("n"))


def block_version(blocks: DataFrame, id_: str) -> DataFrame:
    return find_block(blocks, id_).select("id", "version")


def all_blocks(blocks: DataFrame) -> DataFrame:
    """In order of id."""
    return blocks.orderBy("id")


def edges_of(edges: DataFrame, id_: str, direction: Direction = Direction.OUTGOING) -> DataFrame:
    """Edges at a block; by direction (outgoing first), then in order of insertion."""
    id_ = parse_id(id_)
    out = edges.where(F.col("source_id") == id_).withColumn("dir", F.lit(0))
    into = edges.where(F.col("target_id") == id_).withColumn("dir", F.lit(1))
    found = out if direction == Direction.OUTGOING else into if direction == Direction.INCOMING else out.unionByName(into)
    return found.orderBy("dir", "edge_seq")


def outgoing(edges: DataFrame, id_: str) -> DataFrame:
    return edges_of(edges, id_, Direction.OUTGOING).drop("dir")


def incoming(edges: DataFrame, id_: str) -> DataFrame:
    return edges_of(edges, id_, Direction.INCOMING).drop("dir")


def graph_counts(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: blocks, edges, and blocks that have outgoing and incoming edges."""
    e = edges.agg(F.count("*").alias("edge_count"), F.countDistinct("source_id").alias("source_block_count"), F.countDistinct("target_id").alias("target_block_count"))
    return blocks.agg(F.count("*").alias("block_count")).select("block_count", e.select("edge_count").scalar().alias("edge_count"), e.select("source_block_count").scalar().alias("source_block_count"), e.select("target_block_count").scalar().alias("target_block_count"))
