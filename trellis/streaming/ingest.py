"""Structured Streaming into the store: source files or operation logs, each micro-batch written exactly once.

A micro-batch takes a batch of the store, noted before it is written, and writes it with overwrite; one that runs again
after a failure takes the same batch and replaces what it had left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Op, block_error, edge_error, split_valid
from ..operators.ingest import ChunkerConfig, ParserConfig, chunk, resolve_edges, stored_units, symbols_of, units_with_edges
from ..operators.store import OPS, Store


def as_ops(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Valid blocks and edges as operations to put."""
    b, e = split_valid(blocks, block_error())[0], split_valid(edges, edge_error())[0]
    own = lambda df, op: df.select(F.lit(int(op)).cast("short").alias("op"), *((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in OPS.fields if f.name not in ("seq", "op")))
    return own(b, Op.PUT_BLOCK).unionByName(own(e, Op.PUT_EDGE))


def _name(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _start(stream: DataFrame, write, checkpoint: str, once: bool):
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def ingest_stream(sources: DataFrame, store: Store, checkpoint: str, parser: ParserConfig = ParserConfig(), chunker: ChunkerConfig = ChunkerConfig(), once: bool = True):
    """Parses source rows (see `sources.files.stream_tree`) into the store; calls mean functions of the micro-batch or of the store.

    Calls of functions that come in a later micro-batch are linked by `operators.ingest.relink`.
    """
    def write(df: DataFrame, batch: int) -> None:
        units = units_with_edges(df.drop("replaced"), parser)
        known = symbols_of(stored_units(store.blocks()), chunker)
        store.append(as_ops(chunk(units, chunker), resolve_edges(units, chunker, known)), store.batch_for(_name(checkpoint), batch))

    return _start(sources, write, checkpoint, once)


def ops_stream(ops: DataFrame, store: Store, checkpoint: str, once: bool = True):
    """Appends a stream of operations (columns of the log but seq)."""
    def write(df: DataFrame, batch: int) -> None:
        store.append(df, store.batch_for(_name(checkpoint), batch))

    return _start(ops, write, checkpoint, once)
