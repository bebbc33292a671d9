"""Results as text for language models, metrics as text, JSON and Prometheus lines.

Results are bounded by their queries' limits; each row's text is made on the executors and joined here.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "--- BEGIN CONTEXT BLOCK ---\n", "--- END CONTEXT BLOCK ---\n\n"


def _body(shown: list[str], score: Column | None = None) -> list[Column]:
    head = [F.lit("ID: "), F.col("id")] + ([F.lit(", Similarity: "), F.format_string("%.3f", score)] if score is not None else [])
    return [*head, F.lit("):\n"), *(x for n in shown for x in (F.lit({"source_uri": "Source", "version": "Version", "metadata_json": "Metadata", "content": "Content"}[n] + ": "), F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit("\n")))]


def _numbered(rows: DataFrame, text: Column) -> list[str]:
    return [f"Block {i} ({r.text}" for i, r in enumerate(rows.select(text.alias("text")).toLocalIterator(), 1)]


def lookup_text(blocks: DataFrame, total: int) -> str:
    parts = _numbered(blocks, F.concat(*_body(["source_uri", "version", "metadata_json", "content"])))
    return f"Retrieved {total} blocks:\n\n" + "".join(BEGIN + p + END for p in parts)


def keyword_text(results: DataFrame, total: int) -> str:
    parts = _numbered(results, F.concat(*_body(["source_uri", "version", "metadata_json", "content"], F.col("score").cast("double"))))
    return f"Found {total} semantically similar blocks:\n\n" + "".join(BEGIN + p + END for p in parts)


def filtered_text(blocks: DataFrame, total: int, has_more: bool) -> str:
    parts = _numbered(blocks, F.concat(*_body(["source_uri", "version", "content"])))
    return f"Found {total} matching blocks" + (f" (showing first {len(parts)})" if has_more else "") + ":\n\n" + "".join(p + "\n" for p in parts)


def metrics_json(metrics: dict) -> str:
    return json.dumps(metrics, indent=2)


def metrics_text(m: dict) -> str:
    get = lambda k: m.get(k, 0)
    return "\n".join([
        "=== Storage Metrics ===", f"Blocks: {get('blocks_written')} written, {get('blocks_read')} read, {get('blocks_deleted')} deleted",
        f"Edges: {get('edges_added')} added, {get('edges_removed')} removed", f"Log: {get('wal_writes')} writes, {get('wal_flushes')} flushes, {get('wal_recoveries')} recoveries",
        f"Latency: {get('average_write_latency_ns')} ns write, {get('average_read_latency_ns')} ns read", f"Throughput: {get('write_throughput_bps') / (1 << 20):.2f} MB/s write, {get('read_throughput_bps') / (1 << 20):.2f} MB/s read",
        f"Data: {get('total_bytes_written') / (1 << 20):.2f} MB written, avg block {get('average_block_size_bytes') / 1024:.2f} KB", f"Errors: {get('write_errors')} write, {get('read_errors')} read, {get('wal_errors')} log",
    ]) + "\n"


def prometheus(metrics: dict, prefix: str = "trellis", up: bool = True) -> str:
    lines = [f"# HELP {prefix}_up Whether the store answers", f"# TYPE {prefix}_up gauge", f"{prefix}_up {int(up)}"]
    for k, v in metrics.items() if up else ():
        kind = "gauge" if k.startswith(("average", "total_blocks")) else "counter"
        name = f"{prefix}_{k}" + ("_total" if kind == "counter" else "")
        lines += [f"# HELP {name} {k.replace('_', ' ')}", f"# TYPE {name} {kind}", f"{name} {v}"]
    return "\n".join(lines) + "\n"
