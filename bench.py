"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with seconds for each query."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

from trellis.operators.store import Store  # noqa: E402
from trellis.plans import queries as core  # noqa: E402
from trellis.sources import tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Scans, search, lookups, traversals, aggregation, ingestion.
HEADLINE = [
    "flagship", "find_blocks_ordered", "filter_content_contains", "filter_meta_typed", "filter_meta_literal", "filter_and_or_not", "filter_page", "keyword_topk", "bfs_walks", "bfs_paths", "bfs_dangling",
    "dfs_preorder_forest", "topo_forest", "scc_contract", "reach_all_regions", "degree", "meta_selectivity", "current_state", "compact_max_version", "snapshot_hash", "code_units", "code_resolved_edges",
]


def ingest(spark) -> tuple[int, float]:
    """(rows, seconds) of putting blocks into a new store, validated and written as one batch."""
    store = Store(spark, tempfile.mkdtemp(prefix="bench-store-"))
    blocks = tables.blocks(spark, SF_DIR, "orders", "customer", "part", "documents", "events")
    began = time.perf_counter()
    store.put_blocks(blocks)
    took = round(time.perf_counter() - began, 3)
    return store.ops().count(), took


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # the JVM's start isn't a query's
    own, took = core.queries(), {}
    for name in HEADLINE:
        began = time.perf_counter()
        own[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rows, took["ingest_blocks"] = ingest(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS), "ingest_rows_per_sec": round(rows / took["ingest_blocks"]), "state": "JVM warm, each query once, nothing cached"}))
    spark.stop()


if __name__ == "__main__":
    main()
