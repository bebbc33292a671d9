"""Command line: version, demo, status, list-blocks, query, ingest, analyze."""

from __future__ import annotations

import argparse

from ..operators import analytics, filters
from ..operators.ingest import chunk, resolve_edges, units_with_edges
from ..operators.store import Store
from ..operators.traverse import Algorithm
from ..sources.files import TreeConfig, read_tree
from . import formats
from .engine import Engine

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trellis", description="Queries over a graph of code and documents.")
    p.add_argument("--store", default="trellis-store", help="the store's folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("demo")
    s = sub.add_parser("status")
    s.add_argument("--format", choices=("text", "json", "prometheus"), default="text")
    s = sub.add_parser("list-blocks")
    s.add_argument("--limit", type=int, default=20)
    s = sub.add_parser("query")
    how = s.add_mutually_exclusive_group(required=True)
    how.add_argument("--id", action="append")
    how.add_argument("--search")
    how.add_argument("--contains")
    how.add_argument("--traverse")
    s.add_argument("--algorithm", choices=[a.name.lower() for a in Algorithm], default="breadth_first")
    s.add_argument("--limit", type=int, default=100)
    for name in ("ingest", "analyze"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        if name == "analyze":
            s.add_argument("--call", action="append", default=[])
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("trellis").getOrCreate()


def main(args: list[str], spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(f"trellis {VERSION}")
        return 0
    spark = spark or session()
    if a.command == "analyze":
        sources = read_tree(spark, TreeConfig(a.folder))
        print(formats.metrics_json(analytics.code_statistics(sources).first().asDict()))
        if a.call:
            for r in analytics.count_calls(sources.withColumnRenamed("data", "content"), a.call).collect():  # one row for each name given
                print(f"{r['name']}: {r['calls']}")
        return 0
    store = Store(spark, a.store)
    if a.command == "ingest":
        units = units_with_edges(read_tree(spark, TreeConfig(a.folder)))
        store.put_blocks(chunk(units))
        store.put_edges(resolve_edges(units))
        print("done")
        return 0
    with Engine(store) as engine:
        if a.command == "demo":
            store.put_blocks(spark.createDataFrame([(f"{i:032x}", 1, f"demo://{i}", "{}", f"demo block {i}") for i in (1, 2)], "id string, version long, source_uri string, metadata_json string, content string"))
            print(engine.answer({"type": "find_blocks", "ids": [f"{1:032x}", f"{2:032x}"]}))
        elif a.command == "status":
            m = analytics.metrics_of(store.ops()).first().asDict()
            print({"text": formats.metrics_text, "json": formats.metrics_json, "prometheus": formats.prometheus}[a.format](m), end="")
        elif a.command == "list-blocks":
            for r in engine.blocks.select("id", "version", "source_uri").orderBy("id").limit(a.limit).toLocalIterator():
                print(r.id, r.version, r.source_uri)
        elif a.id:
            print(engine.answer({"type": "find_blocks", "ids": a.id}))
        elif a.search:
            print(engine.answer({"type": "semantic", "query": a.search, "options": {"max_results": a.limit}}))
        elif a.contains:
            print(engine.answer({"type": "filtered_query", "where": filters.content(filters.Operator.CONTAINS, a.contains), "options": {"max_results": a.limit}}))
        else:
            print(engine.answer({"type": "traversal", "start": a.traverse, "options": {"algorithm": Algorithm[a.algorithm.upper()], "max_results": a.limit}}))
    return 0
