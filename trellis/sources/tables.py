"""Relational tables as a graph: rows are blocks, foreign keys and sequences are edges.

An id is a two-digit tag of the table and the row's key as 30 hex digits.  `edge_seq` puts edges in order by family and
key; it is arithmetic on the row alone, so it needs no global numbering.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EdgeType

REGION, NATION, CUSTOMER, SUPPLIER, ORDERS, PART, DOCUMENTS, TURNS, EVENTS, PAGES, USERS, EVENT_TYPES = ("01", "02", "03", "04", "05", "06", "07", "08", "09", "0a", "0b", "0c")
#: Bits of an edge's place within its family.
FAMILY_BITS = 56


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_of(tag: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(tag), F.lpad(F.lower(F.hex(key.cast("long"))), 30, "0"))


def label_id(text: Column) -> Column:
    """An id for a short label: its bytes in hex, cut and padded."""
    return F.concat(F.lit(EVENT_TYPES), F.rpad(F.lower(F.hex(text.cast("binary"))), 30, "0"))


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


_BLOCKS = {
    "region": lambda: (REGION, F.col("r_regionkey"), "tpch://region/", F.lit('{"type":"region"}'), F.col("r_name")),
    "nation": lambda: (NATION, F.col("n_nationkey"), "tpch://nation/", F.lit('{"type":"nation"}'), F.col("n_name")),
    "customer": lambda: (CUSTOMER, F.col("c_custkey"), "tpch://customer/", _text('{"type":"customer","segment":"', F.col("c_mktsegment"), '"}'), F.col("c_name")),
    "supplier": lambda: (SUPPLIER, F.col("s_suppkey"), "tpch://supplier/", F.lit('{"type":"supplier"}'), F.col("s_name")),
    "orders": lambda: (ORDERS, F.col("o_orderkey"), "tpch://orders/", _text('{"type":"order","status":"', F.col("o_orderstatus"), '","priority":"', F.col("o_orderpriority"), '"}'), F.col("o_orderpriority")),
    "part": lambda: (PART, F.col("p_partkey"), "tpch://part/", _text('{"type":"part","brand":"', F.col("p_brand"), '","size":', F.col("p_size").cast("string"), "}"), F.col("p_name")),
    "events": lambda: (EVENTS, F.col("event_id"), None, F.col("props"), F.col("event_type")),
    "pages": lambda: (PAGES, F.col("page_id"), None, F.lit('{"type":"page"}'), F.col("html")),
    "documents": lambda: (DOCUMENTS, F.col("doc_id"), None, _text('{"type":"document","lang":"', F.col("lang"), '","n_chars":', F.col("n_chars").cast("string"), "}"), F.col("text")),
    "conversations": lambda: (TURNS, F.col("conv_id") * 1000 + F.col("turn"), None, _text('{"type":"turn","role":"', F.col("role"), '"}'), F.col("text")),
}


def blocks_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tag, key, uri, meta, content = _BLOCKS[name]()
    own = {
        "events": lambda: _text("event://", F.col("user_id").cast("string")),
        "pages": lambda: F.col("url"),
        "documents": lambda: _text("doc://", F.col("source"), "/", F.col("doc_id").cast("string")),
        "conversations": lambda: _text("conv://", F.col("conv_id").cast("string"), "/", F.col("turn").cast("string")),
    }
    at = own[name]() if uri is None else _text(uri, key.cast("string"))
    version = 1 + F.col("doc_id") % 5 if name == "documents" else F.lit(1)
    return table(spark, sf_dir, name).select(id_of(tag, key).alias("id"), version.cast("long").alias("version"), at.alias("source_uri"), meta.alias("metadata_json"), content.alias("content"))


def blocks(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (blocks_of(spark, sf_dir, n) for n in names))


def _edges(df: DataFrame, source: Column, target: Column, kind: EdgeType, family: int, place: Column) -> DataFrame:
    seq = F.lit(family << FAMILY_BITS) + place.cast("long")
    return df.select(source.alias("source_id"), target.alias("target_id"), F.lit(int(kind)).cast("short").alias("edge_type"), seq.alias("edge_seq"))


def edges_of(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    if family == "nation_region":
        return _edges(t("nation"), id_of(NATION, "n_nationkey"), id_of(REGION, "n_regionkey"), EdgeType.DEFINED_IN, 1, F.col("n_nationkey"))
    if family == "customer_nation":
        return _edges(t("customer"), id_of(CUSTOMER, "c_custkey"), id_of(NATION, "c_nationkey"), EdgeType.DEFINED_IN, 2, F.col("c_custkey"))
    if family == "supplier_nation":
        return _edges(t("supplier"), id_of(SUPPLIER, "s_suppkey"), id_of(NATION, "s_nationkey"), EdgeType.DEFINED_IN, 3, F.col("s_suppkey"))
    if family == "orders_customer":
        return _edges(t("orders"), id_of(ORDERS, "o_orderkey"), id_of(CUSTOMER, "o_custkey"), EdgeType.DEPENDS_ON, 4, F.col("o_orderkey"))
    line = F.col("l_orderkey") * 64 + F.col("l_linenumber")
    if family == "order_part":
        return _edges(t("lineitem"), id_of(ORDERS, "l_orderkey"), id_of(PART, "l_partkey"), EdgeType.REFERENCES, 5, line)
    if family == "order_supplier":
        return _edges(t("lineitem"), id_of(ORDERS, "l_orderkey"), id_of(SUPPLIER, "l_suppkey"), EdgeType.CALLS, 6, line)
    if family == "turns":
        key = F.col("conv_id") * 1000 + F.col("turn")
        return _edges(t("conversations").where("turn > 0"), id_of(TURNS, key), id_of(TURNS, key - 1), EdgeType.DEPENDS_ON, 7, key)
    raise ValueError(family)


FOREIGN_KEYS = ("nation_region", "customer_nation", "supplier_nation", "orders_customer")


def edges(spark: SparkSession, sf_dir: str, *families: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (edges_of(spark, sf_dir, f) for f in families))


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, edges): kinds of events, and which follows which for a user; small, with cycles.

    Users' events are ordered within their user; there are as many edges as pairs of kinds.
    """
    e = table(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct()
    b = kinds.select(label_id(F.col("event_type")).alias("id"), F.lit(1).cast("long").alias("version"), F.concat(F.lit("event://"), F.col("event_type")).alias("source_uri"), F.lit("{}").alias("metadata_json"), F.col("event_type").alias("content"))
    follows = e.select("event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next")).where("next is not null and next <> event_type").distinct()
    source, target = label_id(F.col("event_type")), label_id(F.col("next"))
    # a place by the labels' first bytes: few kinds, so that it tells all pairs apart
    place = F.conv(F.substring(F.hex(F.col("event_type").cast("binary")), 1, 6), 16, 10).cast("long") * (1 << 24) + F.conv(F.substring(F.hex(F.col("next").cast("binary")), 1, 6), 16, 10).cast("long")
    return b, _edges(follows, source, target, EdgeType.CALLS, 0, place)


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operation log of users' blocks: errors delete, other events put a version from their value."""
    e = table(spark, sf_dir, "events")
    gone = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), F.when(gone, 2).otherwise(1).cast("short").alias("op"), id_of(USERS, "user_id").alias("id"),
        F.when(~gone, 1 + F.floor("value").cast("long")).alias("version"), F.when(~gone, F.concat(F.lit("user://"), F.col("user_id").cast("string"))).alias("source_uri"),
        F.when(~gone, F.col("props")).alias("metadata_json"), F.when(~gone, F.col("event_type")).alias("content"),
        F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("short").alias("edge_type"),
    )
