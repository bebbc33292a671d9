"""The data model: blocks, typed edges, the operation log, ids and the rules that rows must keep."""

from __future__ import annotations

import itertools
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType([T.StructField("id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("source_uri", T.StringType()), T.StructField("metadata_json", T.StringType()), T.StructField("content", T.StringType())])
EDGE = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("edge_type", T.ShortType()), T.StructField("edge_seq", T.LongType())])
SOURCE = T.StructType([T.StructField("data", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("timestamp_ns", T.LongType())])
BLOCK_COLUMNS, EDGE_COLUMNS = BLOCK.fieldNames(), EDGE.fieldNames()


class EdgeType(IntEnum):
    IMPORTS = 1
    DEFINED_IN = 2
    REFERENCES = 3
    CONTAINS = 4
    EXTENDS = 5
    IMPLEMENTS = 6
    CALLS = 7
    DEPENDS_ON = 8
    METHOD_OF = 9
    CALLS_METHOD = 10
    CALLS_FUNCTION = 11


class Direction(IntEnum):
    OUTGOING = 1
    INCOMING = 2
    BIDIRECTIONAL = 3


class Op(IntEnum):
    PUT_BLOCK = 1
    DELETE_BLOCK = 2
    PUT_EDGE = 3
    DELETE_EDGE = 4


class InvalidQuery(ValueError):
    """A query outside the limits; `code` names the rule."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


#: Bytes; greatest allowed sizes are one less.
MAX_URI, MAX_METADATA, MAX_CONTENT = 1 << 20, 10 << 20, 100 << 20
ID = r"^[0-9a-f]{32}$"
ZERO_ID = "0" * 32


def edge_type_name(code: Column) -> Column:
    return F.create_map(*[x for t in EdgeType for x in (F.lit(int(t)), F.lit(t.name.lower()))])[code.cast("int")]


def parse_id(text: str) -> str:
    """The canonical (lower-case) id of 32 hex digits; the zero id is invalid."""
    if len(text) != 32 or not all(c in "0123456789abcdefABCDEF" for c in text):
        raise InvalidQuery("InvalidBlockId", text)
    if text == ZERO_ID:
        raise InvalidQuery("ZeroBlockId")
    return text.lower()


def numbered_id(seed: int) -> str:
    """The little-endian 128-bit number seed + 1, as hex."""
    return (seed + 1).to_bytes(16, "little").hex()


class IdSource:
    """Ids in sequence for tests and tools: a counter in bytes 0 to 7, its upper half in bytes 8 to 15."""

    def __init__(self, first: int = 1):
        self._next = itertools.count(first)

    def __call__(self) -> str:
        n = next(self._next)
        return ((n & (1 << 64) - 1) | (n >> 32) << 64).to_bytes(16, "little").hex()


def id_to_bytes(id_: Column) -> Column:
    return F.unhex(id_)


def id_from_bytes(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def block_error(for_ingestion: bool = False) -> Column:
    """The name of the first rule a block row breaks, null if it is valid."""
    size = lambda c: F.octet_length(F.col(c))
    out = (
        F.when(F.col("id").isNull() | ~F.col("id").rlike(ID), "InvalidBlockId")
        .when(F.col("id") == ZERO_ID, "ZeroBlockId")
        .when(F.col("version").isNull() | (F.col("version") < 1), "InvalidVersion")
        .when(F.col("source_uri").isNull() | F.col("metadata_json").isNull() | F.col("content").isNull(), "MissingField")
        .when(size("source_uri") >= MAX_URI, "SourceUriTooLong")
        .when(size("metadata_json") >= MAX_METADATA, "MetadataTooLong")
        .when(size("content") >= MAX_CONTENT, "ContentTooLong")
        .when(F.try_parse_json("metadata_json").isNull(), "InvalidMetadata")
    )
    return out.when(size("source_uri") == 0, "EmptySourceUri").when(size("content") == 0, "EmptyContent") if for_ingestion else out


def edge_error() -> Column:
    bad = lambda c: F.col(c).isNull() | ~F.col(c).rlike(ID) | (F.col(c) == ZERO_ID)
    return (
        F.when(bad("source_id") | bad("target_id"), "InvalidBlockId")
        .when(F.col("source_id") == F.col("target_id"), "SelfEdge")
        .when(F.col("edge_type").isNull() | ~F.col("edge_type").between(1, max(EdgeType)), "InvalidEdgeType")
    )


def split_valid(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with a column error)."""
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def shared_folder(spark) -> str:
    """The checkpoint folder, which driver and executors share, as the session names it; a temporary one only where all runs on one machine."""
    import tempfile

    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of ids that may be broadcast or brought to the driver.
FEW_ROWS = 1 << 17


def few(df: DataFrame) -> bool:
    return df.limit(FEW_ROWS + 1).count() <= FEW_ROWS


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with its place (from 1) in a total order, without bringing all rows to one task.

    Rows are range-partitioned by the order and numbered within their partition; the partitions' sizes (one number for
    each) give the offsets.
    """
    from pyspark.sql import Window

    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = checkpointed(df.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id()))
    sizes = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(before)]
        before += sizes[p]
    offset = F.create_map(*starts)[F.col("__p")] if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    return parts.withColumn(name, (offset + place).cast("long")).drop("__p")
