"""Pieces that several operators share: checkpoints, Arrow batches, word rules and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import pickle
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words, as in ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses just these.
SPACES = "\x20\x09-\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only where all run on one machine."""
    sc = spark.sparkContext
    place = sc._jsc.sc().getCheckpointDir()
    if place.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        place = sc._jsc.sc().getCheckpointDir()
    return place.get()


def checkpointed(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes df to the cluster's checkpoint folder and cuts its lineage.

    release: what the steps before needed (shuffle files, earlier checkpoints) is then garbage; after large steps it is
    dropped at once instead of whenever the driver happens to collect it.
    """
    checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    out = df.checkpoint(eager=True)
    if release:
        del df
        released(out.sparkSession)
    return out


def released(spark: SparkSession) -> None:
    """Drops what nothing refers to any more: shuffle files, checkpoints, broadcasts."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffles(spark: SparkSession) -> int:
    """Shuffles that have files."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


#: Collections that a step's shuffles are waited for at most, and seconds between them.
COLLECTIONS, PAUSE = 20, 0.5


def emptied(spark: SparkSession, held: int = 0) -> None:
    """As released(), until no more shuffles are there than `held` before a step: one collection frees what refers to a
    shuffle, a later one the shuffle itself."""
    for _ in range(COLLECTIONS):
        released(spark)
        time.sleep(PAUSE)
        if shuffles(spark) <= held:
            break


def executors(spark: SparkSession) -> int:
    return spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1  # less the driver, which is alone on a single machine


def heaps_released(spark: SparkSession) -> None:
    """Each executor's JVM collects its garbage and gives the heap it doesn't need back; else it keeps what the step that
    needed most has left, beside what Python workers need in the next.  To be called between large steps."""
    if (n := executors(spark)) > 0:
        spark.range(0, n, 1, n).where("java_method('java.lang.System', 'gc') is not null").count()  # a task for each


#: Rows of a few numbers that may be broadcast.
FEW_ROWS = 1 << 18


def if_few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to have at most FEW_ROWS rows; else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text as UTF-8 bytes; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def rows(batch: pa.RecordBatch):
    """Its rows as tuples, some at a time."""
    for i in range(0, batch.num_rows, 512):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True)


def all_rows(batches):
    """Rows of all batches, of which one is held at a time."""
    for b in batches:
        yield from rows(b)
        del b


def batch_of(schema: pa.Schema, found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batch: pa.RecordBatch, n: int = 512):
    """A batch in parts of their own memory, so that what is sent back is never large, nor keeps the batch."""
    return (batch.take(pa.array(np.arange(i, min(i + n, batch.num_rows)))) for i in range(0, batch.num_rows, n))


def trimmed(fn):
    """fn for mapInArrow or applyInArrow; when it ends, the worker gives freed memory back instead of keeping it for its next task."""
    libc = lambda name: getattr(ctypes.CDLL(None), name, lambda *_: 0)  # noqa: E731  glibc's alone has these

    def give_back():
        pa.default_memory_pool().release_unused()
        libc("malloc_trim")(0)

    @functools.wraps(fn)
    def run(given):
        libc("mallopt")(-3, 1 << 20)  # arrays of a MB and more are of their own, and go back when they are freed
        if isinstance(given, pa.Table):
            try:
                return fn(given)
            finally:
                give_back()
        return batches(given)

    def batches(given):
        try:
            yield from fn(given)
        finally:
            give_back()

    return run


def map_rows(df: DataFrame, fn, fields: list[tuple[str, pa.DataType]], ddl: str, every: int = 256) -> DataFrame:
    """mapInArrow of fn(rows) -> tuples, in batches of at most `every` rows so that long rows stay bounded."""
    schema = pa.schema(fields)

    def run(batches):
        held = []
        for x in fn(all_rows(batches)):
            held.append(x)
            if len(held) >= every:
                yield batch_of(schema, held)
                held = []
        yield batch_of(schema, held)

    return df.mapInArrow(trimmed(run), ddl)


class _Planes:
    """An integer array, its bytes put in order of their place: the high ones are alike, and compress."""

    def __init__(self, a: np.ndarray):
        self.kind, self.planes = a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()

    def array(self) -> np.ndarray:
        kind = np.dtype(self.kind)
        return np.ascontiguousarray(np.frombuffer(self.planes, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def squeeze(x) -> bytes:
    if isinstance(x, tuple):
        x = tuple(_Planes(v) if isinstance(v, np.ndarray) and v.ndim == 1 and v.dtype.kind in "iu" and v.itemsize > 1 and len(v) else v for v in x)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unsqueeze(b: bytes):
    x = pickle.loads(zstandard.ZstdDecompressor().decompress(b))
    return tuple(v.array() if isinstance(v, _Planes) else v for v in x) if isinstance(x, tuple) else x


def remainder(doc_id, by: int) -> int:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % by


def joined(edges: DataFrame) -> DataFrame:
    """components() of checkpointed edges; if they are counted to be at most FEW_ROWS, it takes no shuffle, but the driver."""
    if edges.count() > FEW_ROWS:
        return components(edges)
    held = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").toArrow()
    ids, least = least_joined(*(held.column(c).to_numpy() for c in ("a", "b")))
    return edges.sparkSession.createDataFrame(pa.table({"id": ids, "component": least}), "id long, component long")


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the edges (a, b) in order, the least id that each is joined to)."""
    ids, at = np.unique(np.r_[a, b].astype(np.int64), return_inverse=True)
    root, x, y = np.arange(len(ids)), at[: len(a)], at[len(a) :]
    while (root[x] != root[y]).any():
        u, v = root[x], root[y]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


#: Edges in one part of a checkpoint.
EDGES_EACH = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of edges (a, b) is joined to; alternating large and small stars.

    Each round rewires every node to its least neighbour, so the number of rounds grows with the logarithm of the
    longest chain.  Minima are combined before the shuffle; the join back is one that AQE can split for hot nodes.
    """
    def rewire(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = checkpointed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), release=True)
    before = None
    while (after := state(now)) != before and after[0]:
        # few edges are kept in few parts: a round is then some tasks and files, not one for each shuffle partition
        before, now = after, checkpointed(rewire(rewire(now, True), False).coalesce(-(-after[0] // EDGES_EACH)))
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def removed_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
