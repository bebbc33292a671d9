"""The store: an append-only operation log in Parquet, current state, snapshots and compaction.

Layout under one folder: `ops/batch=N/` holds each append as written at once (a batch that is written again replaces
itself, so retries are safe), `snapshot/N/` holds blocks and edges compacted up to batch N, sorted by id so that
Parquet's statistics prune lookups.  `seq` orders operations: the batch in the high bits, the place in it below.

`claims/N` is created exclusively before batch N is written, so two writers never take the same one.  A snapshot stops
before the first batch that is claimed but not written, so a slow writer's batch isn't lost; a failed append gives its claim back.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BLOCK, BLOCK_COLUMNS, EDGE, EDGE_COLUMNS, Op, block_error, checkpointed, edge_error, few, split_valid
from .analytics import metric_columns, metrics_of
from .metrics import StorageMetrics

OPS = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.ShortType()), *BLOCK.fields, *(f for f in EDGE.fields if f.name != "edge_seq")])
#: A batch numbers its rows by task and place in the task in so many bits; one with more of either numbers them without gaps.
TASK_BITS, ROW_BITS = 14, 24
#: Batches of the log at which it should be compacted, writers should slow down, and stop; bytes that are worth it.
COMPACT_BATCHES, STALL_BATCHES, BLOCK_BATCHES, TIER_BYTES = 4, 8, 12, 64 << 20
OVERFLOW = "more tasks or rows in a task than places"


def current_blocks(ops: DataFrame) -> DataFrame:
    """The latest block of each id by arrival, unless it was deleted.  Versions are combined before the shuffle."""
    mine = ops.where(F.col("op").isin(int(Op.PUT_BLOCK), int(Op.DELETE_BLOCK)))
    last = mine.groupBy("id").agg(F.max_by(F.struct("op", *(c for c in BLOCK_COLUMNS if c != "id")), "seq").alias("last"))
    return last.where(F.col("last.op") == int(Op.PUT_BLOCK)).select("id", *(F.col(f"last.{c}").alias(c) for c in BLOCK_COLUMNS if c != "id"))


def current_edges(ops: DataFrame) -> DataFrame:
    """Edges (repeats kept) that were put after the last delete of either end and after their own removal.

    Only the log's deletes, one row an id, are joined to the edges: by broadcast while they are counted to be few.
    """
    puts = ops.where(F.col("op") == int(Op.PUT_EDGE)).select("source_id", "target_id", "edge_type", F.col("seq").alias("edge_seq"))
    gone = ops.where(F.col("op") == int(Op.DELETE_BLOCK)).groupBy("id").agg(F.max("seq").alias("gone"))
    cut = ops.where(F.col("op") == int(Op.DELETE_EDGE)).groupBy("source_id", "target_id", "edge_type").agg(F.max("seq").alias("cut"))
    gone, cut = (F.broadcast(x) if few(x) else x for x in (gone, cut))
    live = puts.join(gone.select(F.col("id").alias("source_id"), F.col("gone").alias("g1")), "source_id", "left").join(gone.select(F.col("id").alias("target_id"), F.col("gone").alias("g2")), "target_id", "left").join(cut, ["source_id", "target_id", "edge_type"], "left")
    after = lambda c: F.col("edge_seq") > F.coalesce(F.col(c), F.lit(-1))
    return live.where(after("g1") & after("g2") & after("cut")).select(*EDGE_COLUMNS)


def compacted(blocks: DataFrame, order: str = "seq") -> DataFrame:
    """One block of each id: the highest version, of equal ones the latest."""
    rest = [c for c in BLOCK_COLUMNS if c != "id"]
    best = blocks.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("version", order)).alias("b"))
    return best.select("id", *(F.col(f"b.{c}").alias(c) for c in rest))


@dataclass(frozen=True)
class Tier:
    """Batches and bytes of the log after the last snapshot, and that one's bytes."""

    batches: int
    log_bytes: int
    snapshot_bytes: int

    @property
    def target_bytes(self) -> int:
        """What a log may hold before it is worth rewriting the snapshot."""
        return max(TIER_BYTES, self.snapshot_bytes // 4)

    @property
    def due(self) -> bool:
        return self.batches >= COMPACT_BATCHES or self.log_bytes > self.target_bytes

    @property
    def throttle(self) -> str:
        """none, stall (writers should slow down) or block (compact first)."""
        return "block" if self.batches >= BLOCK_BATCHES else "stall" if self.batches >= STALL_BATCHES else "none"


class Store:
    """A store in one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.metrics = spark, path.rstrip("/"), StorageMetrics()
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("ops"))

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _children(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def batches(self) -> list[int]:
        return sorted(int(n[6:]) for n in self._children("ops") if n.startswith("batch=") and self._fs.exists(self._path("ops", n, "_SUCCESS")))

    def snapshots(self) -> list[int]:
        """Snapshots that were written to their end."""
        return sorted(int(n) for n in self._children("snapshot") if n.isdigit() and self._fs.exists(self._path("snapshot", n, "edges", "_SUCCESS")))

    def _claim(self) -> int:
        """A batch of its own for this writer."""
        held = [int(n.split("=")[1]) for stream in self._children("streams") for n in self._children("streams", stream)]
        batch = max([*self.batches(), *self.snapshots(), *held, *map(int, self._children("claims")), -1]) + 1
        while not self._create("claims", str(batch)):
            batch += 1
        return batch

    def _create(self, *parts: str) -> bool:
        """Makes an empty file; False if there is one."""
        try:
            self._fs.create(self._path(*parts), False).close()
        except Py4JJavaError as x:
            if not self._fs.exists(self._path(*parts)):
                raise x
            return False
        return True

    def _give_back(self, batch: int) -> None:
        self._fs.delete(self._path("claims", str(batch)), False)

    def batch_for(self, stream: str, number: int) -> int:
        """The store's batch for a micro-batch of a stream: the same one each time it is asked for."""
        for n in self._children("streams", stream):
            if n.startswith(f"{number}="):
                return int(n.split("=")[1])
        batch = self._claim()
        self._create("streams", stream, f"{number}={batch}")
        return batch

    def append(self, ops: DataFrame, batch: int | None = None) -> int:
        """Writes operations (columns of OPS but seq; missing ones are null) as one batch, in their order."""
        known = set(ops.columns)
        columns = [(F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in OPS.fields if f.name != "seq"]
        own = batch is None
        batch = self._claim() if own else batch
        at = F.monotonically_increasing_id()
        task, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
        fits = F.assert_true((task < (1 << TASK_BITS)) & (row < (1 << ROW_BITS)), OVERFLOW)
        seq = F.lit(batch << (TASK_BITS + ROW_BITS)) + F.shiftleft(task, ROW_BITS) + row
        try:
            try:
                self._write(ops.select(F.coalesce(fits.cast("long"), seq).alias("seq"), *columns), batch)
            except Exception as x:
                if OVERFLOW not in str(x):
                    raise
                self._write(self._dense(ops.select(*columns), batch), batch)
        except Exception:
            self.metrics.add(write_errors=1)
            if own:
                self._give_back(batch)
            raise
        return batch

    def _dense(self, ops: DataFrame, batch: int) -> DataFrame:
        """ops with places that leave none out: each task's rows follow those of the tasks before, which are counted."""
        at = F.monotonically_increasing_id()
        held = checkpointed(ops.withColumn("task", F.shiftright(at, 33)).withColumn("row", at.bitwiseAND(F.lit((1 << 33) - 1))))
        sizes = held.groupBy("task").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("task")) - F.col("n")).select("task", "before")  # a row a task
        seq = F.lit(batch << (TASK_BITS + ROW_BITS)) + F.col("before") + F.col("row")
        return held.join(before, "task").select(seq.alias("seq"), *ops.columns)

    def _write(self, rows: DataFrame, batch: int) -> None:
        seen, counts = Observation(), metrics_of(rows).columns
        began = time.perf_counter_ns()
        rows.observe(seen, *metric_columns()).write.mode("overwrite").parquet(f"{self.path}/ops/batch={batch}")
        self.metrics.add(**{c: int(seen.get[c]) for c in counts}, wal_flushes=1, total_write_time_ns=time.perf_counter_ns() - began)

    def put_blocks(self, blocks: DataFrame, for_ingestion: bool = False) -> DataFrame:
        """Appends valid blocks; the rejected ones, with their error, are returned."""
        good, bad = split_valid(blocks, block_error(for_ingestion))
        self.append(good.withColumn("op", F.lit(int(Op.PUT_BLOCK))))
        return bad

    def put_edges(self, edges: DataFrame) -> DataFrame:
        good, bad = split_valid(edges, edge_error())
        self.append(good.withColumn("op", F.lit(int(Op.PUT_EDGE))))
        return bad

    def delete_blocks(self, ids: DataFrame) -> int:
        return self.append(ids.select("id").withColumn("op", F.lit(int(Op.DELETE_BLOCK))))

    def delete_edges(self, edges: DataFrame) -> int:
        return self.append(edges.select("source_id", "target_id", "edge_type").withColumn("op", F.lit(int(Op.DELETE_EDGE))))

    def ops(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """The log of all batches after one, up to another; incomplete batches are not read."""
        read = [f"{self.path}/ops/batch={b}" for b in self.batches() if b > after and (upto is None or b <= upto)]
        return self.spark.read.schema(OPS).parquet(*read) if read else self.spark.createDataFrame([], OPS)

    def _all_ops(self, upto: int | None = None) -> DataFrame:
        """The last snapshot as operations, and the log after it, up to a batch."""
        if not (snaps := self.snapshots()):
            return self.ops(upto=upto)
        s = f"{self.path}/snapshot/{snaps[-1]}"
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in EDGE.fields if f.name != "edge_seq"]
        blocks = self.spark.read.parquet(f"{s}/blocks").select(F.lit(-1).cast("long").alias("seq"), F.lit(int(Op.PUT_BLOCK)).cast("short").alias("op"), *BLOCK_COLUMNS, *none)
        edges = self.spark.read.parquet(f"{s}/edges")
        edges = edges.select(F.col("edge_seq").alias("seq"), F.lit(int(Op.PUT_EDGE)).cast("short").alias("op"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in BLOCK.fields), "source_id", "target_id", "edge_type")
        return blocks.unionByName(edges).unionByName(self.ops(snaps[-1], upto))

    def blocks(self) -> DataFrame:
        return current_blocks(self._all_ops())

    def edges(self) -> DataFrame:
        return current_edges(self._all_ops())

    def compact(self, policy: str = "latest") -> int:
        """Writes a snapshot of the current state up to the last batch.

        `max_version` keeps the highest version of each live id instead of the latest one.  -1 where nothing can be compacted.
        """
        upto = self._complete()
        if upto < 0 or upto in self.snapshots():  # nothing that could be written
            return upto
        ops, out = self._all_ops(upto), f"{self.path}/snapshot/{upto}"
        blocks = current_blocks(ops)
        if policy == "max_version":
            blocks = compacted(ops.where(F.col("op") == int(Op.PUT_BLOCK)).join(blocks.select("id"), "id", "left_semi"))
        blocks.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("parquet.bloom.filter.enabled#id", "true").parquet(f"{out}/blocks")
        self.metrics.add(compactions=1)
        current_edges(ops).repartitionByRange("source_id").sortWithinPartitions("source_id", "edge_seq").write.mode("overwrite").parquet(f"{out}/edges")
        return upto

    def _complete(self) -> int:
        """The last batch before which none is claimed but not written."""
        done, snaps = self.batches(), self.snapshots()
        last = snaps[-1] if snaps else -1
        pending = [c for c in map(int, self._children("claims")) if c > last and c not in done]
        return max([b for b in done if not pending or b < min(pending)] + [last])

    def tier(self) -> Tier:
        """How the log stands against the last snapshot: what compaction has to do and whether writers should wait."""
        snaps = self.snapshots()
        log = [self._path("ops", f"batch={b}") for b in self.batches() if not snaps or b > snaps[-1]]
        size = lambda p: self._fs.getContentSummary(p).getLength()
        return Tier(len(log), sum(map(size, log)), size(self._path("snapshot", str(snaps[-1]))) if snaps else 0)

    def compact_if_due(self, policy: str = "latest") -> int | None:
        """Compacts if the log has enough batches or bytes for it; the snapshot's number, None without need."""
        return self.compact(policy) if self.tier().due else None

    def vacuum(self) -> int:
        """Drops batches and snapshots that the last snapshot holds; how many went."""
        if not (snaps := self.snapshots()):
            return 0
        gone = [self._path("ops", f"batch={b}") for b in self.batches() if b <= snaps[-1]] + [self._path("snapshot", str(s)) for s in snaps[:-1]]
        for c in self._children("claims"):
            if int(c) < snaps[-1]:
                self._give_back(int(c))
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)

    def reset(self) -> None:
        self._fs.delete(self._path(), True)
        self._fs.mkdirs(self._path("ops"))

    def files(self) -> DataFrame:
        """(file, rows) of the log."""
        return self.ops().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))


def recovery(ops: DataFrame) -> DataFrame:
    """One row about a log as read: entries by kind, corrupt ones (unknown operation or an invalid payload), their share in percent."""
    kind = F.col("op")
    bad = (
        F.when(kind == int(Op.PUT_BLOCK), block_error().isNotNull())
        .when(kind == int(Op.DELETE_BLOCK), F.col("id").isNull())
        .when(kind.isin(int(Op.PUT_EDGE), int(Op.DELETE_EDGE)), edge_error().isNotNull())
        .otherwise(True)
    )
    n, c, of = F.count("*"), F.count_if(bad), lambda op: F.count_if((kind == int(op)) & ~bad)
    return ops.agg(n.alias("entries"), c.alias("corrupted"), F.when(n > 0, c * 100.0 / n).otherwise(0.0).alias("corruption_rate"), of(Op.PUT_BLOCK).alias("blocks_recovered"), of(Op.PUT_EDGE).alias("edges_recovered"), of(Op.DELETE_BLOCK).alias("deletes_recovered"))


def valid_ops(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations to replay, corrupt ones with their error)."""
    kind = F.col("op")
    error = (
        F.when(kind == int(Op.PUT_BLOCK), block_error())
        .when(kind == int(Op.DELETE_BLOCK), F.when(F.col("id").isNull(), "InvalidBlockId"))
        .when(kind.isin(int(Op.PUT_EDGE), int(Op.DELETE_EDGE)), edge_error())
        .otherwise("InvalidOperation")
    )
    return split_valid(ops, error)


def temporary_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, f"{folder}/store-{uuid.uuid4().hex}")
