"""Bounded graph traversals, level by level.

A level has at most `max_results` (10,000) rows that stand on a block: order inside a level is the order of their paths
(outgoing edges before incoming ones, each by insertion, equal places by id), and a level that fills the limit by itself ends the traversal
before the next one is seen, so later rows of it can't matter.  The frontier is therefore small by proof: each level is
one pass over the edges, which takes the frontier as a broadcast local relation and doesn't shuffle them; what it finds,
while it is few, goes over the blocks in the same way, to tell which exist.

`reach` has no limit: a frontier that is counted to be small is broadcast to the edges; larger ones stay distributed and are
joined by shuffle to edges that are checkpointed once.

Semantics.  `contract`: each block once, at its least depth.  `literal`: walks that never come back to the start, so a
block may come again by another path.  Edges to missing blocks are not followed or emitted.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Direction, EdgeType, InvalidQuery, checkpointed, few, parse_id

MAX_DEPTH, MAX_RESULTS, DEFAULT_DEPTH, DEFAULT_RESULTS = 100, 10_000, 10, 1000
#: A graph of so many edges (after the edge filter) is walked depth-first from one read of it; the result is the same.
DRIVER_EDGES = 200_000
#: Rows of a step that are brought to the driver at most; of a larger step only those that can be emitted are.
MAX_STEP = 50_000
#: A block of a level and the way to it: each step's direction, place of the edge and block (which parts equal places).
LEVEL = "id string, depth int, way array<struct<dir:int,seq:bigint,to:string>>"


class Algorithm(IntEnum):
    BREADTH_FIRST = 1
    DEPTH_FIRST = 2
    ASTAR = 3
    BIDIRECTIONAL_SEARCH = 4
    STRONGLY_CONNECTED = 5
    TOPOLOGICAL_SORT = 6


@dataclass(frozen=True)
class EdgeFilter:
    """Which edge types to follow: all, one, those included or all but those excluded."""

    mode: str = "all"
    types: tuple[int, ...] = ()

    @classmethod
    def only(cls, kind: EdgeType) -> EdgeFilter:
        return cls("include", (int(kind),))

    @classmethod
    def include(cls, kinds: Collection[EdgeType]) -> EdgeFilter:
        return cls("include", tuple(sorted({int(k) for k in kinds})))

    @classmethod
    def exclude(cls, kinds: Collection[EdgeType]) -> EdgeFilter:
        return cls("exclude", tuple(sorted({int(k) for k in kinds})))

    def apply(self, edges: DataFrame) -> DataFrame:
        if self.mode == "all":
            return edges
        inside = F.col("edge_type").isin(*self.types) if self.types else F.lit(False)
        return edges.where(inside if self.mode == "include" else ~inside)


ALL_EDGES = EdgeFilter()


@dataclass(frozen=True)
class Traversal:
    """Emitted rows (rank, id, depth, path) and how deep the traversal went, missing blocks included."""

    rows: DataFrame
    max_depth_reached: int

    @property
    def blocks_traversed(self) -> int:
        return self.rows.count()

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def with_blocks(self, blocks: DataFrame) -> DataFrame:
        """Rows with their whole blocks."""
        return self.rows.join(blocks, "id").orderBy("rank")

    def summary(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("blocks_traversed"), F.lit(self.max_depth_reached).alias("max_depth_reached"))


def neighbours(edges: DataFrame, direction: Direction, edge_filter: EdgeFilter = ALL_EDGES) -> DataFrame:
    """(at, to, dir, seq)."""
    edges = edge_filter.apply(edges)
    out = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.lit(0).alias("dir"), F.col("edge_seq").alias("seq"))
    into = edges.select(F.col("target_id").alias("at"), F.col("source_id").alias("to"), F.lit(1).alias("dir"), F.col("edge_seq").alias("seq"))
    return out if direction == Direction.OUTGOING else into if direction == Direction.INCOMING else out.unionByName(into)


def validate(max_depth: int, max_results: int) -> None:
    if not 1 <= max_depth <= MAX_DEPTH:
        raise InvalidQuery("InvalidDepth", str(max_depth))
    if not 1 <= max_results <= MAX_RESULTS:
        raise InvalidQuery("InvalidMaxResults", str(max_results))


def _step(now: DataFrame, near: DataFrame, start: str, unique: bool) -> DataFrame:
    """(id, way) one edge on from a frontier; the first way to each id where blocks come once."""
    step = near.where(F.col("to") != start).join(now.select(F.col("id").alias("at"), "way"), "at")
    step = step.select(F.col("to").alias("id"), F.concat("way", F.array(F.struct("dir", "seq", "to"))).alias("way"))
    return step.groupBy("id").agg(F.min("way").alias("way")) if unique else step


def levels(blocks: DataFrame, edges: DataFrame, start: str, direction: Direction, edge_filter: EdgeFilter, max_depth: int, max_results: int, unique: bool) -> Traversal:
    """A traversal of at most max_results rows; these, and no others, are kept between levels, as a local relation."""
    spark, start = blocks.sparkSession, parse_id(start)
    if find(blocks, start).isEmpty():
        return Traversal(_ranked(spark, start, [], max_results), 0)
    near, ids = neighbours(edges, direction, edge_filter), blocks.select("id")
    local = lambda rows: F.broadcast(spark.createDataFrame(rows, LEVEL))  # noqa: E731  at most max_results rows
    emitted = now = [(start, 0, [])]
    deepest = 0
    for depth in range(1, max_depth + 1):
        left = max_results - len(emitted)
        if not left:
            break
        step = _step(local(now), near, start, unique)
        if unique:
            step = step.join(local(emitted).select("id"), "id", "left_anti")
        near_by = [(r.id, depth, [tuple(x) for x in r.way]) for r in step.limit(MAX_STEP + 1).collect()]
        if len(near_by) <= MAX_STEP:
            exist = {r.id for r in ids.join(local(near_by).select("id").distinct(), "id", "left_semi").collect()} if near_by else set()
            rows = sorted((r for r in near_by if r[0] in exist), key=lambda r: r[2])[:left]
            step = spark.createDataFrame(near_by, LEVEL)
        else:
            found = step.join(ids, "id", "left_semi").orderBy("way").limit(left)
            rows = [(r.id, depth, [tuple(x) for x in r.way]) for r in found.collect()]
        if not rows:  # edges to missing blocks still count as depth, those met before only in walks
            gone = step.select("id").join(ids, "id", "left_anti")
            if unique and depth > 1:
                earlier = [r for r in emitted if r[1] < depth - 1]
                gone = gone.join(near.join(local(earlier).select(F.col("id").alias("at")), "at").select(F.col("to").alias("id")).distinct(), "id", "left_anti")
            return Traversal(_ranked(spark, start, emitted, max_results), depth if not gone.isEmpty() else deepest)
        emitted, now, deepest = emitted + rows, rows, depth
    return Traversal(_ranked(spark, start, emitted, max_results), deepest)


def _ranked(spark, start: str, emitted: list[tuple], max_results: int) -> DataFrame:
    """The emitted rows, which are in order, with their place and path."""
    rows = [(k, id_, depth, [start, *(to for _, _, to in way)]) for k, (id_, depth, way) in enumerate(emitted[:max_results], 1)]
    return spark.createDataFrame(rows, "rank long, id string, depth int, path array<string>")


def breadth_first(blocks, edges, start, direction=Direction.OUTGOING, edge_filter=ALL_EDGES, max_depth=DEFAULT_DEPTH, max_results=DEFAULT_RESULTS, semantics="contract") -> Traversal:
    validate(max_depth, max_results)
    return levels(blocks, edges, start, direction, edge_filter, max_depth, max_results, semantics != "literal")


def astar(blocks, edges, start, direction=Direction.OUTGOING, edge_filter=ALL_EDGES, max_depth=DEFAULT_DEPTH, max_results=DEFAULT_RESULTS) -> Traversal:
    """Cost so far plus a constant estimate, without a goal: each block once, in order of depth."""
    validate(max_depth, max_results)
    return levels(blocks, edges, start, direction, edge_filter, max_depth, max_results, True)


def bidirectional_search(blocks, edges, start, direction=Direction.BIDIRECTIONAL, edge_filter=ALL_EDGES, max_depth=DEFAULT_DEPTH, max_results=DEFAULT_RESULTS) -> Traversal:
    """Each block once, down to half the depth (a depth of 1 has the start alone)."""
    validate(max_depth, max_results)
    return levels(blocks, edges, start, direction, edge_filter, max_depth // 2, max_results, True)


class _Adjacency:
    """Neighbours of blocks in edge order, existing ones told apart.

    A graph of at most DRIVER_EDGES edges is read once.  Of a larger one, neighbours are fetched for what stands on top
    of the stack.  Of one block's neighbours only the last `bound` distinct existing ones can be emitted (each popped
    earlier either is emitted or was before); of missing ones between two of these, which only count as depth, one
    tells as much as all.  So what is held is bounded by the limits of the query.
    """

    BATCH = 64

    def __init__(self, blocks: DataFrame, near: DataFrame, bound: int, driver_edges: int = DRIVER_EDGES):
        self.blocks, self.near, self.bound, self.held = blocks.select("id"), near, bound, {}
        few = near.select("at", "to", "dir", "seq").limit(driver_edges + 1).collect()
        self.whole = len(few) <= driver_edges
        if self.whole:
            known = {r.id for r in self.blocks.join(F.broadcast(near.select(F.col("to").alias("id")).limit(driver_edges).distinct()), "id", "left_semi").collect()}
            for r in sorted(few, key=lambda r: (r.dir, r.seq, r.to)):
                self.held.setdefault(r.at, []).append((r.to, r.to in known))

    def of(self, id_: str, stack: list) -> list[tuple[str, bool]]:
        if id_ not in self.held and not self.whole:
            wanted = [id_]
            for other, *_ in reversed(stack):
                if other not in self.held and other not in wanted:
                    wanted.append(other)
                if len(wanted) == self.BATCH:
                    break
            last = self.near.where(F.col("at").isin(wanted)).groupBy("at", "to").agg(F.max(F.struct("dir", "seq", "to")).alias("o"))
            last = last.join(self.blocks.withColumn("found", F.lit(True)).withColumnRenamed("id", "to"), "to", "left").withColumn("found", F.coalesce("found", F.lit(False)))
            back = Window.partitionBy("at").orderBy(F.col("o").desc())
            after = F.coalesce(F.sum(F.col("found").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            last = last.withColumn("after", after).withColumn("alone", F.col("found") | F.coalesce(F.lag("found").over(back), F.lit(True)))
            got = last.where((F.col("after") < self.bound) & F.col("alone")).select("at", "to", "o", "found").collect()
            self.held.update({w: [] for w in wanted})
            for r in sorted(got, key=lambda r: tuple(r.o)):
                self.held[r["at"]].append((r.to, r.found))
        return self.held.get(id_, [])


def depth_first(blocks, edges, start, direction=Direction.OUTGOING, edge_filter=ALL_EDGES, max_depth=DEFAULT_DEPTH, max_results=DEFAULT_RESULTS, driver_edges: int = DRIVER_EDGES) -> Traversal:
    """Last edge first; a block is taken when it leaves the stack, so with a depth limit a block first met deep is not
    taken up again from a shallower path.  The order is sequential by nature; only ids are walked on the driver."""
    validate(max_depth, max_results)
    spark, start = blocks.sparkSession, parse_id(start)
    near = _Adjacency(blocks, neighbours(edges, direction, edge_filter), max_results, driver_edges)
    out, seen, deepest = [], set(), 0
    stack = [(start, not find(blocks, start).isEmpty(), 0, (start,))]
    while stack and len(out) < max_results:
        id_, found, depth, path = stack.pop()
        if id_ in seen:
            continue
        seen.add(id_)
        deepest = max(deepest, depth)
        if not found:
            continue
        out.append((len(out) + 1, id_, depth, list(path)))
        if depth < max_depth:
            stack += [(to, ok, depth + 1, (*path, to)) for to, ok in near.of(id_, stack) if to not in seen]
    schema = "rank long, id string, depth int, path array<string>"
    return Traversal(spark.createDataFrame(out, schema), deepest)


def find(blocks: DataFrame, id_: str) -> DataFrame:
    return blocks.select("id").where(F.col("id") == id_).limit(1)


def traverse(blocks, edges, start, algorithm: Algorithm = Algorithm.BREADTH_FIRST, direction=Direction.OUTGOING, edge_filter=ALL_EDGES, max_depth=DEFAULT_DEPTH, max_results=DEFAULT_RESULTS, semantics="contract") -> Traversal:
    """Any of the algorithms by its number."""
    from . import graph

    args = (blocks, edges, start, direction, edge_filter, max_depth, max_results)
    if algorithm == Algorithm.BREADTH_FIRST:
        return breadth_first(*args, semantics)
    if algorithm == Algorithm.DEPTH_FIRST or (algorithm == Algorithm.STRONGLY_CONNECTED and semantics == "literal"):
        return depth_first(*args)
    if algorithm == Algorithm.ASTAR:
        return astar(*args)
    if algorithm == Algorithm.BIDIRECTIONAL_SEARCH:
        return bidirectional_search(*args)
    validate(max_depth, max_results)
    if algorithm == Algorithm.STRONGLY_CONNECTED:
        return graph.component_of(blocks, edges, start, edge_filter, max_depth, max_results)
    return graph.topological_sort(blocks, edges, start, edge_filter, max_depth)


def traverse_outgoing(blocks, edges, start, max_depth) -> Traversal:
    return breadth_first(blocks, edges, start, Direction.OUTGOING, max_depth=max_depth)


def traverse_incoming(blocks, edges, start, max_depth) -> Traversal:
    return breadth_first(blocks, edges, start, Direction.INCOMING, max_depth=max_depth)


def traverse_bidirectional(blocks, edges, start, max_depth) -> Traversal:
    return breadth_first(blocks, edges, start, Direction.BIDIRECTIONAL, max_depth=max_depth)


def traverse_astar(blocks, edges, start, max_depth) -> Traversal:
    return astar(blocks, edges, start, Direction.OUTGOING, max_depth=max_depth)


def reach(edges: DataFrame, starts: DataFrame, direction=Direction.OUTGOING, edge_filter=ALL_EDGES, max_depth=DEFAULT_DEPTH, blocks: DataFrame | None = None) -> DataFrame:
    """(start, id, depth): all that many starts (column start) reach, without limit; with blocks, only by way of these."""
    near, shared = neighbours(edges, direction, edge_filter).select("at", "to"), None
    if blocks is not None:
        blocks = blocks.select(F.col("id").alias("to"))
    seen = now = checkpointed(starts.select("start", F.col("start").alias("id"), F.lit(0).alias("depth")).distinct())
    for depth in range(1, max_depth + 1):
        if few(now):
            step = near.join(F.broadcast(now.select("start", F.col("id").alias("at"))), "at")
        else:
            shared = shared or checkpointed(near.distinct())
            step = shared.join(now.select("start", F.col("id").alias("at")), "at")
        step = step.select("start", F.col("to").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        if blocks is not None:
            step = checkpointed(step)
            ids = step.select(F.col("id").alias("to")).distinct()
            real = blocks.join(F.broadcast(ids), "to", "left_semi") if few(ids) else blocks.join(ids, "to", "left_semi")
            step = step.join(real.select(F.col("to").alias("id")), "id", "left_semi").select("start", "id")
        now = checkpointed(step.withColumn("depth", F.lit(depth)))
        if now.isEmpty():
            break
        seen = seen.unionByName(now)
    return seen
