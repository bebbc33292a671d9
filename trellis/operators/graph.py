"""Whole-graph orders: topological sort, strong components, degrees.

These peel or colour the graph in rounds of joins on the node's id; each round is checkpointed, so lineage stays short
and lost executors recompute little.  A hot node's edges are reduced before the shuffle (distinct, min) or joined by
joins that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Direction, checkpointed, few, parse_id, ranked
from .traverse import ALL_EDGES, DEFAULT_DEPTH, DEFAULT_RESULTS, EdgeFilter, Traversal, neighbours, reach, validate

ORDER = "rank long, id string, depth int, path array<string>"


def topological_layers(nodes: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """(id, layer) of nodes (id) under pairs (at, to) among them; None if there is a cycle.

    Layer 0 has no incoming edge; each round takes off the nodes that none of the rest points to.
    """
    nodes, pairs, out, layer = checkpointed(nodes.select("id")), checkpointed(pairs.select("at", "to").distinct()), None, 0
    if few(nodes) and few(pairs):
        found = _layers([r.id for r in nodes.collect()], [(r["at"], r.to) for r in pairs.collect()])
        return None if found is None else nodes.sparkSession.createDataFrame(found, "id string, layer int")
    left = nodes.count()
    while left:
        free = nodes.join(pairs.select(F.col("to").alias("id")).distinct(), "id", "left_anti")
        free = checkpointed((free if out is None else free.join(out.select("id"), "id", "left_anti")).withColumn("layer", F.lit(layer)))
        n = free.count()
        if not n:
            return None
        out = free if out is None else out.unionByName(free)
        left, layer = left - n, layer + 1
        if left:
            pairs = checkpointed(pairs.join(free.select(F.col("id").alias("at")), "at", "left_anti"))
        if layer % 16 == 0:  # plans stay short however many layers there are
            out = checkpointed(out)
            nodes = checkpointed(nodes.join(out.select("id"), "id", "left_anti"))
    return out


def _layers(nodes: list[str], pairs: list[tuple[str, str]]) -> list[tuple[str, int]] | None:
    """The same for a graph of bounded size, on the driver."""
    into, out = dict.fromkeys(nodes, 0), {n: [] for n in nodes}
    for a, b in pairs:
        into[b] += 1
        out[a].append(b)
    now, found = [n for n in nodes if not into[n]], []
    layer = 0
    while now:
        found += [(n, layer) for n in now]
        later = []
        for n in now:
            for m in out[n]:
                into[m] -= 1
                if not into[m]:
                    later.append(m)
        now, layer = later, layer + 1
    return found if len(found) == len(nodes) else None


def _within(blocks: DataFrame, edges: DataFrame, start: str, direction: Direction, edge_filter: EdgeFilter, max_depth: int) -> DataFrame:
    """(id, depth) of the blocks that start reaches; none if it isn't a block."""
    here = blocks.where(F.col("id") == parse_id(start)).select(F.col("id").alias("start"))
    return reach(edges, here, direction, edge_filter, max_depth, blocks).select("id", "depth")


def topological_sort(blocks, edges, start: str, edge_filter: EdgeFilter = ALL_EDGES, max_depth: int = DEFAULT_DEPTH) -> Traversal:
    """What start reaches by outgoing edges within max_depth, each block after all that point to it (ties by id).

    depth is the place in the order from 0, path the block alone, max_depth_reached the length; empty on a cycle.
    """
    validate(max_depth, 1)
    spark = blocks.sparkSession
    nodes = _within(blocks, edges, start, Direction.OUTGOING, edge_filter, max_depth).select("id")
    near = neighbours(edges, Direction.OUTGOING, edge_filter).select("at", "to")
    small = F.broadcast if few(nodes) else lambda x: x
    inside = near.join(small(nodes.withColumnRenamed("id", "at")), "at", "left_semi").join(small(nodes.withColumnRenamed("id", "to")), "to", "left_semi")
    # an edge back to the start closes a cycle as well
    layered = topological_layers(nodes, inside)
    if layered is None:
        return Traversal(spark.createDataFrame([], ORDER), 0)
    if few(layered):
        rows = layered.withColumn("rank", F.row_number().over(Window.orderBy("layer", "id")).cast("long"))  # of a bounded number
    else:
        rows = ranked(layered, "layer", "id")
    rows = rows.select("rank", "id", (F.col("rank") - 1).cast("int").alias("depth"), F.array("id").alias("path"))
    return Traversal(rows, rows.count())


def component_of(blocks, edges, start: str, edge_filter: EdgeFilter = ALL_EDGES, max_depth: int = DEFAULT_DEPTH, max_results: int = DEFAULT_RESULTS) -> Traversal:
    """The strong component of start: what it reaches and what reaches it, each way within max_depth; path is the block alone."""
    validate(max_depth, max_results)
    ahead = _within(blocks, edges, start, Direction.OUTGOING, edge_filter, max_depth)
    behind = _within(blocks, edges, start, Direction.INCOMING, edge_filter, max_depth)
    both = ahead.join(behind.select("id"), "id", "left_semi").orderBy("depth", "id").limit(max_results)
    rows = both.withColumn("rank", F.row_number().over(Window.orderBy("depth", "id")).cast("long"))  # at most max_results rows
    rows = checkpointed(rows.select("rank", "id", "depth", F.array("id").alias("path")))
    return Traversal(rows, rows.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("m")).first()["m"])


def strong_components(blocks: DataFrame, edges: DataFrame, edge_filter: EdgeFilter = ALL_EDGES) -> DataFrame:
    """(id, component): the least id of each block's strong component, by forward colouring.

    A round: blocks that no edge enters or none leaves are components of their own; among the rest each block's colour
    is the least id that reaches it; walking back from each colour's own block within the colour gives its component.
    """
    ids = checkpointed(blocks.select("id").distinct())
    near = neighbours(edges, Direction.OUTGOING, edge_filter).select("at", "to").where("at <> to").distinct()
    near = near.join(ids.withColumnRenamed("id", "at"), "at", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")
    pairs, done = checkpointed(near), None
    while not ids.isEmpty():
        inner = ids.join(pairs.select(F.col("at").alias("id")), "id", "left_semi").join(pairs.select(F.col("to").alias("id")), "id", "left_semi")
        inner = checkpointed(inner)
        found = ids.join(inner, "id", "left_anti").select("id", F.col("id").alias("component"))
        core = checkpointed(pairs.join(inner.withColumnRenamed("id", "at"), "at", "left_semi").join(inner.withColumnRenamed("id", "to"), "to", "left_semi"))
        if not inner.isEmpty():
            colour = _spread(inner.select("id", F.col("id").alias("colour")), core)
            same = core.join(colour.select(F.col("id").alias("at"), F.col("colour").alias("c1")), "at").join(colour.select(F.col("id").alias("to"), F.col("colour").alias("c2")), "to").where("c1 = c2")
            back = checkpointed(same.select(F.col("to").alias("at"), F.col("at").alias("to")))
            now = hit = checkpointed(colour.where("id = colour").select("id", F.col("colour").alias("component")))
            while not now.isEmpty():
                step = now.join(back, now["id"] == back["at"]).select(F.col("to").alias("id"), "component").distinct()
                now = checkpointed(step.join(hit.select("id"), "id", "left_anti"))
                hit = checkpointed(hit.unionByName(now))
            found = found.unionByName(hit)
        found = checkpointed(found)
        done = found if done is None else done.unionByName(found)
        ids = checkpointed(ids.join(found.select("id"), "id", "left_anti"))
        pairs = checkpointed(core.join(found.select(F.col("id").alias("at")), "at", "left_anti").join(found.select(F.col("id").alias("to")), "to", "left_anti"))
    return done if done is not None else ids.select("id", F.col("id").alias("component"))


def _spread(colour: DataFrame, pairs: DataFrame) -> DataFrame:
    """The least colour that reaches each node; only nodes whose colour fell pass it on."""
    now = colour
    while not now.isEmpty():
        told = pairs.join(now.select(F.col("id").alias("at"), "colour"), "at").groupBy(F.col("to").alias("id")).agg(F.min("colour").alias("told"))
        both = checkpointed(colour.join(told, "id", "left").select("id", F.least("colour", "told").alias("colour"), (F.col("told") < F.col("colour")).alias("fell")))
        now, colour = both.where("fell").select("id", "colour"), both.select("id", "colour")
    return colour


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree), parallel edges counted; each edge is read once and combined before the shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))
