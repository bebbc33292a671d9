"""Traversals over small graphs, against rows worked out by hand and against a plain model on random graphs."""

import random
from collections import deque

import pytest

from trellis.model import Direction, EdgeType, InvalidQuery, numbered_id
from trellis.operators import graph, traverse
from trellis.operators.traverse import EdgeFilter

CALLS, IMPORTS, REFS = EdgeType.CALLS, EdgeType.IMPORTS, EdgeType.REFERENCES
BLOCK_DDL = "id string, version long, source_uri string, metadata_json string, content string"


def n(i: int) -> str:
    return numbered_id(i)


def make(spark, edges, nodes=None, missing=()):
    nodes = sorted((nodes or set()) | {x for e in edges for x in e[:2]})
    b = [(n(i), 1, f"test://block_{i}.zig", '{"type":"test"}', f"block {i}") for i in nodes if i not in missing]
    e = [(n(a), n(z), int(k), seq) for seq, (a, z, k) in enumerate(edges)]
    return spark.createDataFrame(b, BLOCK_DDL).coalesce(1).cache(), spark.createDataFrame(e, "source_id string, target_id string, edge_type short, edge_seq long").coalesce(1).cache()


def number(id_: str) -> int:
    return int.from_bytes(bytes.fromhex(id_), "little") - 1


def shown(t):
    return [(number(r.id), r.depth) for r in sorted(t.rows.collect(), key=lambda r: r["rank"])]


CALL_TREE = [(1, 2, CALLS), (2, 3, CALLS), (2, 4, CALLS), (4, 5, CALLS), (4, 6, CALLS)]
CYCLE = [(1, 2, CALLS), (2, 3, CALLS), (3, 1, CALLS)]
DIAMOND = [(1, 2, CALLS), (1, 3, CALLS), (2, 4, CALLS), (3, 4, CALLS), (4, 2, CALLS)]
MIXED = [(1, 2, CALLS), (1, 3, IMPORTS), (2, 4, CALLS), (2, 5, REFS), (3, 6, IMPORTS)]


def test_call_tree(spark):
    b, e = make(spark, CALL_TREE)
    t = traverse.breadth_first(b, e, n(1), edge_filter=EdgeFilter.include([CALLS]), max_depth=3)
    assert shown(t) == [(1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (6, 3)]
    assert t.max_depth_reached == 3
    paths = {number(r.id): [number(x) for x in r.path] for r in t.rows.collect()}
    assert paths[6] == [1, 2, 4, 6]


def test_cycle_through_the_start_is_the_same_in_both_semantics(spark):
    b, e = make(spark, CYCLE)
    for s in ("contract", "literal"):
        assert shown(traverse.breadth_first(b, e, n(1), max_depth=10, semantics=s)) == [(1, 0), (2, 1), (3, 2)]


def test_diamond(spark):
    b, e = make(spark, DIAMOND)
    assert shown(traverse.breadth_first(b, e, n(1), max_depth=3)) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    walks = shown(traverse.breadth_first(b, e, n(1), max_depth=3, semantics="literal"))
    assert walks == [(1, 0), (2, 1), (3, 1), (4, 2), (4, 2), (2, 3), (2, 3)]


def test_missing_blocks_are_not_followed(spark):
    b, e = make(spark, CALL_TREE, missing={4})
    t = traverse.breadth_first(b, e, n(1), max_depth=3)
    assert shown(t) == [(1, 0), (2, 1), (3, 2)] and t.max_depth_reached == 2
    assert shown(traverse.breadth_first(b, e, n(4), max_depth=3)) == []


def test_edge_filters(spark):
    b, e = make(spark, MIXED)
    go = lambda f: {x for x, _ in shown(traverse.breadth_first(b, e, n(1), edge_filter=f, max_depth=3))}
    assert go(EdgeFilter.only(CALLS)) == {1, 2, 4} and go(EdgeFilter.only(IMPORTS)) == {1, 3, 6}
    assert go(EdgeFilter.include([])) == {1} and go(EdgeFilter.exclude([])) == {1, 2, 3, 4, 5, 6}
    assert go(EdgeFilter.exclude([CALLS, REFS])) == {1, 3, 6}


def test_depth_first_orders(spark):
    tree = [(i, 2 * i + j, CALLS) for i in range(1, 8) for j in (0, 1)]
    b, e = make(spark, tree)
    order = [x for x, _ in shown(traverse.depth_first(b, e, n(1), max_depth=4))]
    assert order == [1, 3, 7, 15, 14, 6, 13, 12, 2, 5, 11, 10, 4, 9, 8]
    b, e = make(spark, [(1, 2, CALLS), (1, 3, CALLS), (3, 4, CALLS), (4, 2, CALLS), (2, 5, CALLS)])
    assert shown(traverse.depth_first(b, e, n(1), max_depth=3)) == [(1, 0), (3, 1), (4, 2), (2, 3)]
    for driver_edges in (100, 0):  # neighbours from one read, and fetched as they are needed
        t = traverse.depth_first(b, e, n(1), max_depth=9, max_results=4, driver_edges=driver_edges)
        assert shown(t) == [(1, 0), (3, 1), (4, 2), (2, 3)]


def test_half_depth(spark):
    b, e = make(spark, [(i, i + 1, CALLS) for i in range(8)])
    assert shown(traverse.bidirectional_search(b, e, n(4), max_depth=1)) == [(4, 0)]
    assert shown(traverse.bidirectional_search(b, e, n(4), max_depth=4)) == [(4, 0), (5, 1), (3, 1), (6, 2), (2, 2)]


def test_result_limit_takes_the_first_in_order(spark):
    b, e = make(spark, CALL_TREE)
    assert shown(traverse.breadth_first(b, e, n(1), max_depth=3, max_results=4)) == [(1, 0), (2, 1), (3, 2), (4, 2)]


def test_topological_sort(spark):
    b, e = make(spark, [*CYCLE, (11, 12, IMPORTS), (11, 13, CALLS), (13, 12, CALLS), (11, 12, CALLS)])
    t = graph.topological_sort(b, e, n(11))
    assert shown(t) == [(11, 0), (13, 1), (12, 2)] and t.max_depth_reached == 3
    assert shown(graph.topological_sort(b, e, n(1))) == []


def test_strong_components(spark):
    b, e = make(spark, [(1, 2, CALLS), (2, 3, CALLS), (3, 2, CALLS), (3, 4, CALLS), (4, 5, CALLS), (5, 4, IMPORTS)], nodes={9})
    found = {}
    for r in graph.strong_components(b, e).collect():
        found.setdefault(r.component, set()).add(number(r.id))
    assert sorted(map(sorted, found.values())) == [[1], [2, 3], [4, 5], [9]]
    assert {x for x, _ in shown(graph.component_of(b, e, n(2)))} == {2, 3}
    assert {x for x, _ in shown(traverse.traverse(b, e, n(2), traverse.Algorithm.STRONGLY_CONNECTED, semantics="literal"))} == {2, 3, 4, 5}


@pytest.mark.parametrize("kw,code", [({"max_depth": 0}, "InvalidDepth"), ({"max_depth": 101}, "InvalidDepth"), ({"max_results": 0}, "InvalidMaxResults"), ({"max_results": 10_001}, "InvalidMaxResults")])
def test_limits(spark, kw, code):
    b, e = make(spark, CYCLE)
    with pytest.raises(InvalidQuery) as x:
        traverse.breadth_first(b, e, n(1), **kw)
    assert x.value.code == code


def model(edges, missing, start, depth, limit, direction, unique):
    """Walks (or first visits) in order, as a plain queue."""
    near = {}
    for a, z, _ in edges if direction != Direction.INCOMING else ():
        near.setdefault(a, []).append(z)
    for a, z, _ in edges if direction != Direction.OUTGOING else ():
        near.setdefault(z, []).append(a)
    out, seen, queue = [], {start}, deque([(start, 0)])
    while queue and len(out) < limit:
        at, d = queue.popleft()
        if at in missing:
            continue
        out.append((at, d))
        if d < depth:
            for to in near.get(at, []):
                if to not in seen:
                    queue.append((to, d + 1))
                    if unique:
                        seen.add(to)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(9), r.randrange(9), CALLS) for _ in range(16)]
    edges = [x for x in edges if x[0] != x[1]]
    missing = {r.randrange(1, 9)}
    b, e = make(spark, edges, nodes=set(range(9)), missing=missing)
    direction, limit = list(Direction)[seed], r.choice([5, 12, 1000])
    for unique in (True, False):
        t = traverse.breadth_first(b, e, n(0), direction, max_depth=3, max_results=limit, semantics="contract" if unique else "literal")
        assert shown(t) == model(edges, missing, 0, 3, limit, direction, unique)


def test_depth_first_is_the_same_read_whole_and_in_parts(spark):
    """Random graphs with missing blocks, parallel edges and limits; depths reached included."""
    r = random.Random(11)
    for case in range(8):
        size = r.randint(3, 9)
        edges = [(r.randint(1, size), r.randint(1, size), CALLS) for _ in range(r.randint(2, 24))]
        edges = [e for e in edges if e[0] != e[1]] or [(1, 2, CALLS)]
        missing = {x for x in range(2, size + 1) if r.random() < 0.3}
        b, e = make(spark, edges, {1}, missing)
        for depth, most in ((1, 1000), (3, 2), (3, 4), (9, 1000)):
            whole, parts = (traverse.depth_first(b, e, n(1), max_depth=depth, max_results=most, driver_edges=k) for k in (10**6, 0))
            assert shown(whole) == shown(parts), (case, depth, most)
            assert whole.max_depth_reached == parts.max_depth_reached, (case, depth, most)


def test_large_steps_give_what_small_ones_give(spark, monkeypatch):
    r = random.Random(12)
    edges = [(r.randint(1, 8), r.randint(1, 8), CALLS) for _ in range(24)]
    b, e = make(spark, [x for x in edges if x[0] != x[1]], {1}, {5, 6})
    want = [(shown(t), t.max_depth_reached) for t in (traverse.breadth_first(b, e, n(1), max_depth=4, max_results=m, semantics=s) for m in (3, 100) for s in ("contract", "literal"))]
    starts = b.select(b.id.alias("start"))
    reached = sorted(map(tuple, traverse.reach(e, starts, max_depth=3, blocks=b).collect()))
    monkeypatch.setattr(traverse, "MAX_STEP", 0)
    monkeypatch.setattr("trellis.model.FEW_ROWS", 0)
    assert [(shown(t), t.max_depth_reached) for t in (traverse.breadth_first(b, e, n(1), max_depth=4, max_results=m, semantics=s) for m in (3, 100) for s in ("contract", "literal"))] == want
    assert sorted(map(tuple, traverse.reach(e, starts, max_depth=3, blocks=b).collect())) == reached
    tree_b, tree_e = make(spark, CALL_TREE)
    large = shown(graph.topological_sort(tree_b, tree_e, n(1)))
    monkeypatch.undo()
    assert shown(graph.topological_sort(tree_b, tree_e, n(1))) == large
