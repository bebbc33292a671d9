"""The engine: one object over a store or over given blocks and edges, with life cycle, cache and statistics."""

from __future__ import annotations

import itertools
import struct
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..model import Direction, InvalidQuery
from ..operators import filters, lookup, search, traverse
from ..operators.store import Store
from ..sources import wire
from . import formats
from .cache import QueryCache
from .stats import QueryPlan, QueryStatistics, plan_of


PROTOCOL = "trellis 1"


class NotRunning(RuntimeError):
    """Only a running engine answers queries."""


class Engine:
    def __init__(self, store: Store | None = None, blocks: DataFrame | None = None, edges: DataFrame | None = None):
        if store is None and blocks is None:
            raise ValueError("an engine needs a store or blocks")
        self.store, self._blocks, self._edges = store, blocks, edges
        self.state, self.cache, self.stats, self._ids = "initialized", QueryCache(), QueryStatistics(), itertools.count(1)

    def startup(self) -> Engine:
        self.state = "running"
        return self

    def shutdown(self) -> None:
        self.state = "stopped"
        self.cache.clear()

    def __enter__(self) -> Engine:
        return self.startup()

    def __exit__(self, *_) -> None:
        self.shutdown()

    @property
    def blocks(self) -> DataFrame:
        return self._blocks if self._blocks is not None else self.store.blocks()

    @property
    def edges(self) -> DataFrame:
        return self._edges if self._edges is not None else self.store.edges()

    def _version(self) -> tuple:
        return (tuple(self.store.batches()[-1:]), tuple(self.store.snapshots()[-1:])) if self.store else ()

    @contextmanager
    def _asked(self, kind: str):
        if self.state != "running":
            raise NotRunning(self.state)
        began = time.perf_counter_ns()
        try:
            yield next(self._ids)
        finally:  # failed queries count as well
            self.stats.record(kind, time.perf_counter_ns() - began)

    def reset_statistics(self) -> None:
        self.stats = QueryStatistics()

    def find_block(self, id_: str) -> DataFrame:
        with self._asked("find_blocks"):
            return lookup.find_block(self.blocks, id_)

    def find_blocks(self, ids: list[str]) -> DataFrame:
        with self._asked("find_blocks"):
            return lookup.find_blocks(self.blocks, ids)

    def block_exists(self, id_: str) -> bool:
        with self._asked("find_blocks"):
            return lookup.block_exists(self.blocks, id_)

    def filter(self, where: filters.Expression, **kw) -> filters.FilteredResult:
        with self._asked("filtered"):
            return filters.filter_blocks(self.blocks, where, **kw)

    def search(self, query: str, **kw) -> DataFrame:
        with self._asked("semantic"):
            return search.keyword_search(self.blocks, query, **kw)

    def traverse(self, start: str, algorithm=traverse.Algorithm.BREADTH_FIRST, direction=Direction.OUTGOING, edge_filter=traverse.ALL_EDGES, max_depth=traverse.DEFAULT_DEPTH, max_results=traverse.DEFAULT_RESULTS, semantics="contract") -> traverse.Traversal:
        """Results stay in the cache (as checkpointed rows) until the store changes."""
        with self._asked("traversal"):
            key = (start, int(algorithm), int(direction), edge_filter, max_depth, max_results, semantics, self._version())
            if (held := self.cache.get(key)) is None:
                held = traverse.traverse(self.blocks, self.edges, start, algorithm, direction, edge_filter, max_depth, max_results, semantics)
                self.cache.put(key, held)
            return held

    def plan(self, where: filters.Expression, semantics: str = "contract") -> QueryPlan:
        """What Spark means to do for a filter over the blocks."""
        return plan_of(filters.matching(self.blocks, where, semantics))

    def explain(self, where: filters.Expression, semantics: str = "contract") -> None:
        filters.matching(self.blocks, where, semantics).explain("formatted")

    def answer(self, request: dict) -> str:
        """A request by name (find_blocks, filtered_query, traversal, semantic, ping) as text."""
        kind = request.get("type")
        if kind == "ping":
            return "pong"
        if kind == "find_blocks":
            return formats.lookup_text(self.find_blocks(request["ids"]), len(request["ids"]))
        if kind == "filtered_query":
            found = self.filter(request["where"], **request.get("options", {}))
            return formats.filtered_text(found.blocks, found.total_matches, found.has_more)
        if kind == "semantic":
            found = self.search(request["query"], **request.get("options", {}))
            return formats.keyword_text(found, search.total_matches(self.blocks, request["query"], request.get("options", {}).get("threshold", search.DEFAULT_THRESHOLD)))
        if kind == "traversal":
            found = self.traverse(request["start"], **request.get("options", {}))
            rows = found.with_blocks(self.blocks)
            return formats.lookup_text(rows, found.blocks_traversed)
        raise InvalidQuery("InvalidRequest", str(kind))

    def respond(self, raw: bytes) -> bytes:
        """A message of the wire protocol to its response.

        find_blocks: a count and ids of 16 bytes.  traversal_query: the start's id, then, if given, direction and
        algorithm (a byte each), depth and results (4 bytes each).  filtered_query: target and operator (a byte each),
        field and value, each after its length (4 bytes).  Failures become error responses.
        """
        try:
            kind, _, body = wire.decode_message(raw)
            if kind == "ping":
                return wire.encode_message("pong", PROTOCOL.encode())
            if kind == "find_blocks":
                n = int.from_bytes(body[:4], "little")
                if len(body) != 4 + 16 * n:
                    raise ValueError("InvalidRequest")
                found = self.find_blocks([body[4 + 16 * i : 20 + 16 * i].hex() for i in range(n)])
                return wire.encode_message("blocks_response", wire.block_list(found))
            if kind == "traversal_query":
                more = struct.unpack_from("<BBII", body, 16) if len(body) > 16 else (Direction.OUTGOING, traverse.Algorithm.BREADTH_FIRST, traverse.DEFAULT_DEPTH, traverse.DEFAULT_RESULTS)
                found = self.traverse(body[:16].hex(), traverse.Algorithm(more[1]), Direction(more[0]), max_depth=more[2], max_results=more[3])
                return wire.encode_message("traversal_response", wire.block_list(found.with_blocks(self.blocks)))
            if kind == "filtered_query":
                n = int.from_bytes(body[2:6], "little")
                field, value = body[6 : 6 + n].decode(), body[10 + n :].decode()
                where = filters.Condition(filters.decode(filters.Target, body[0]), filters.decode(filters.Operator, body[1]), value, field or None)
                return wire.encode_message("filtered_response", wire.block_list(self.filter(where).blocks))
            raise ValueError("InvalidRequest")
        except (ValueError, IndexError, struct.error) as x:
            return wire.encode_message("error_response", str(x).encode())
