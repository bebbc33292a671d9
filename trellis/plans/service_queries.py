"""Queries about the engine's services, over the driver's tables: store, result handling, ingestion, protocol, statistics.

Each has DuckDB SQL that gives the same rows.  Stores are made in the folder that all executors share.
"""

from __future__ import annotations

import contextlib
import io
import shlex
import uuid

from pyspark.sql import functions as F

from ..functions.text import content_type
from ..model import Direction, EdgeType, InvalidQuery, parse_id, shared_folder
from ..operators import analytics, filters, ingest, search, store, traverse
from ..operators.filters import Operator as Op
from ..operators.store import Store
from ..operators.traverse import EdgeFilter
from ..sources import files, wire
from ..sources import tables as t
from . import formats, stats
from .cache import QueryCache
from .engine import Engine, NotRunning
from .queries import _bfs, _bsql, _dfs, _esql, _near, _order, _ORDER_SQL, _shown, _sources, _SRC, _typed, ORDER_1, REGION_1

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _new(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _rows(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def _code(f, *args, **kw) -> str:
    """The error a call raises; empty without."""
    try:
        f(*args, **kw)
    except InvalidQuery as x:
        return x.code
    except NotRunning:
        return "NotRunning"
    return ""


_NATIONS = _bsql("nation")
_NATION_EDGES = _esql("nation_region")
_SOME = "cast(('0x' || right(id, 8)) as bigint)"


def _filled(spark, d) -> Store:
    """Nations and their edges; every third one put again with version 2; every fifth deleted; nation 7 put again after that."""
    s = _new(spark)
    b = t.blocks(spark, d, "nation")
    key = F.conv(F.substring("id", -8, 8), 16, 10).cast("long")
    s.put_blocks(b)
    s.put_edges(t.edges(spark, d, "nation_region"))
    s.put_blocks(b.where(key % 3 == 0).withColumn("version", F.lit(2).cast("long")).withColumn("content", F.concat("content", F.lit("!"))))
    s.delete_blocks(b.where(key % 5 == 0))
    s.put_blocks(b.where(key == 10))
    return s


_LEFT = f"{_NATIONS}, now as (select id, case when k % 3 = 0 and k <> 10 then 2 else 1 end as version, source_uri, content || case when k % 3 = 0 and k <> 10 then '!' else '' end as content from (select *, {_SOME} as k from b) where k % 5 <> 0 or k = 10)"


@query(f"with {_LEFT} select * from now")
def store_state(spark, d):
    """Blocks after puts, updates and deletes, in order of arrival."""
    return _filled(spark, d).blocks().select("id", "version", "source_uri", "content")


@query(f"with {_NATION_EDGES} select s as source_id, d as target_id, k as edge_type from e where cast(('0x' || right(s, 8)) as bigint) % 5 <> 0")
def store_edges(spark, d):
    """Edges of deleted blocks are gone, also where a block came back."""
    return _filled(spark, d).edges().select("source_id", "target_id", "edge_type")


@query(f"with {_LEFT} select * from now")
def store_snapshot(spark, d):
    """The same after compaction, read from the snapshot alone."""
    s = _filled(spark, d)
    return spark.read.parquet(f"{s.path}/snapshot/{s.compact()}/blocks").select("id", "version", "source_uri", "content")


@query(f"with {_LEFT} select * from now where {_SOME} <> 4 union all select id, 9, source_uri, 'late' from b where {_SOME} = 5")
def store_log_after_snapshot(spark, d):
    """Puts and deletes after a compaction and a vacuum, over the snapshot; read by another store object on the folder."""
    s = _filled(spark, d)
    s.compact()
    s.vacuum()
    b, key = t.blocks(spark, d, "nation"), F.conv(F.substring("id", -8, 8), 16, 10).cast("long")
    s.delete_blocks(b.where(key == 4))
    s.put_blocks(b.where(key == 5).withColumn("version", F.lit(9).cast("long")).withColumn("content", F.lit("late")))
    return Store(spark, s.path).blocks().select("id", "version", "source_uri", "content")


@query(f"with {_LEFT} select id, case when k % 3 = 0 then 2 else 1 end as version from (select id, {_SOME} as k from now)")
def store_max_version(spark, d):
    """Compaction that keeps the highest version: of nation 10, which came back, the one before its delete counts as well."""
    s = _filled(spark, d)
    return spark.read.parquet(f"{s.path}/snapshot/{s.compact('max_version')}/blocks").select("id", "version")


@query(f"with {_LEFT} select id, version, content from now where id = '{t.NATION}{6:030x}'")
def store_point_read(spark, d):
    s = _filled(spark, d)
    s.compact()
    return s.blocks().where(F.col("id") == f"{t.NATION}{6:030x}").select("id", "version", "content")


@query("select cast(5 as bigint) as batches, cast(2 * count(*) + count_if(n_nationkey % 3 = 0) + count_if(n_nationkey % 5 = 0) + 1 as bigint) as rows from nation")
def store_log_files(spark, d):
    s = _filled(spark, d)
    return s.files().agg(F.lit(len(s.batches())).cast("long").alias("batches"), F.sum("rows").alias("rows"))


@query(f"with {_NATION_EDGES} select s as source_id, d as target_id from e where k = 2 and cast(('0x' || right(s, 8)) as bigint) % 2 = 1")
def store_removed_edges(spark, d):
    s = _new(spark)
    e = t.edges(spark, d, "nation_region")
    s.put_edges(e)
    s.delete_edges(e.where(F.conv(F.substring("source_id", -8, 8), 16, 10).cast("long") % 2 == 0))
    return s.edges().select("source_id", "target_id")


@query("select error, n from (select case n_nationkey % 4 when 0 then 'InvalidVersion' when 1 then 'EmptyContent' when 2 then 'InvalidMetadata' end as error, count(*) as n from nation group by 1) where error is not null union all select 'SelfEdge', count(*) from nation")
def store_rejected(spark, d):
    """What the store doesn't take, by rule."""
    s, k = _new(spark), F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 4
    b = t.blocks(spark, d, "nation")
    b = b.withColumn("version", F.when(k == 0, 0).otherwise(F.col("version")).cast("long")).withColumn("content", F.when(k == 1, "").otherwise(F.col("content"))).withColumn("metadata_json", F.when(k == 2, "{").otherwise(F.col("metadata_json")))
    e = t.edges(spark, d, "nation_region").withColumn("target_id", F.col("source_id"))
    bad = s.put_blocks(b, for_ingestion=True).select("error").unionByName(s.put_edges(e).select("error"))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


_COUNTED = "select * from (select cast(count(*) + count_if(n_nationkey % 3 = 0) + 1 as bigint) as blocks_written, count_if(n_nationkey % 5 = 0) as blocks_deleted, count(*) as edges_added, cast(2 * count(*) + count_if(n_nationkey % 3 = 0) + count_if(n_nationkey % 5 = 0) + 1 as bigint) as wal_writes, cast(5 as bigint) as wal_flushes from nation) unpivot (n for name in (blocks_written, blocks_deleted, edges_added, wal_writes, wal_flushes))"
_NAMES = ("blocks_written", "blocks_deleted", "edges_added", "wal_writes", "wal_flushes")


@query(_COUNTED)
def store_counters(spark, d):
    m = _filled(spark, d).metrics
    return _rows(spark, [(n, m[n]) for n in _NAMES], "name string, n long")


@query(f"select 'trellis_' || name || '_total ' || n as line from ({_COUNTED}) union all select 'trellis_up 1'")
def prometheus_lines(spark, d):
    m = _filled(spark, d).metrics
    text = formats.prometheus({n: m[n] for n in _NAMES})
    return _rows(spark, [(x,) for x in text.splitlines() if not x.startswith("#")], "line string")


@query("select * from (values (3, false, 'none'), (5, true, 'none'), (8, true, 'stall'), (12, true, 'block')) v(batches, due, throttle)")
def store_tiers(spark, d):
    """When a log is due for compaction and writers should wait; the second is that of a store."""
    real = _filled(spark, d).tier()
    tiers = [store.Tier(3, 0, 0), real, store.Tier(8, 0, 0), store.Tier(12, 0, 0)]
    return _rows(spark, [(x.batches, x.due, x.throttle) for x in tiers], "batches int, due boolean, throttle string")


@query("select cast(0 as bigint) as batches, cast(1 as bigint) as snapshots, count(*) as blocks from nation where n_nationkey % 5 <> 0 or n_nationkey = 10")
def store_vacuumed(spark, d):
    s = _filled(spark, d)
    s.compact_if_due()
    s.vacuum()
    return _rows(spark, [(len(s.batches()), len(s.snapshots()), s.blocks().count())], "batches long, snapshots long, blocks long")


@query("select error, count(*) as n from (select case event_id % 5 when 0 then 'InvalidOperation' when 1 then 'InvalidBlockId' end as error from events) group by 1")
def log_quarantine(spark, d):
    """Entries of a log with unknown operations or without ids are told apart from those to replay."""
    ops = t.event_ops(spark, d)
    k, none = F.col("seq") % 5, F.lit(None).cast("string")
    ops = ops.withColumn("version", F.greatest("version", F.lit(1))).withColumn("op", F.when(k == 0, 9).otherwise(F.col("op")).cast("short")).withColumn("id", F.when(k == 1, none).otherwise(F.col("id")))
    good, bad = store.valid_ops(ops)
    return good.select(none.alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@query("select * from (values ('short run', false, false), ('six of a hundred', true, false), ('four in a row', false, true)) v(name, elevated, systematic)")
def corruption_levels(spark, d):
    out = []
    for name, seen in (("short run", [False, True] * 3), ("six of a hundred", ([False] + [True] * 15) * 6 + [True] * 4), ("four in a row", [False] * 4)):
        c = stats.CorruptionTracker()
        for ok in seen:
            c.record(ok)
        out.append((name, c.is_elevated(), c.is_systematic()))
    return _rows(spark, out, "name string, elevated boolean, systematic boolean")


@query("select n_name as name, n_name as back from nation")
def log_entry_codec(spark, d):
    """Entries of the log's wire format, there and back."""
    names = [r.n_name for r in t.table(spark, d, "nation").select("n_name").toLocalIterator()]
    return _rows(spark, [(n, wire.decode_entry(wire.encode_entry("put_block", n.encode()))[1].decode()) for n in names], "name string, back string")


# --- results ----------------------------------------------------------------------------------------------------------

_ASKED = [f"{t.NATION}{k:030x}" for k in (3, 1, 3, 99)]


@query("select cast(4 as bigint) as requested, cast(3 as bigint) as found, cast(1 as bigint) as single, 'EmptyQuery' as without, 'TooManyIds' as too_many")
def find_blocks_counts(spark, d):
    """A batch lookup knows how many ids were asked for; ids asked for twice come twice."""
    with Engine(blocks=t.blocks(spark, d, "nation")) as e:
        found = e.find_blocks(_ASKED)
        return _rows(spark, [(len(_ASKED), found.count(), e.find_block(_ASKED[0]).count(), _code(e.find_blocks, []), _code(e.find_blocks, _ASKED * 300))], "requested long, found long, single long, without string, too_many string")


@query(f"with {_bsql('nation')}, m as (select row_number() over (order by id) as nth, id from b where {_typed('type')} = 'nation' order by id limit 5) select p as pass, nth, id from m, (values (1), (2)) v(p)")
def result_iterated_twice(spark, d):
    """A result is iterated row by row, stops at its limit, and can be started again."""
    found = filters.with_metadata(t.blocks(spark, d, "nation"), "type", "nation", max_results=5)
    return _rows(spark, [(p, n, r.id) for p in (1, 2) for n, r in enumerate(found, 1)], "pass int, nth long, id string")


@query(f"with {_bsql('orders')} select count(*) as scanned, count_if({_typed('status')} = 'O') as matched, cast(least(greatest(count_if({_typed('status')} = 'O') - 10, 0), 20) as bigint) as returned, count_if({_typed('status')} = 'O') <= 30 as finished from b")
def filter_statistics(spark, d):
    s = filters.filter_blocks(t.blocks(spark, d, "orders"), filters.metadata("status", Op.EQUAL, "O"), 20, 10).stats()
    return _rows(spark, [(s.scanned, s.matched, s.returned, s.finished)], "scanned long, matched long, returned long, finished boolean")


@query(f"with {_bsql('customer')} select id from b where {_typed('segment')} = 'BUILDING' and content < 'Customer#000000100'")
def filter_by_index(spark, d):
    b = t.blocks(spark, d, "customer")
    return analytics.filter_by_index(b, analytics.metadata_index(b, "segment"), "BUILDING", filters.content(Op.LESS, "Customer#000000100")).select("id")


@query(f"with {_bsql('nation')} select 'content' as how, id from b where contains(content, 'N_2') union all select 'uri', id from b where source_uri = 'tpch://nation/3' union all select 'metadata', id from b where {_typed('type')} = 'nation'")
def filter_helpers(spark, d):
    b = t.blocks(spark, d, "nation")
    got = {"content": filters.contains_text(b, "N_2"), "uri": filters.with_source_uri(b, "tpch://nation/3"), "metadata": filters.with_metadata(b, "type", "nation")}
    out = None
    for how, r in got.items():
        one = r.blocks.select(F.lit(how).alias("how"), "id")
        out = one if out is None else out.unionByName(one)
    return out


@query("select cast(i as int) as code, coalesce(['CONTENT', 'SOURCE_URI', 'METADATA_FIELD', 'VERSION', 'CONTENT_LENGTH'][i], 'InvalidFilter') as target, coalesce(['EQUAL', 'NOT_EQUAL', 'GREATER', 'GREATER_EQUAL', 'LESS', 'LESS_EQUAL', 'CONTAINS', 'STARTS_WITH', 'ENDS_WITH'][i], 'InvalidFilter') as operator from range(0, 12) r(i)")
def filter_codes(spark, d):
    name = lambda kind, c: _code(filters.decode, kind, c) or filters.decode(kind, c).name
    return _rows(spark, [(c, name(filters.Target, c), name(filters.Operator, c)) for c in range(12)], "code int, target string, operator string")


@query(f"with {_bsql('part')} select id from b where try_cast({_typed('size')} as double) < 3 order by id limit 40")
def engine_filter(spark, d):
    with Engine(blocks=t.blocks(spark, d, "part")) as e:
        return e.filter(filters.metadata("size", Op.LESS, "3"), max_results=40).blocks.select("id")


@query(f"with {_bsql('nation')}, s as (select id, (cast(contains(content, '1') as int) + cast(contains(content, '2') as int)) / 2.0 as score from b) select id, cast(score as double) as score from s where score >= 0.5 order by score desc, id limit 7")
def engine_search(spark, d):
    with Engine(blocks=t.blocks(spark, d, "nation")) as e:
        return e.search("1 2", max_results=7, threshold=0.5).select("id", F.col("score").cast("double").alias("score"))


@query("select text, most, cast(threshold as double) as threshold, code from (values ('', 10, 0.5, 'EmptyQuery'), ('a', 0, 0.5, 'ResultsLimitExceeded'), ('a', 501, 0.5, 'ResultsLimitExceeded'), ('a', 1, 1.5, 'InvalidThreshold'), ('a', 500, 1.0, '')) v(text, most, threshold, code)")
def search_validation(spark, d):
    asked = [("", 10, 0.5), ("a", 0, 0.5), ("a", 501, 0.5), ("a", 1, 1.5), ("a", 500, 1.0)]
    return _rows(spark, [(*a, _code(search.validate, *a)) for a in asked], "text string, most int, threshold double, code string")


# --- traversals -------------------------------------------------------------------------------------------------------

_WAYS = {"outgoing": (1, traverse.traverse_outgoing), "incoming": (2, traverse.traverse_incoming), "both": (3, traverse.traverse_bidirectional)}
_NATION_1 = f"{t.NATION}{1:030x}"
_NR = f"{_bsql('region', 'nation')}, {_NATION_EDGES}"


@query(" union all ".join(f"select '{w}' as way, * from ({_bfs(_NR, _near(k), _NATION_1, 2, 1000)})" for w, (k, _) in _WAYS.items()))
def traverse_ways(spark, d):
    b, e = t.blocks(spark, d, "region", "nation"), t.edges(spark, d, "nation_region")
    out = None
    for way, (_, f) in _WAYS.items():
        one = _shown(f(b, e, _NATION_1, 2)).withColumn("way", F.lit(way))
        out = one if out is None else out.unionByName(one)
    return out


@query(_bfs(_ORDER_SQL, _near(1), ORDER_1, 2, 1000))
def traverse_astar_outgoing(spark, d):
    return _shown(traverse.traverse_astar(*_order(spark, d), ORDER_1, 2))


@query(_dfs(_NR, _near(2), REGION_1, 1, 1000))
def traverse_by_number(spark, d):
    """The dispatcher with the algorithm's number."""
    b, e = t.blocks(spark, d, "region", "nation"), t.edges(spark, d, "nation_region")
    return _shown(traverse.traverse(b, e, REGION_1, traverse.Algorithm(2), Direction(2), max_depth=1))


@query("select * from (values (0, 10, 'InvalidDepth'), (101, 10, 'InvalidDepth'), (1, 0, 'InvalidMaxResults'), (1, 10001, 'InvalidMaxResults'), (100, 10000, '')) v(depth, most, code)")
def traverse_validation(spark, d):
    return _rows(spark, [(a, b, _code(traverse.validate, a, b)) for a, b in ((0, 10), (101, 10), (1, 0), (1, 10001), (100, 10000))], "depth int, most int, code string")


@query(f"with {_NATION_EDGES} select cast(1 + count(*) as bigint) as blocks_traversed, 1 as max_depth_reached, false as is_empty, cast(1 + count(*) as bigint) as with_blocks from e where d = '{REGION_1}'")
def traversal_summary(spark, d):
    b, e = t.blocks(spark, d, "region", "nation"), t.edges(spark, d, "nation_region")
    found = traverse.breadth_first(b, e, REGION_1, Direction.INCOMING, max_depth=1)
    return found.summary().withColumn("is_empty", F.lit(found.is_empty())).withColumn("with_blocks", F.lit(found.with_blocks(b).count()).cast("long"))


@query("select cast(2 as bigint) as hits, cast(2 as bigint) as misses, cast(2 as bigint) as entries, cast(4 as bigint) as asked, true as same")
def engine_cached_traversal(spark, d):
    """Equal traversals are answered from the cache, whose key has the limits."""
    with Engine(blocks=t.blocks(spark, d, "region", "nation"), edges=t.edges(spark, d, "nation_region")) as e:
        a, b, c, f = (e.traverse(REGION_1, direction=Direction.INCOMING, max_depth=1, max_results=n) for n in (10, 10, 5, 10))
        s = e.cache.statistics()
        return _rows(spark, [(s.hits, s.misses, s.current_entries, e.stats.by_kind["traversal"], a is b and a is f and a is not c)], "hits long, misses long, entries long, asked long, same boolean")


@query("select true as order_free, false as other_mode, false as other_types")
def edge_filter_keys(spark, d):
    """Filters as parts of cache keys."""
    a, b = EdgeFilter.include([EdgeType.CALLS, EdgeType.IMPORTS]), EdgeFilter.include([EdgeType.IMPORTS, EdgeType.CALLS, EdgeType.CALLS])
    return _rows(spark, [(a == b and hash(a) == hash(b), a == EdgeFilter.exclude([EdgeType.CALLS, EdgeType.IMPORTS]), a == EdgeFilter.only(EdgeType.CALLS))], "order_free boolean, other_mode boolean, other_types boolean")


# --- ingestion --------------------------------------------------------------------------------------------------------


class _Given:
    """A source of rows that are there, or one that fails."""

    def __init__(self, rows):
        self.rows = rows

    def read(self, spark):
        if self.rows is None:
            raise OSError("no such repository")
        return self.rows


@query(
    f"with {_SRC}, u as (select count_if(regexp_matches(x, 'fn .*?\\(')) + count_if(contains(line, 'struct {{')) + count_if(contains(line, 'const ') and contains(line, ' = ') and not contains(line, '@import')) + count_if(contains(line, 'test ')) + count_if(starts_with(x, 'const std')) as n from tr) "
    "select cast(2 as bigint) as sources_processed, cast(1 as bigint) as sources_failed, (select count(*) from supplier) as texts_parsed, (select count(*) from region) as texts_skipped, cast(n as bigint) as units_parsed, cast(n as bigint) as blocks_created, (select cast(count(*) + count_if(s_suppkey % 2 = 0) + count_if(s_suppkey + 2 <= (select max(s_suppkey) from supplier)) as bigint) from supplier) as edges_created from u"
)
def ingest_report(spark, d):
    """Three sources: texts that are parsed, one that fails and is counted, texts that no parser supports."""
    other = t.table(spark, d, "region").select(F.col("r_name").alias("data"), F.lit("text/plain").alias("content_type"), F.create_map(F.lit("file_path"), F.lit("a.txt")).alias("metadata"), F.lit(0).cast("long").alias("timestamp_ns"))
    r = ingest.ingest(spark, _new(spark), [_Given(_sources(spark, d)), _Given(None), _Given(other)])
    return _rows(spark, [(r.sources_processed, r.sources_failed, r.texts_parsed, r.texts_skipped, r.units_parsed, r.blocks_created, r.edges_created)], "sources_processed long, sources_failed long, texts_parsed long, texts_skipped long, units_parsed long, blocks_created long, edges_created long")


@query(
    "with p as (select distinct p_size as size, greatest(p_size / 50.0, (p_size % 11) / 10.0) as ratio from part), l as (select size, case when ratio > 0.8 then 'high' when ratio > 0.5 then 'medium' else 'low' end as level from p) "
    "select size, level, cast(case level when 'low' then 32 when 'medium' then 16 else 1 end as int) as batch from l"
)
def pressure_levels(spark, d):
    """Levels of memory pressure and how many files are taken at once."""
    sizes = [r.p_size for r in t.table(spark, d, "part").select("p_size").distinct().toLocalIterator()]
    level = lambda n: ingest.memory_pressure(n * 1000, n % 11, 50_000, 10)
    return _rows(spark, [(n, level(n), ingest.batch_size(level(n))) for n in sizes], "size int, level string, batch int")


@query(f"with {_SRC} select 'unknown.zig' as file, count(*) as n from tr where regexp_matches(x, 'fn .*?\\(')")
def literal_paths(spark, d):
    """In the literal reading, units have no file's name, as sources name it otherwise."""
    units = ingest.parse_units(_sources(spark, d), semantics="literal").where("unit_type = 'function'")
    return units.groupBy(F.col("location.file_path").alias("file")).agg(F.count("*").alias("n"))


@query("select path, ends_with(path, '.zig') or kind in ('text/zig', 'text/x-zig', 'application/x-zig') as supported from (select 'd' || doc_id || case when doc_id % 2 = 0 then '.zig' else '.md' end as path, ['text/zig', 'text/plain', 'application/x-zig'][1 + doc_id % 3] as kind from documents)")
def supported_sources(spark, d):
    i = F.col("doc_id")
    path = F.concat(F.lit("d"), i.cast("string"), F.when(i % 2 == 0, ".zig").otherwise(".md"))
    kind = F.element_at(F.array(F.lit("text/zig"), F.lit("text/plain"), F.lit("application/x-zig")), (1 + i % 3).cast("int"))
    return t.table(spark, d, "documents").select(path.alias("path"), ingest.supports(kind, path).alias("supported"))


@query(f"with {_SRC} select repository, file || ':' || trim(regexp_extract(x, 'fn (.*?)\\(', 1)) as id from tr where regexp_matches(x, 'fn .*?\\(') and starts_with(x, 'pub ')")
def public_functions(spark, d):
    units = ingest.parse_units(_sources(spark, d), ingest.ParserConfig(include_tests=False, include_private=False))
    return units.where("unit_type = 'function'").select("repository", "id")


@query(
    f"with {_SRC}, f as (select *, file || ':' || trim(regexp_extract(x, 'fn (.*?)\\(', 1)) as unit_id from tr where regexp_matches(x, 'fn .*?\\(')) "
    "select substr(sha256('unit_' || repository || chr(10) || file || '_function_' || unit_id || '_' || no || '_1'), 1, 32) as id, 'file://' || file || '#L' || no || '-' || no as source_uri, x as content from f"
)
def chunked_functions(spark, d):
    blocks = ingest.chunk(ingest.units_with_edges(_sources(spark, d)))
    return blocks.where(F.contains("metadata_json", F.lit('"unit_type":"function"'))).select("id", "source_uri", "content")


@query("select path, case when ends_with(path, '.zig') then 'text/zig' when ends_with(path, '.md') then 'text/markdown' when ends_with(path, '.hpp') then 'text/cpp' when ends_with(path, '.yml') then 'application/yaml' else 'text/plain' end as kind from (select 'f' || doc_id || ['.zig', '.md', '.hpp', '.yml', '', '.unknown'][1 + doc_id % 6] as path from documents)")
def content_types(spark, d):
    end = F.element_at(F.array(*map(F.lit, (".zig", ".md", ".hpp", ".yml", "", ".unknown"))), (1 + F.col("doc_id") % 6).cast("int"))
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), end)
    return t.table(spark, d, "documents").select(path.alias("path"), content_type(path).alias("kind"))


@query("select 'src/' || lower(n_name) || '.zig' as path, 'text/zig' as kind, 'fn ' || n_name as data, 'main' as branch, 'c0ffee' as commit_hash from nation where n_nationkey % 2 = 0 order by 1")
def source_tree(spark, d):
    """Files of a tree with what version control says: odd nations' files are of a kind that is left out."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put(path: str, text: str) -> None:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{path}"), True)
        out.write(bytearray(text.encode()))
        out.close()

    put(".git/HEAD", "ref: refs/heads/main\n")
    put(".git/refs/heads/main", "c0ffee\n")
    for r in t.table(spark, d, "nation").toLocalIterator():
        put(f"src/{r.n_name.lower()}.{'bin' if r.n_nationkey % 2 else 'zig'}", f"fn {r.n_name}")
    m = F.col("metadata")
    return files.read_tree(spark, files.TreeConfig(root)).select(m["file_path"].alias("path"), F.col("content_type").alias("kind"), "data", m["branch"].alias("branch"), m["commit_hash"].alias("commit_hash"))


# --- formats, protocol, control ---------------------------------------------------------------------------------------

_MARK = ("--- BEGIN CONTEXT BLOCK ---", "--- END CONTEXT BLOCK ---")
_BODY = "'Block ' || i || ' (ID: ' || id || {s} || '):' || chr(10) || 'Source: ' || source_uri || chr(10) || 'Version: ' || version || chr(10) || {m} || 'Content: ' || content || chr(10)"
_META = "'Metadata: ' || metadata_json || chr(10)"
_WRAP = f"'{_MARK[0]}' || chr(10) || {{b}} || '{_MARK[1]}' || chr(10) || chr(10)"
_FIRST = f"with {_bsql('nation')}, f as (select row_number() over (order by id) as i, * from b where {_SOME} < 3)"


@query(f"{_FIRST} select 'Retrieved 3 blocks:' || chr(10) || chr(10) || string_agg({_WRAP.format(b=_BODY.format(s=chr(39) * 2, m=_META))}, '' order by i) as text from f")
def text_of_lookup(spark, d):
    with Engine(blocks=t.blocks(spark, d, "nation")) as e:
        return _rows(spark, [(e.answer({"type": "find_blocks", "ids": [f"{t.NATION}{k:030x}" for k in range(3)]}),)], "text string")


@query(
    f"with {_bsql('nation')}, m as (select *, count(*) over () as n from b where contains(content, 'N_1')), f as (select row_number() over (order by id) as i, * from m order by id limit 2) "
    f"select 'Found ' || max(n) || ' semantically similar blocks:' || chr(10) || chr(10) || string_agg({_WRAP.format(b=_BODY.format(s=chr(39) + ', Similarity: 1.000' + chr(39), m=_META))}, '' order by i) as text from f"
)
def text_of_search(spark, d):
    with Engine(blocks=t.blocks(spark, d, "nation")) as e:
        return _rows(spark, [(e.answer({"type": "semantic", "query": "N_1", "options": {"max_results": 2}}),)], "text string")


@query(
    f"with {_bsql('nation')}, m as (select *, count(*) over () as n from b where contains(content, 'N_1')), f as (select row_number() over (order by id) as i, * from m order by id limit 2) "
    f"select 'Found ' || max(n) || ' matching blocks (showing first 2):' || chr(10) || chr(10) || string_agg({_BODY.format(s=chr(39) * 2, m=chr(39) * 2)} || chr(10), '' order by i) as text from f"
)
def text_of_filter(spark, d):
    with Engine(blocks=t.blocks(spark, d, "nation")) as e:
        return _rows(spark, [(e.answer({"type": "filtered_query", "where": filters.content(Op.CONTAINS, "N_1"), "options": {"max_results": 2}}),)], "text string")


@query("select * from (values ('ping', '0101000000000000'), ('find_blocks', '02010000020000006162'), ('filtered_query', '03010000020000006162'), ('traversal_query', '04010000020000006162'), ('error_response', 'ff010000020000006162')) v(kind, message)")
def wire_messages(spark, d):
    """Messages with their header, which decode to what they were made of."""
    made = [("ping", b""), *((k, b"ab") for k in ("find_blocks", "filtered_query", "traversal_query", "error_response"))]
    return _rows(spark, [(k, wire.encode_message(k, x).hex()) for k, x in made if wire.decode_message(wire.encode_message(k, x)) == (k, 1, x)], "kind string, message string")


def _le(n: str, size: int) -> str:
    """A number below 65536, the lowest byte first."""
    return f"(substr(lpad(lower(to_hex({n})), 4, '0'), 3, 2) || substr(lpad(lower(to_hex({n})), 4, '0'), 1, 2) || '{'00' * (size - 2)}')"


_TEXT_HEX = lambda c: f"{_le(f'strlen({c})', 4)} || lower(hex({c}))"
_ITEM = f"id || {_TEXT_HEX('source_uri')} || {_TEXT_HEX('metadata_json')} || {_TEXT_HEX('content')}"
_RESPONSE = f"select '{{name}}' as name, '{{code}}010000' || {_le('4 + sum(strlen(item)) // 2', 4)} || {_le('count(*)', 4)} || string_agg(item, '' order by i) as response from (select {_ITEM} as item, i from ({{rows}}))"
_PICK = {
    "blocks": ("82", f"select *, {_SOME} as i from b where {_SOME} in (1, 2)"), "filtered": ("83", f"select *, {_SOME} as i from b where contains(content, 'N_1')"),
    "traversal": ("84", f"select b.*, case when b.id = '{REGION_1}' then -1 else {_SOME.replace('id', 'b.id')} end as i from b where b.id = '{REGION_1}' or b.id in (select s from e where d = '{REGION_1}')"),
}


@query(
    f"with {_bsql('region', 'nation')}, {_NATION_EDGES}, x as (" + " union all ".join(_RESPONSE.format(name=n, code=c, rows=r.replace("from b where", "from (select * from b where source_uri like 'tpch://nation%') b where") if n != "traversal" else r) for n, (c, r) in _PICK.items())
    + ") select * from x union all select 'ping', '8101000009000000' || lower(hex('trellis 1')) union all select 'bad', 'ff0100000e000000' || lower(hex('InvalidRequest'))"
)
def wire_responses(spark, d):
    """What the engine answers to messages: blocks by id, by a filter, by a traversal; ping; a broken message."""
    nations, both, edges = t.blocks(spark, d, "nation"), t.blocks(spark, d, "region", "nation"), t.edges(spark, d, "nation_region")
    ids = bytes.fromhex(f"{t.NATION}{1:030x}{t.NATION}{2:030x}")
    size = lambda n: n.to_bytes(4, "little")
    with Engine(blocks=nations) as e, Engine(blocks=both, edges=edges) as g:
        ask = lambda engine, kind, body=b"": engine.respond(wire.encode_message(kind, body)).hex()
        rows = [
            ("blocks", ask(e, "find_blocks", size(2) + ids)), ("filtered", ask(e, "filtered_query", bytes([1, 7]) + size(0) + size(3) + b"N_1")),
            ("traversal", ask(g, "traversal_query", bytes.fromhex(REGION_1) + bytes([2, 1]) + size(1) + size(100))), ("ping", ask(e, "ping")), ("bad", e.respond(b"junk").hex()),
        ]
    return _rows(spark, rows, "name string, response string")


def _printed(spark, *lines: str) -> list[tuple[str, str]]:
    from .cli import main

    out = []
    for line in lines:
        with contextlib.redirect_stdout(io.StringIO()) as said:
            main(shlex.split(line), spark)
        out += [(line.split()[2], x) for x in said.getvalue().splitlines()]
    return out


@query("select 'version' as command, 'trellis 0.1.0' as line union all select 'list-blocks', " + f"id || ' ' || version || ' ' || source_uri from (with {_LEFT} select * from now order by id limit 6)")
def command_line(spark, d):
    s = _filled(spark, d)
    return _rows(spark, _printed(spark, f"--store {s.path} version", f"--store {s.path} list-blocks --limit 6"), "command string, line string")


@query("select * from (values (1, 'initialized', 'NotRunning'), (2, 'running', ''), (3, 'stopped', 'NotRunning')) v(step, state, code)")
def engine_life_cycle(spark, d):
    e, out = Engine(blocks=t.blocks(spark, d, "region")), []
    for step, go in enumerate((lambda: None, e.startup, e.shutdown), 1):
        go()
        out.append((step, e.state, _code(e.find_block, REGION_1)))
    return _rows(spark, out, "step int, state string, code string")


@query("select kind, n, cast(share as double) as share from (values ('find_blocks', 2, 0.5), ('filtered', 1, 0.25), ('semantic', 1, 0.25), ('after reset', 0, 0.0)) v(kind, n, share)")
def engine_statistics(spark, d):
    """Queries by kind, failed ones too; identifiers count up; a reset starts again."""
    with Engine(blocks=t.blocks(spark, d, "nation")) as e:
        e.find_block(_ASKED[0])
        _code(e.find_blocks, [])
        e.filter(filters.version(Op.EQUAL, 1))
        e.search("A")
        rows = [(k, e.stats.by_kind[k], e.stats.recent_ratio(k)) for k in ("find_blocks", "filtered", "semantic")]
        e.reset_statistics()
        return _rows(spark, [*rows, ("after reset", e.stats.executed, e.stats.recent_ratio("semantic"))], "kind string, n int, share double")


@query("select * from (values ('filled', 8, 2, 1, 2, 0), ('expired', 7, 2, 2, 2, 0), ('invalidated', 0, 2, 2, 2, 1), ('off', 0, 2, 2, 2, 1), ('cleared', 0, 0, 0, 0, 0)) v(step, entries, hits, misses, evictions, invalidations)")
def cache_steps(spark, d):
    """A cache for eight entries: ten are put, two found, one missed; then one is too old; then it is emptied in three ways."""
    now, out = [0.0], []
    c = QueryCache(8, 10, lambda: now[0])
    note = lambda step: out.append((step, (s := c.statistics()).current_entries, s.hits, s.misses, s.evictions, s.invalidations))
    for i in range(10):
        c.put(i, i)
    c.get(9), c.get(8), c.get(0)
    note("filled")
    now[0] = 11.0
    c.get(9)
    note("expired")
    c.invalidate()
    note("invalidated")
    c.enable(False)
    c.put(1, 1)
    note("off")
    c.clear()
    note("cleared")
    return _rows(spark, out, "step string, entries int, hits int, misses int, evictions int, invalidations int")


@query("select name, cast(hit_rate as double) as hit_rate, effective, tuning from (values ('none', 0.0, false, false), ('good', 0.75, true, false), ('thrashing', 0.0, false, true)) v(name, hit_rate, effective, tuning)")
def cache_verdicts(spark, d):
    none, good, bad = QueryCache(4), QueryCache(4), QueryCache(4)
    for i in range(3):
        good.put(i, i)
        good.get(i)
    good.get("missing")
    for i in range(40):
        bad.get(i)
        bad.put(i, i)
    rows = [(n, (s := c.statistics()).hit_rate, s.is_effective(), s.needs_tuning()) for n, c in (("none", none), ("good", good), ("thrashing", bad))]
    return _rows(spark, rows, "name string, hit_rate double, effective boolean, tuning boolean")


@query("select round(avg(s_acctbal), 6) as mean, round(median(s_acctbal), 6) as median, round(stddev_pop(s_acctbal), 6) as deviation, quantile_disc(s_acctbal, 0.95) as p95, quantile_disc(s_acctbal, 0.99) as p99 from (select cast(s_acctbal as double) as s_acctbal from supplier)")
def latency_summary(spark, d):
    s = stats.latency([float(r.s_acctbal) for r in t.table(spark, d, "supplier").select("s_acctbal").toLocalIterator()])
    return _rows(spark, [(round(s.mean, 6), round(s.median, 6), round(s.deviation, 6), s.p95, s.p99)], "mean double, median double, deviation double, p95 double, p99 double")


@query("select * from (values ('0A00000000000000000000000000000F', '0a00000000000000000000000000000f', ''), ('0a', '', 'InvalidBlockId'), ('zz000000000000000000000000000001', '', 'InvalidBlockId'), ('00000000000000000000000000000000', '', 'ZeroBlockId')) v(text, id, code)")
def id_codec(spark, d):
    asked = ("0A00000000000000000000000000000F", "0a", "zz000000000000000000000000000001", "0" * 32)
    return _rows(spark, [(x, "" if (c := _code(parse_id, x)) else parse_id(x), c) for x in asked], "text string, id string, code string")


@query(f"with {_bsql('nation')} select count(*) as n, true as pushed, cast(0 as bigint) as joins from b where source_uri = 'tpch://nation/3'")
def plan_report(spark, d):
    """What Spark means to do for a filter over a store's snapshot: the filter reaches the scan."""
    s = _filled(spark, d)
    s.compact()
    s.vacuum()
    b = spark.read.parquet(f"{s.path}/snapshot/{s.snapshots()[-1]}/blocks")
    with Engine(blocks=b) as e:
        where = filters.source_uri(Op.EQUAL, "tpch://nation/3")
        p = e.plan(where)
        return _rows(spark, [(e.filter(where).total_matches, any("source_uri" in x for x in p.pushed_filters), sum(p.joins.values()))], "n long, pushed boolean, joins long")
