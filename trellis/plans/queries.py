"""The engine's own queries over the driver's tables, each with DuckDB SQL that gives the same rows.

Blocks and edges are made of the tables on both sides by one rule (`sources.tables`).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.globs import matches_glob
from ..model import Direction, EdgeType, block_error, checkpointed
from ..operators import analytics, filters, graph, ingest, lookup, search, store, traverse
from ..operators.filters import Operator as Op
from ..operators.traverse import EdgeFilter
from ..sources import tables as t
from ..sources import wire

REGION_1, NATION_5, ORDER_1 = f"{t.REGION}{1:030x}", f"{t.NATION}{5:030x}", f"{t.ORDERS}{1:030x}"
CLICK = t.EVENT_TYPES + "click".encode().hex().ljust(30, "0")
ORDER_TABLES, ORDER_EDGES = ("orders", "part", "supplier", "nation", "region"), ("order_part", "order_supplier", "supplier_nation", "nation_region")
FK_TABLES, FK_EDGES = ("region", "nation", "customer", "orders"), ("nation_region", "customer_nation", "orders_customer")
FK_TYPES = EdgeFilter.include([EdgeType.DEFINED_IN, EdgeType.DEPENDS_ON])
SOME_IDS = [f"{t.NATION}{k:030x}" for k in (3, 1, 3, 99)]
KEYWORDS = "the and zzz"

_Q: dict = {}
_SQL: dict = {}


def query(sql: str | None):
    def add(f):
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the model -------------------------------------------------------------------------------------------------


def _id(tag: str, key: str) -> str:
    return f"('{tag}' || lpad(lower(to_hex(cast({key} as bigint))), 30, '0'))"


def _label(text: str) -> str:
    return f"('{t.EVENT_TYPES}' || rpad(lower(hex(cast({text} as blob))), 30, '0'))"


_B = {
    "region": f"select {_id(t.REGION, 'r_regionkey')} as id, 1 as version, 'tpch://region/' || r_regionkey as source_uri, '{{\"type\":\"region\"}}' as metadata_json, r_name as content from region",
    "nation": f"select {_id(t.NATION, 'n_nationkey')} as id, 1 as version, 'tpch://nation/' || n_nationkey as source_uri, '{{\"type\":\"nation\"}}' as metadata_json, n_name as content from nation",
    "customer": f"select {_id(t.CUSTOMER, 'c_custkey')} as id, 1 as version, 'tpch://customer/' || c_custkey as source_uri, '{{\"type\":\"customer\",\"segment\":\"' || c_mktsegment || '\"}}' as metadata_json, c_name as content from customer",
    "supplier": f"select {_id(t.SUPPLIER, 's_suppkey')} as id, 1 as version, 'tpch://supplier/' || s_suppkey as source_uri, '{{\"type\":\"supplier\"}}' as metadata_json, s_name as content from supplier",
    "orders": f"select {_id(t.ORDERS, 'o_orderkey')} as id, 1 as version, 'tpch://orders/' || o_orderkey as source_uri, '{{\"type\":\"order\",\"status\":\"' || o_orderstatus || '\",\"priority\":\"' || o_orderpriority || '\"}}' as metadata_json, o_orderpriority as content from orders",
    "part": f"select {_id(t.PART, 'p_partkey')} as id, 1 as version, 'tpch://part/' || p_partkey as source_uri, '{{\"type\":\"part\",\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}}' as metadata_json, p_name as content from part",
    "documents": f"select {_id(t.DOCUMENTS, 'doc_id')} as id, 1 + doc_id % 5 as version, 'doc://' || source || '/' || doc_id as source_uri, '{{\"type\":\"document\",\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}}' as metadata_json, text as content from documents",
    "events": f"select {_id(t.EVENTS, 'event_id')} as id, 1 as version, 'event://' || user_id as source_uri, props as metadata_json, event_type as content from events",
    "conversations": f"select {_id(t.TURNS, 'conv_id * 1000 + turn')} as id, 1 as version, 'conv://' || conv_id || '/' || turn as source_uri, '{{\"type\":\"turn\",\"role\":\"' || role || '\"}}' as metadata_json, text as content from conversations",
}


def _bsql(*names: str) -> str:
    return "b as (" + " union all ".join(_B[n] for n in names) + ")"


def _eid(source: str, target: str, kind: int, family: int, place: str, table: str) -> str:
    return f"select {source} as s, {target} as d, {kind} as k, {family << t.FAMILY_BITS} + cast({place} as bigint) as q from {table}"


_E = {
    "nation_region": _eid(_id(t.NATION, "n_nationkey"), _id(t.REGION, "n_regionkey"), 2, 1, "n_nationkey", "nation"),
    "customer_nation": _eid(_id(t.CUSTOMER, "c_custkey"), _id(t.NATION, "c_nationkey"), 2, 2, "c_custkey", "customer"),
    "supplier_nation": _eid(_id(t.SUPPLIER, "s_suppkey"), _id(t.NATION, "s_nationkey"), 2, 3, "s_suppkey", "supplier"),
    "orders_customer": _eid(_id(t.ORDERS, "o_orderkey"), _id(t.CUSTOMER, "o_custkey"), 8, 4, "o_orderkey", "orders"),
    "order_part": _eid(_id(t.ORDERS, "l_orderkey"), _id(t.PART, "l_partkey"), 3, 5, "l_orderkey * 64 + l_linenumber", "lineitem"),
    "order_supplier": _eid(_id(t.ORDERS, "l_orderkey"), _id(t.SUPPLIER, "l_suppkey"), 7, 6, "l_orderkey * 64 + l_linenumber", "lineitem"),
    "turns": _eid(_id(t.TURNS, "conv_id * 1000 + turn"), _id(t.TURNS, "conv_id * 1000 + turn - 1"), 8, 7, "conv_id * 1000 + turn", "conversations where turn > 0"),
}
_FOLLOWS = "f as (select distinct event_type as a, nxt as z from (select event_type, lead(event_type) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is not null and nxt <> event_type)"
_place = lambda c: f"cast(('0x' || substr(hex(cast({c} as blob)), 1, 6)) as bigint)"
_EVENTS_E = f"{_FOLLOWS}, e as (select {_label('a')} as s, {_label('z')} as d, 7 as k, {_place('a')} * 16777216 + {_place('z')} as q from f), b as (select distinct {_label('event_type')} as id from events)"


def _esql(*families: str) -> str:
    return "e as (" + " union all ".join(_E[f] for f in families) + ")"


def _near(direction: int, types: str = "true") -> str:
    out = f"select s as a, d as z, q as o from e where {types}"
    into = f"select d as a, s as z, {1 << 62} + q as o from e where {types}"
    return f"n as ({out if direction == 1 else into if direction == 2 else out + ' union all ' + into})"


def _walks(start: str, depth: int) -> str:
    return f"w as (select id, 0 as depth, [id] as path, cast([] as varchar[]) as ord from b where id = '{start}' union all select n.z, depth + 1, list_append(path, n.z), list_append(ord, lpad(cast(n.o as varchar), 20, '0') || n.z) from w join n on n.a = w.id join b on b.id = n.z where depth < {depth} and n.z <> '{start}')"


def _bfs(prelude: str, near: str, start: str, depth: int, limit: int, unique: bool = True) -> str:
    once = "(select *, row_number() over (partition by id order by depth, ord) as u from w)" if unique else "(select *, 1 as u from w)"
    return f"with recursive {prelude}, {near}, {_walks(start, depth)}, r as (select row_number() over (order by depth, ord) as rank, id, depth, array_to_string(path, '>') as path from {once} where u = 1) select * from r where rank <= {limit}"


def _shown(found: traverse.Traversal):
    return found.rows.select("rank", "id", "depth", F.array_join("path", ">").alias("path"))


def _fk(spark, d):
    return t.blocks(spark, d, *FK_TABLES), t.edges(spark, d, *FK_EDGES)


def _order(spark, d):
    return t.blocks(spark, d, *ORDER_TABLES), t.edges(spark, d, *ORDER_EDGES)


# --- lookups ----------------------------------------------------------------------------------------------------------


def flagship(spark, d):
    """What reaches region 1 within three hops, nearest first."""
    return _shown(traverse.breadth_first(*_fk(spark, d), REGION_1, Direction.INCOMING, FK_TYPES, 3, 10_000))


query(_bfs(f"{_bsql(*FK_TABLES)}, {_esql(*FK_EDGES)}", _near(2), REGION_1, 3, 10_000))(flagship)


@query(f"with {_bsql('orders')} select * from b where id = '{ORDER_1}'")
def find_block(spark, d):
    return lookup.find_block(t.blocks(spark, d, "orders"), ORDER_1)


_WANT = "want(ord, id) as (values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(SOME_IDS)) + ")"


@query(f"with {_bsql('nation')}, {_WANT} select cast(ord as bigint) as ord, b.* from want join b using (id)")
def find_blocks_ordered(spark, d):
    return lookup.find_blocks(t.blocks(spark, d, "nation"), SOME_IDS)


@query(f"with {_bsql('nation')}, {_WANT} select count(*) as n from want join b using (id)")
def count_existing(spark, d):
    return lookup.count_existing(t.blocks(spark, d, "nation"), SOME_IDS)


@query(f"with {_bsql('nation')}, {_WANT} select cast(ord as bigint) as ord, want.id, b.id is not null as exists from want left join b using (id)")
def block_exists(spark, d):
    return lookup.existing(t.blocks(spark, d, "nation"), SOME_IDS)


@query(f"with {_bsql('documents')} select id, version from b where id = '{t.DOCUMENTS}{7:030x}'")
def block_version(spark, d):
    return lookup.block_version(t.blocks(spark, d, "documents"), f"{t.DOCUMENTS}{7:030x}")


@query(f"with {_bsql('region', 'nation', 'part')} select id, version, source_uri from b")
def scan_all(spark, d):
    return lookup.all_blocks(t.blocks(spark, d, "region", "nation", "part")).select("id", "version", "source_uri")


@query(f"with {_esql('order_part', 'order_supplier')} select s as source_id, d as target_id, k as edge_type, q as edge_seq from e where s = '{ORDER_1}'")
def out_edges(spark, d):
    return lookup.outgoing(t.edges(spark, d, "order_part", "order_supplier"), ORDER_1)


@query(f"with {_esql(*t.FOREIGN_KEYS)} select s as source_id, d as target_id, k as edge_type, q as edge_seq from e where d = '{NATION_5}'")
def in_edges(spark, d):
    return lookup.incoming(t.edges(spark, d, *t.FOREIGN_KEYS), NATION_5)


@query(f"with {_bsql(*ORDER_TABLES)}, {_esql(*ORDER_EDGES)} select (select count(*) from b) as block_count, (select count(*) from e) as edge_count, (select count(distinct s) from e) as source_block_count, (select count(distinct d) from e) as target_block_count")
def graph_counts(spark, d):
    return lookup.graph_counts(*_order(spark, d))


@query(f"with {_esql(*_E)} select k as edge_type, count(*) as n from e group by 1")
def edge_type_counts(spark, d):
    return t.edges(spark, d, *_E).groupBy("edge_type").agg(F.count("*").alias("n"))


_DEGREE = f"with {_esql(*ORDER_EDGES)}, g as (select id, sum(o) as out_degree, sum(i) as in_degree from (select s as id, 1 as o, 0 as i from e union all select d, 0, 1 from e) group by 1)"


@query(f"{_DEGREE} select id, cast(out_degree as bigint) as out_degree, cast(in_degree as bigint) as in_degree from g")
def degree(spark, d):
    return graph.degrees(t.edges(spark, d, *ORDER_EDGES))


@query(f"{_DEGREE} select cast(max(out_degree) as bigint) as max_out, cast(max(in_degree) as bigint) as max_in, count_if(out_degree = 0) as sinks from g")
def degree_summary(spark, d):
    return graph.degrees(t.edges(spark, d, *ORDER_EDGES)).agg(F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"), F.count_if(F.col("out_degree") == 0).alias("sinks"))


@query(f"with {_bsql('documents', 'events')} select case when version - 2 < 1 then 'InvalidVersion' end as error, count(*) as n from (select * from b where strlen(source_uri) > 0) group by 1")
def validate_blocks(spark, d):
    """How many blocks each rule rejects after their versions fall by two."""
    return t.blocks(spark, d, "documents", "events").withColumn("version", F.col("version") - 2).groupBy(block_error().alias("error")).agg(F.count("*").alias("n"))


# --- filters ----------------------------------------------------------------------------------------------------------


def _filter(name: str, tables: tuple[str, ...], where: filters.Expression, sql: str, semantics: str = "contract"):
    def run(spark, d):
        return filters.matching(t.blocks(spark, d, *tables), where, semantics).select("id", "version", "source_uri")

    run.__name__ = name
    query(f"with {_bsql(*tables)} select id, version, source_uri from b where {sql}")(run)


_NUM = "'[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])'"


def _cmp(text: str, op: str, value: str) -> str:
    a, b = f"try_cast({text} as double)", f"try_cast('{value}' as double)"
    return f"(case when regexp_full_match({text}, {_NUM}) and regexp_full_match('{value}', {_NUM}) then (case when isnan({a}) or isnan({b}) then 0 {op} 0 else {a} {op} {b} end) else {text} {op} '{value}' end)"


_typed = lambda f: f"coalesce(json_extract_string(metadata_json, '$.{f}'), '')"
_literal = lambda f: f"regexp_extract(metadata_json, '\"{f}\":[ \"]*([^\",]*)', 1)"
_filter("filter_content_contains", ("documents",), filters.content(Op.CONTAINS, "the "), "contains(content, 'the ')")
_filter("filter_starts_with", ("documents",), filters.source_uri(Op.STARTS_WITH, "doc://src1"), "starts_with(source_uri, 'doc://src1')")
_filter("filter_ends_with", ("documents",), filters.content(Op.ENDS_WITH, "."), "ends_with(content, '.')")
_filter("filter_uri_equal", ("customer", "orders"), filters.source_uri(Op.EQUAL, "tpch://customer/42"), "source_uri = 'tpch://customer/42'")
_filter("filter_meta_literal", ("events",), filters.metadata("k", Op.GREATER, "50"), _cmp(_literal("k"), ">", "50"), "literal")
_filter("filter_meta_typed", ("events",), filters.metadata("k", Op.GREATER, "50"), _cmp(_typed("k"), ">", "50"))
_filter("filter_meta_not_equal", ("documents", "part"), filters.metadata("lang", Op.NOT_EQUAL, "en"), _cmp(_typed("lang"), "<>", "en"))
_filter("filter_version_ge", ("documents",), filters.version(Op.GREATER_EQUAL, 4), "version >= 4")
_filter("filter_content_length", ("documents",), filters.content_length(Op.LESS, 500), "strlen(content) < 500")
_filter("filter_num_or_lex", ("part", "nation"), filters.metadata("size", Op.LESS_EQUAL, "1e1"), _cmp(_typed("size"), "<=", "1e1"))
_filter(
    "filter_and_or_not", ("documents",),
    (filters.metadata("lang", Op.EQUAL, "en") & filters.version(Op.LESS, 3)) | ~filters.content(Op.CONTAINS, "e"),
    f"({_typed('lang')} = 'en' and version < 3) or not contains(content, 'e')",
)
_PAGED = filters.metadata("status", Op.EQUAL, "O")
_PAGED_SQL = f"with {_bsql('orders')}, m as (select * from b where {_typed('status')} = 'O')"


@query(f"{_PAGED_SQL} select id, source_uri from m order by id limit 50 offset 100")
def filter_page(spark, d):
    return filters.filter_blocks(t.blocks(spark, d, "orders"), _PAGED, 50, 100).blocks.select("id", "source_uri")


@query(f"{_PAGED_SQL} select count(*) as total_matches, cast(least(greatest(count(*) - 100, 0), 50) as bigint) as returned, count(*) > 100 + least(greatest(count(*) - 100, 0), 50) as has_more from m")
def filter_totals(spark, d):
    return filters.totals(t.blocks(spark, d, "orders"), _PAGED, 100, 50)


# --- keyword search ---------------------------------------------------------------------------------------------------

_HITS = " + ".join(f"cast(contains(content, '{w}') as int)" for w in KEYWORDS.split(" "))
_SCORED = f"with {_bsql('documents')}, s as (select id, case when content = '' then cast(0 as float) else cast(cast({_HITS} as double) / 3.0 as float) end as score from b), h as (select id, cast(score as double) as score from s where score >= cast(0.6 as float))"


def _score(df):
    return df.select("id", F.col("score").cast("double").alias("score"))


@query(f"{_SCORED} select * from h")
def keyword_scores(spark, d):
    return _score(search.scores(t.blocks(spark, d, "documents"), KEYWORDS, 0.6))


@query(f"{_SCORED} select * from h order by score desc, id limit 25")
def keyword_topk(spark, d):
    return _score(search.keyword_search(t.blocks(spark, d, "documents"), KEYWORDS, 25, 0.6))


@query(f"{_SCORED} select * from h order by id limit 25")
def keyword_literal_first_n(spark, d):
    return _score(search.keyword_search(t.blocks(spark, d, "documents"), KEYWORDS, 25, 0.6, "literal"))


# --- traversals -------------------------------------------------------------------------------------------------------


def _walk(name: str, graph_of, start: str, direction: Direction, depth: int, prelude: str, near: str, unique: bool = True, how=traverse.breadth_first, limit: int = 1000, **kw):
    def run(spark, d):
        b, e = graph_of(spark, d)
        return _shown(how(b, e, start, direction, kw.get("edge_filter", traverse.ALL_EDGES), depth, limit, **({} if unique else {"semantics": "literal"})))

    run.__name__ = name
    query(_bfs(prelude, near, start, kw.get("sql_depth", depth), limit, unique))(run)


_ORDER_SQL = f"{_bsql(*ORDER_TABLES)}, {_esql(*ORDER_EDGES)}"
_OUT, _IN, _BOTH = Direction.OUTGOING, Direction.INCOMING, Direction.BIDIRECTIONAL
_walk("bfs_walks", t.event_graph, CLICK, _OUT, 4, _EVENTS_E, _near(1), False)
_walk("bfs_unique_out", t.event_graph, CLICK, _OUT, 4, _EVENTS_E, _near(1))
_walk("bfs_unique_in", t.event_graph, CLICK, _IN, 4, _EVENTS_E, _near(2))
_walk("bfs_bidirectional", t.event_graph, CLICK, _BOTH, 2, _EVENTS_E, _near(3))
_walk("bfs_paths", _order, ORDER_1, _OUT, 4, _ORDER_SQL, _near(1))
_walk("bfs_only_type", _order, ORDER_1, _OUT, 4, _ORDER_SQL, _near(1, "k = 3"), edge_filter=EdgeFilter.only(EdgeType.REFERENCES))
_walk("bfs_include_types", _order, ORDER_1, _OUT, 4, _ORDER_SQL, _near(1, "k in (2, 7)"), edge_filter=EdgeFilter.include([EdgeType.CALLS, EdgeType.DEFINED_IN]))
_walk("bfs_exclude_types", _order, ORDER_1, _OUT, 4, _ORDER_SQL, _near(1, "k <> 3"), edge_filter=EdgeFilter.exclude([EdgeType.REFERENCES]))
_walk("bfs_result_limit", _fk, REGION_1, _IN, 3, f"{_bsql(*FK_TABLES)}, {_esql(*FK_EDGES)}", _near(2), limit=40)
_walk("astar", _order, ORDER_1, _OUT, 4, _ORDER_SQL, _near(1), how=traverse.astar)
_walk("bidirectional_search_half_depth", _order, ORDER_1, _BOTH, 2, _ORDER_SQL, _near(3), how=traverse.bidirectional_search, sql_depth=1)


def _dangling(spark, d):
    b, e = _fk(spark, d)
    gone = t.table(spark, d, "customer").where("c_custkey % 10 = 7").select(t.id_of(t.CUSTOMER, "c_custkey").alias("id"))
    return b.join(gone, "id", "left_anti"), e


_walk("bfs_dangling", _dangling, REGION_1, _IN, 3, f"{_bsql(*FK_TABLES).replace('from customer', 'from customer where c_custkey % 10 <> 7')}, {_esql(*FK_EDGES)}", _near(2), limit=10_000)


@query(f"with recursive {_bsql(*FK_TABLES)}, {_esql(*FK_EDGES)}, {_near(2)}, w as (select id, 0 as depth, [id] as path, cast([] as bigint[]) as ord from b where id = '{NATION_5}' union all select n.z, depth + 1, list_append(path, n.z), list_append(ord, -n.o) from w join n on n.a = w.id where depth < 2) select row_number() over (order by ord) as rank, id, depth, array_to_string(path, '>') as path from w qualify rank <= 1000")
def dfs_preorder_forest(spark, d):
    return _shown(traverse.depth_first(*_fk(spark, d), NATION_5, _IN, traverse.ALL_EDGES, 2, 1000))


def _dfs(prelude: str, near: str, start: str, depth: int, limit: int) -> str:
    """The stack as a list: its last entry is taken off, and, if it wasn't met before, emitted and its neighbours put on."""
    return f"""with recursive {prelude}, {near}, nb as (select a, list(z order by o) as zs from n join b on b.id = n.z group by a),
w as (select 0 as step, [{{'id': '{start}', 'depth': 0, 'path': '{start}'}}] as stack, cast([] as varchar[]) as seen, cast(null as varchar) as id, 0 as depth, '' as path
union all select step + 1, list_concat(stack[:-2], case when list_contains(seen, stack[-1].id) or stack[-1].depth >= {depth} then [] else list_transform(coalesce(zs, []), lambda z: {{'id': z, 'depth': stack[-1].depth + 1, 'path': stack[-1].path || '>' || z}}) end),
list_append(seen, stack[-1].id), case when not list_contains(seen, stack[-1].id) then stack[-1].id end, stack[-1].depth, stack[-1].path from w left join nb on nb.a = stack[-1].id where len(stack) > 0)
select row_number() over (order by step) as rank, id, depth, path from w where id is not null qualify rank <= {limit}"""


@query(_dfs(_EVENTS_E, _near(1), CLICK, 4, 1000))
def dfs_cyclic(spark, d):
    return _shown(traverse.depth_first(*t.event_graph(spark, d), CLICK, _OUT, traverse.ALL_EDGES, 4, 1000))


@query(_dfs(_EVENTS_E, _near(1), CLICK, 10, 1000))
def scc_literal_dfs(spark, d):
    return _shown(traverse.traverse(*t.event_graph(spark, d), CLICK, traverse.Algorithm.STRONGLY_CONNECTED, semantics="literal"))


@query(f"with recursive {_ORDER_SQL}, {_near(1)}, w as (select '{ORDER_1}' as id, 0 as layer union all select n.z, layer + 1 from w join n on n.a = w.id), l as (select id, max(layer) as layer from w group by 1) select row_number() over (order by layer, id) as rank, id, cast(row_number() over (order by layer, id) - 1 as int) as depth, id as path from l")
def topo_forest(spark, d):
    return _shown(graph.topological_sort(*_order(spark, d), ORDER_1))


OUTSIDE, APART = "0e" + "1".zfill(30), "0e" + "2".zfill(30)


@query(
    f"with recursive {_EVENTS_E}, g as (select s, d from e union all select '{OUTSIDE}', '{CLICK}' union all select '{OUTSIDE}', '{APART}'), p as (select s, d from g union select p.s, g.d from p join g on g.s = p.d), starts(start) as (values ('{CLICK}'), ('{OUTSIDE}'), ('{APART}')), "
    "r as (select start, start as id from starts union select start, d from starts join p on p.s = start) select start, case when exists (select 1 from r r2 join p on p.s = r2.id and p.d = r2.id where r2.start = r.start) then 0 else count(*) end as length from r group by start"
)
def topo_cycles(spark, d):
    """How long the order is from a block on a cycle, from one that leads to it, and from one apart."""
    b, e = t.event_graph(spark, d)
    b = b.select("id").unionByName(spark.createDataFrame([(OUTSIDE,), (APART,)], "id string"))
    more = [(OUTSIDE, CLICK, 7, 1), (OUTSIDE, APART, 7, 2)]
    e = e.unionByName(spark.createDataFrame(more, e.schema))
    rows = [(s, graph.topological_sort(b, e, s).rows.count()) for s in (CLICK, OUTSIDE, APART)]
    return spark.createDataFrame(rows, "start string, length long")


_CLOSURE = f"with recursive {_EVENTS_E}, c as (select id as a, id as z from b union select c.a, e.d from c join e on e.s = c.z)"


@query(f"{_CLOSURE} select x.a as id, min(x.z) as component from c x join c y on x.a = y.z and x.z = y.a group by 1")
def scc_contract(spark, d):
    return graph.strong_components(*t.event_graph(spark, d))


@query(f"{_CLOSURE} select x.z as id from c x join c y on x.a = y.z and x.z = y.a where x.a = '{CLICK}'")
def scc_of_start(spark, d):
    return graph.component_of(*t.event_graph(spark, d), CLICK).rows.select("id")


@query(f"with recursive {_esql(*FK_EDGES)}, w as (select {_id(t.REGION, 'r_regionkey')} as start, {_id(t.REGION, 'r_regionkey')} as id, 0 as depth from region union all select start, e.s, depth + 1 from w join e on e.d = w.id where depth < 3) select start, id, depth from w")
def reach_all_regions(spark, d):
    """What each region is reached from within three hops, all regions at once and without limit."""
    return traverse.reach(t.edges(spark, d, *FK_EDGES), t.blocks(spark, d, "region").select(F.col("id").alias("start")), _IN, max_depth=3)


# --- analytics and store ----------------------------------------------------------------------------------------------

_SEGMENTS = f"with {_bsql('customer', 'nation')}, v as (select id, {_typed('segment')} as value from b where {_typed('segment')} <> '')"


@query(f"{_SEGMENTS} select value, id from v")
def meta_index(spark, d):
    return analytics.metadata_index(t.blocks(spark, d, "customer", "nation"), "segment")


@query(f"{_SEGMENTS} select distinct value from v")
def meta_values(spark, d):
    return analytics.distinct_values(t.blocks(spark, d, "customer", "nation"), "segment")


@query(f"{_SEGMENTS}, c as (select value, count(*) as n from v group by 1), s as (select count(*) as unique_values, cast(sum(n) as bigint) as total_entries, max(n) as max_per_value from c) select *, unique_values / total_entries as selectivity, unique_values / total_entries < 0.5 and max_per_value < total_entries // 2 as is_selective from s")
def meta_selectivity(spark, d):
    return analytics.index_statistics(t.blocks(spark, d, "customer", "nation"), "segment")


@query("with p as (select unnest(string_split(html, 'track(')) as x, generate_subscripts(string_split(html, 'track('), 1) as i, len(string_split(html, 'track(')) as n from pages where strlen(html) <= 1048576) select 'track' as name, cast(count_if(i < n and not regexp_matches(x, '[A-Za-z0-9_]$')) as bigint) as calls from p")
def call_count(spark, d):
    return analytics.count_calls(t.blocks(spark, d, "pages"), ["track"])


@query(f"with {_bsql('documents', 'events')} select cast(sum(strlen(source_uri) + strlen(metadata_json) + strlen(content)) as bigint) as bytes from b")
def memory_usage(spark, d):
    return analytics.memory_usage(t.blocks(spark, d, "documents", "events"))


@query(f"with {_bsql('documents')} select id, version, sha256(content) as content_hash, cast(strlen(content) as bigint) as content_length from b")
def snapshot_hash(spark, d):
    return analytics.snapshot(t.blocks(spark, d, "documents"))


_OPS = f"o as (select event_id as seq, case when event_type = 'error' then 2 else 1 end as op, {_id(t.USERS, 'user_id')} as id, 1 + cast(floor(value) as bigint) as version, 'user://' || user_id as source_uri, props as metadata_json, event_type as content from events)"


@query(f"with {_OPS} select id, version, source_uri, metadata_json, content from o qualify row_number() over (partition by id order by seq desc) = 1 and op = 1")
def current_state(spark, d):
    return store.current_blocks(t.event_ops(spark, d))


@query(f"with {_OPS} select id, version, source_uri, metadata_json, content from o where op = 1 qualify row_number() over (partition by id order by version desc, seq desc) = 1")
def compact_max_version(spark, d):
    return store.compacted(t.event_ops(spark, d).where("op = 1"))


@query(f"with {_OPS} select count_if(op = 1) as blocks_written, count_if(op = 2) as blocks_deleted, cast(0 as bigint) as edges_added, cast(0 as bigint) as edges_removed, count(*) as wal_writes, cast(sum(case when op = 1 then strlen(source_uri) + strlen(metadata_json) + strlen(content) end) as bigint) as total_bytes_written from o")
def log_metrics(spark, d):
    return analytics.metrics_of(t.event_ops(spark, d))


@query(f"with {_OPS}, p as (select id as source_id, {_id(t.USERS, 'user_id + 1')} as target_id, 3 as edge_type, event_id as edge_seq from events join o on o.seq = event_id where event_type = 'click'), g as (select id, max(seq) as gone from o where op = 2 group by 1) select source_id, target_id, edge_type, edge_seq from p left join g g1 on g1.id = source_id left join g g2 on g2.id = target_id where edge_seq > coalesce(g1.gone, -1) and edge_seq > coalesce(g2.gone, -1)")
def live_edges(spark, d):
    """Edges put by clicks (user to next user) that no later delete of either user took away."""
    ops = t.event_ops(spark, d)
    e = t.table(spark, d, "events").where("event_type = 'click'")
    puts = e.select("event_id", t.id_of(t.USERS, "user_id").alias("s"), t.id_of(t.USERS, F.col("user_id") + 1).alias("d"))
    none = F.lit(None).cast("string")
    puts = puts.select(F.col("event_id").alias("seq"), F.lit(3).cast("short").alias("op"), none.alias("id"), F.lit(None).cast("long").alias("version"), none.alias("source_uri"), none.alias("metadata_json"), none.alias("content"), F.col("s").alias("source_id"), F.col("d").alias("target_id"), F.lit(3).cast("short").alias("edge_type"))
    return store.current_edges(ops.unionByName(puts))


@query(f"with {_OPS} select count(*) as entries, count_if(op = 1 and version < 1) as corrupted, count_if(op = 1 and version < 1) * 100.0 / count(*) as corruption_rate, count_if(op = 1 and version >= 1) as blocks_recovered, cast(0 as bigint) as edges_recovered, count_if(op = 2) as deletes_recovered from o")
def log_recovery(spark, d):
    return store.recovery(t.event_ops(spark, d))


@query(f"with {_esql(*t.FOREIGN_KEYS)} select s || d || lpad(lower(to_hex(k)), 2, '0') || '00000000000000' as wire from e")
def edge_codec(spark, d):
    return t.edges(spark, d, *t.FOREIGN_KEYS).select(F.lower(F.hex(wire.encode_edge())).alias("wire"))


@query(f"with {_bsql('documents')} select id, version, source_uri, metadata_json, content from b")
def block_codec_round_trip(spark, d):
    raw = t.blocks(spark, d, "documents").select(wire.encode_block().alias("raw"))
    return wire.decode_blocks(raw, "raw").where("error is null").drop("error")


_PATH = "source || '/' || doc_id || case when doc_id % 3 = 0 then '.md' else '.zig' end"


@query(f"select doc_id, regexp_full_match({_PATH}, 'src1[^/]*/.*\\.zig') as deep, regexp_full_match({_PATH}, 'src[1-3]/[^/]*\\.md') as set_star, regexp_full_match({_PATH}, '[^/]*\\.md') as star from documents")
def glob_match(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".zig"))
    return t.table(spark, d, "documents").select("doc_id", matches_glob(path, "src1*/**/*.zig").alias("deep"), matches_glob(path, "src[1-3]/*.md").alias("set_star"), matches_glob(path, "*.md").alias("star"))


_LINES = [
    'const std = @import("std");', 'const next = @import("s@N.zig");', "pub const S@K = struct {", "    pub fn get_@K(self: *S@K) u32 {", '        setup_logging(); helper(); next.helper(); self.get_@K(); // gone("', "    }",
    "    const kept_@K = outside();", "};", 'fn helper() void { inner("text(}"); }', "const limit_@K = 10;", 'test "t @K" {}',
]
_EVEN = "pub fn extra_@K() void { helper(); }"


def _sources(spark, d):
    """One source text for each supplier, in two repositories that have the same paths; those of the first have a function more."""
    key, nth = F.col("s_suppkey").cast("string"), F.floor(F.col("s_suppkey") / 2).cast("string")
    text = F.concat(F.lit("\n".join(_LINES)), F.when(F.col("s_suppkey") % 2 == 0, "\n" + _EVEN).otherwise(""))
    text = F.regexp_replace(F.regexp_replace(text, F.lit("@K"), key), F.lit("@N"), (F.floor(F.col("s_suppkey") / 2) + 1).cast("string"))
    path = F.concat(F.lit("src/s"), nth, F.lit(".zig"))
    return t.table(spark, d, "supplier").select(
        text.alias("data"), F.lit("text/zig").alias("content_type"),
        F.create_map(F.lit("repository_path"), F.concat(F.lit("r"), (F.col("s_suppkey") % 2).cast("string")), F.lit("file_path"), path).alias("metadata"), F.lit(0).cast("long").alias("timestamp_ns"),
    )


_TEXT = "replace(replace('" + "\n".join(_LINES) + "' || case when s_suppkey % 2 = 0 then chr(10) || '" + _EVEN + "' else '' end, '@K', cast(s_suppkey as varchar)), '@N', cast(s_suppkey // 2 + 1 as varchar))"
_SRC = f"src as (select s_suppkey as k, 'r' || (s_suppkey % 2) as repository, 'src/s' || (s_suppkey // 2) || '.zig' as file, string_split({_TEXT}, chr(10)) as lines from supplier), l as (select repository, file, unnest(lines) as line, generate_subscripts(lines, 1) as no from src), tr as (select *, trim(line) as x from l)"
_CONST = "trim(regexp_extract(x, 'const (.*?) =', 1))"


@query(
    f"with {_SRC} select repository, 'import_' || no as id, 'import' as unit_type, file, no as line_no from tr where starts_with(x, '@import(') or starts_with(x, 'const std = @import(\"std\");') "
    "union all select repository, file || ':' || trim(regexp_extract(x, 'fn (.*?)\\(', 1)), 'function', file, no from tr where regexp_matches(x, 'fn .*?\\(') "
    f"union all select repository, file || ':' || {_CONST}, 'type', file, no from tr where contains(line, 'struct {{') or contains(line, '= struct') "
    f"union all select repository, file || ':' || {_CONST}, 'constant', file, no from tr where contains(line, 'const ') and contains(line, ' = ') and not contains(line, '@import') "
    "union all select repository, 'test:' || file || ':' || no, 'test', file, no from tr where contains(line, 'test ')"
)
def code_units(spark, d):
    return ingest.parse_units(_sources(spark, d)).select("repository", "id", "unit_type", F.col("location.file_path").alias("file"), F.col("location.line_start").cast("long").alias("line_no"))


_CALLS = (
    "select repository, file, k, 'get_' || k as f, unnest(['setup_logging', 'helper', 'helper', 'get_' || k]) as target_id, unnest([11, 11, 10, 10]) as edge_type, unnest(['', '', 'next', 'self']) as qualifier from src "
    "union all select repository, file, k, 'helper', 'inner', 11, '' from src union all select repository, file, k, 'extra_' || k, 'helper', 11, '' from src where k % 2 = 0"
)


@query(f"with {_SRC}, c as ({_CALLS}) select repository, file || ':' || f as id, target_id, edge_type, qualifier from c")
def code_calls(spark, d):
    """Calls in bodies: not in comments, texts, or between functions."""
    return ingest.call_edges(_sources(spark, d)).select(F.substring_index("file", "\n", 1).alias("repository"), "id", "target_id", "edge_type", "qualifier")


def _unit_id(file: str, name: str, line: str) -> str:
    return f"substr(sha256('unit_' || {file} || '_function_' || regexp_extract({file}, '[^\\n]*$') || ':' || {name} || '_' || {line} || '_1'), 1, 32)"


@query(
    f"with {_SRC}, s as (select *, repository || chr(10) || file as here, repository || chr(10) || 'src/s' || (k // 2 + 1) || '.zig' as nxt from src) "
    f"select {_unit_id('here', chr(39) + 'get_' + chr(39) + ' || k', '4')} as source_id, {_unit_id('here', chr(39) + 'helper' + chr(39), '9')} as target_id, 11 as edge_type from s "
    f"union all select {_unit_id('here', chr(39) + 'get_' + chr(39) + ' || k', '4')}, {_unit_id('nxt', chr(39) + 'helper' + chr(39), '9')}, 10 from s where nxt in (select here from s) "
    f"union all select {_unit_id('here', chr(39) + 'extra_' + chr(39) + ' || k', '12')}, {_unit_id('here', chr(39) + 'helper' + chr(39), '9')}, 11 from s where k % 2 = 0"
)
def code_resolved_edges(spark, d):
    """Calls as edges between blocks: by the same file's functions, by imported files'."""
    return ingest.resolve_edges(ingest.units_with_edges(_sources(spark, d)))


@query("select count(*) as files, count(*) + count_if(s_suppkey % 2 = 0) as functions, count(*) as methods, count(*) as structs from supplier")
def code_statistics(spark, d):
    return analytics.code_statistics(_sources(spark, d)).select("files", "functions", "methods", "structs")


@query("select cast(2 * count(*) + count_if(s_suppkey % 2 = 0) as bigint) as units_parsed, count(*) as sources_processed from supplier")
def ingest_functions(spark, d):
    """Functions found, and sources read, by the whole pipeline from sources to blocks."""
    src = _sources(spark, d)
    units = checkpointed(ingest.units_with_edges(src))
    found = ingest.chunk(units).where(F.contains("metadata_json", F.lit('"unit_type":"function"')))
    return found.agg(F.count("*").alias("units_parsed")).withColumn("sources_processed", ingest.pipeline_stats(src, units, found).select("sources_processed").scalar())


def queries() -> dict:
    from . import service_queries

    return _Q | service_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import service_queries

    return _SQL | service_queries.SQL
