import struct

import pytest
from pyspark.sql import functions as F

from trellis.model import EdgeType, IdSource, InvalidQuery, block_error, edge_error, numbered_id, parse_id, ranked
from trellis.operators import ingest, store
from trellis.operators.store import Store
from trellis.operators.traverse import Algorithm
from trellis.plans import formats
from trellis.plans.cache import QueryCache
from trellis.plans.cli import main
from trellis.plans.engine import Engine, NotRunning
from trellis.plans.stats import CorruptionTracker, QueryStatistics, latency
from trellis.sources import wire
from trellis.sources.files import TreeConfig, git_metadata, read_tree, stream_tree
from trellis.streaming import ingest_stream, ops_stream

B = "id string, version long, source_uri string, metadata_json string, content string"
E = "source_id string, target_id string, edge_type short"
X, Y, Z = (f"{i:032x}" for i in (1, 2, 3))


def block(i, v=1, c="text"):
    return (i, v, f"u://{i[-2:]}", "{}", c)


def test_ids():
    assert numbered_id(0) == "01" + "00" * 15 and parse_id("DEADBEEF" * 4) == "deadbeef" * 4
    ids = IdSource((1 << 32) + 5)
    assert ids() == struct.pack("<QQ", (1 << 32) + 5, 1).hex() and ids() == struct.pack("<QQ", (1 << 32) + 6, 1).hex()
    with pytest.raises(InvalidQuery):
        parse_id("0" * 32)


def test_validation(spark):
    rows = [(*block(X), None), ("0" * 32, 1, "u", "{}", "c", "ZeroBlockId"), ("xx", 1, "u", "{}", "c", "InvalidBlockId"), (X, 0, "u", "{}", "c", "InvalidVersion"), (X, 1, "u", "{bad", "c", "InvalidMetadata"), (X, 1, "u" * (1 << 20), "{}", "c", "SourceUriTooLong"), (X, 1, None, "{}", "c", "MissingField")]
    df = spark.createDataFrame(rows, B + ", want string")
    assert df.withColumn("e", block_error()).where("not (e <=> want)").collect() == []
    assert spark.createDataFrame([block(X, c="")], B).select(block_error(True).alias("e")).first().e == "EmptyContent"
    edges = [(X, Y, 1, None), (X, X, 1, "SelfEdge"), (X, "0" * 32, 1, "InvalidBlockId"), (X, Y, 12, "InvalidEdgeType")]
    assert spark.createDataFrame(edges, E + ", want string").withColumn("e", edge_error()).where("not (e <=> want)").collect() == []


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.blocks().count() == 0 and s.edges().count() == 0
    bad = s.put_blocks(spark.createDataFrame([block(X, 5), block(Y), block(Z), ("no", 1, "u", "{}", "c")], B))
    assert [r.error for r in bad.collect()] == ["InvalidBlockId"]
    s.put_edges(spark.createDataFrame([(X, Y, 7), (Y, Z, 7), (X, Y, 7), (X, X, 7)], E))
    s.put_blocks(spark.createDataFrame([block(X, 2, "later")], B))
    assert {r.id: (r.version, r.content) for r in s.blocks().collect()} == {X: (2, "later"), Y: (1, "text"), Z: (1, "text")}
    assert s.edges().count() == 3
    s.delete_blocks(spark.createDataFrame([(Z,)], "id string"))
    assert s.blocks().count() == 2 and s.edges().count() == 2
    seen = sorted((r.id, r.version, r.content) for r in s.blocks().collect())
    n = s.compact()
    assert s.compact() == n and sorted((r.id, r.version, r.content) for r in s.blocks().collect()) == seen and s.edges().count() == 2
    assert s.vacuum() == 4 and s.batches() == [] and s.blocks().count() == 2
    s.put_blocks(spark.createDataFrame([block(Z, 1, "again")], B))
    s.delete_edges(spark.createDataFrame([(X, Y, 7)], E))
    assert s.blocks().count() == 3 and s.edges().count() == 0  # old edges of a deleted block stay gone
    m = s.metrics.as_dict()
    assert (m["blocks_written"], m["blocks_deleted"], m["edges_added"], m["edges_removed"], m["compactions"]) == (5, 1, 3, 1, 1)
    assert m["average_write_latency_ns"] > 0 and m["write_throughput_bps"] > 0 and "ns write" in formats.metrics_text(m)
    s.reset()
    assert s.blocks().count() == 0


def test_compaction_by_version(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for v in (1, 9, 4):
        s.put_blocks(spark.createDataFrame([block(X, v)], B))
    assert s.blocks().first().version == 4
    s.compact("max_version")
    assert s.blocks().first().version == 9


def test_recovery(spark):
    ops = [(1, 1, *block(X), None, None, None), (2, 1, *block(Y, 0), None, None, None), (3, 9, *block(Y), None, None, None), (4, 3, None, None, None, None, None, X, Y, 7)]
    df = spark.createDataFrame(ops, store.OPS)
    r = store.recovery(df).first()
    assert (r.entries, r.corrupted, r.corruption_rate) == (4, 2, 50.0)
    good, bad = store.valid_ops(df)
    assert good.count() == 2 and sorted(x.error for x in bad.collect()) == ["InvalidOperation", "InvalidVersion"]
    t = CorruptionTracker()
    for i in range(200):
        t.record(i % 10 != 0)
    assert t.is_elevated() and not t.is_systematic()
    [t.record(False) for _ in range(4)]
    assert t.is_systematic()


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = sorted((r.x, r["rank"]) for r in ranked(df, "x").collect())
    assert [k for _, k in got] == list(range(1, 501))


def test_wire(spark):
    rows = [block(X, 7, "zwölf"), block(Y, 1, "")]
    df = spark.createDataFrame(rows, B)
    raw = df.select(wire.encode_block().alias("raw"))
    assert sorted(tuple(r)[1:] for r in wire.decode_blocks(raw, "raw").collect()) == sorted(rows)
    first = bytes(raw.first().raw)
    assert struct.unpack_from("<IHH16sQIIQ", first)[:5] == (0x42444358, 1, 0, bytes.fromhex(X), 7) and len(first) == 64 + 6 + 2 + 6
    broken = [(first[:10],), (b"xxxx" + first[4:],), (first[:-1] + b"!",), (first[:-1],), (None,)]
    assert [r.error for r in wire.decode_blocks(spark.createDataFrame(broken, "raw binary").coalesce(1), "raw").collect()] == ["BufferTooSmall", "InvalidMagic", "InvalidChecksum", "IncompleteData", "BufferTooSmall"]
    e = spark.createDataFrame([(X, Y, 11)], E).select(wire.encode_edge().alias("raw"))
    assert len(e.first().raw) == 40 and tuple(wire.decode_edges(e, "raw").first()) == (None, X, Y, 11)
    assert wire.decode_entry(wire.encode_entry("put_edge", b"abc")) == ("put_edge", b"abc")
    with pytest.raises(ValueError):
        wire.decode_entry(wire.encode_entry("put_edge", b"abc")[:-1] + b"x")
    assert wire.decode_message(wire.encode_message("find_blocks", b"1234")) == ("find_blocks", 1, b"1234")
    with pytest.raises(ValueError):
        wire.decode_message(b"\x55" + bytes(7))


SOURCE = """const std = @import("std");
const limit = 10;
pub const Config = struct {
    pub fn load(self: *Config) void {
        setup_logging();
        self.validate();
    }
};
fn validate() void {}
pub fn setup_logging() void {}
test "loads" {
}"""


def test_parser_and_chunks(spark):
    src = spark.createDataFrame([(SOURCE, "text/zig", {"file_path": "src/a.zig"}, 1), ("fn x() {}", "text/plain", {"file_path": "b.txt"}, 1)], "data string, content_type string, metadata map<string,string>, timestamp_ns long")
    units = ingest.units_with_edges(src)
    got = {(r.id, r.unit_type, r.location.line_start) for r in units.collect()}
    a = "src/a.zig"
    assert got == {("import_1", "import", 1), (f"{a}:limit", "constant", 2), (f"{a}:Config", "type", 3), (f"{a}:Config", "constant", 3), (f"{a}:load", "function", 4), (f"{a}:validate", "function", 9), (f"{a}:setup_logging", "function", 10), (f"test:{a}:11", "test", 11)}
    load = units.where("name = 'load'").first()
    assert load.metadata == {"visibility": "public", "is_method": "true"}
    assert {(e.target_id, e.edge_type) for e in load.edges} == {("setup_logging", EdgeType.CALLS_FUNCTION), ("validate", EdgeType.CALLS_METHOD)}
    literal = ingest.call_edges(src, "literal").collect()
    assert {(r.id, r.target_id) for r in literal} == {("unknown.zig:load", "setup_logging"), ("unknown.zig:load", "validate")}
    blocks = ingest.chunk(units)
    assert blocks.where(block_error().isNotNull()).count() == 0 and blocks.select("id").distinct().count() == 8
    assert ingest.chunk(units, ingest.ChunkerConfig(max_unit_bytes=30)).count() < 8
    edges = ingest.resolve_edges(units).collect()
    assert [(r.edge_type) for r in edges] == [EdgeType.CALLS_FUNCTION]
    assert ingest.parse_units(src, ingest.ParserConfig(include_tests=False, include_private=False)).where("unit_type in ('test') or name = 'validate'").count() == 0
    s = ingest.pipeline_stats(src, units, blocks).first()
    assert (s.sources_processed, s.sources_skipped, s.units_parsed, s.blocks_created) == (1, 1, 8, 8)


def tree(root):
    (root / "src" / "deep").mkdir(parents=True)
    (root / ".git" / "refs" / "heads").mkdir(parents=True)
    (root / "zig-cache" / "x").mkdir(parents=True)
    (root / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (root / ".git" / "refs" / "heads" / "main").write_text("a" * 40 + "\n")
    (root / "src" / "a.zig").write_text(SOURCE)
    (root / "src" / "deep" / "b.md").write_bytes(b"bad \xff byte")
    (root / "zig-cache" / "x" / "c.zig").write_text("const a = 1;")
    (root / "big.txt").write_text("x" * 100)
    (root / "lib.so").write_text("x")


def test_source_tree(spark, tmp_path):
    tree(tmp_path)
    got = read_tree(spark, TreeConfig(str(tmp_path), max_file_bytes=1000)).collect()
    assert [r.metadata["file_path"] for r in got] == ["big.txt", "src/a.zig", "src/deep/b.md"]
    assert got[1].data == SOURCE and got[1].content_type == "text/zig" and not got[1].replaced
    assert got[2].replaced and "�" in got[2].data
    assert (got[1].metadata["branch"], got[1].metadata["commit_hash"]) == ("main", "a" * 40)
    (tmp_path / ".git" / "HEAD").write_text("b" * 40)
    assert git_metadata(spark, str(tmp_path)).branch == "detached"
    assert git_metadata(spark, str(tmp_path / "src")).branch == "unknown"


def test_streams_write_each_batch_once(spark, tmp_path):
    src = tmp_path / "t"
    tree(src)
    s = Store(spark, str(tmp_path / "s"))
    cfg = TreeConfig(str(src), include=["**/*.zig"])
    ingest_stream(stream_tree(spark, cfg, 1), s, str(tmp_path / "c")).awaitTermination()
    n, batches = s.blocks().count(), s.batches()
    batch = ingest.chunk(ingest.units_with_edges(read_tree(spark, cfg)))
    assert n == batch.count() and {r.id for r in s.blocks().collect()} == {r.id for r in batch.collect()} and s.edges().count() == 1
    s.put_blocks(spark.createDataFrame([block(X)], B))
    (src / "src" / "new.zig").write_text("fn more() void {}")
    ingest_stream(stream_tree(spark, cfg, 1), s, str(tmp_path / "c")).awaitTermination()
    assert s.blocks().count() == n + 2 and len(s.batches()) > len(batches)
    assert s.batch_for("x", 0) == s.batch_for("x", 0) != s.batch_for("x", 1)
    df = spark.createDataFrame([(1, *block(Y))], "op short, " + B)
    df.write.parquet(str(tmp_path / "ops"))
    ops_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ops")), s, str(tmp_path / "c2")).awaitTermination()
    assert s.blocks().count() == n + 3


def test_engine(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.put_blocks(spark.createDataFrame([block(X), block(Y, c="other words")], B))
    s.put_edges(spark.createDataFrame([(X, Y, 7)], E))
    e = Engine(s)
    with pytest.raises(NotRunning):
        e.find_block(X)
    with e:
        assert e.answer({"type": "ping"}) == "pong"
        text = e.answer({"type": "find_blocks", "ids": [Y, X]})
        assert text.startswith(f"Retrieved 2 blocks:\n\n{formats.BEGIN}Block 1 (ID: {Y}):\nSource: u://02\nVersion: 1\nMetadata: {{}}\nContent: other words\n{formats.END}")
        assert "Similarity: 1.000" in e.answer({"type": "semantic", "query": "other words"})
        one, two = e.traverse(X), e.traverse(X)
        assert one is two and one.blocks_traversed == 2 and e.cache.statistics().hit_rate == 0.5
        s.delete_blocks(spark.createDataFrame([(Y,)], "id string"))
        assert e.traverse(X).blocks_traversed == 1
        assert e.traverse(X, Algorithm.TOPOLOGICAL_SORT).blocks_traversed == 1
        assert e.stats.by_kind["traversal"] == 4
        with pytest.raises(InvalidQuery):
            e.answer({"type": "nonsense"})


def test_wire_protocol(spark):
    b = spark.createDataFrame([block(X), block(Y, c="zwölf")], B)
    e = spark.createDataFrame([(X, Y, 7, 0)], E + ", edge_seq long")
    item = lambda i, c: bytes.fromhex(i) + b"".join(struct.pack("<I", len(t)) + t for t in (f"u://{i[-2:]}".encode(), b"{}", c.encode()))
    with Engine(blocks=b, edges=e) as g:
        ask = lambda kind, body=b"": wire.decode_message(g.respond(wire.encode_message(kind, body)))[::2]
        assert ask("ping") == ("pong", b"trellis 1")
        assert ask("find_blocks", struct.pack("<I", 2) + bytes.fromhex(Y + X)) == ("blocks_response", struct.pack("<I", 2) + item(Y, "zwölf") + item(X, "text"))
        assert ask("traversal_query", bytes.fromhex(X)) == ("traversal_response", struct.pack("<I", 2) + item(X, "text") + item(Y, "zwölf"))
        assert ask("traversal_query", bytes.fromhex(X) + struct.pack("<BBII", 2, 1, 3, 10)) == ("traversal_response", struct.pack("<I", 1) + item(X, "text"))
        assert ask("filtered_query", bytes([1, 7]) + struct.pack("<I", 0) + struct.pack("<I", 3) + b"ext") == ("filtered_response", struct.pack("<I", 1) + item(X, "text"))
        for kind, body in (("find_blocks", b"abc"), ("find_blocks", struct.pack("<I", 0)), ("filtered_query", bytes([9, 9]) + bytes(8)), ("traversal_query", bytes(16)), ("pong", b"")):
            assert ask(kind, body)[0] == "error_response"
        assert wire.decode_message(g.respond(b"junk"))[0] == "error_response"


def test_cache_and_statistics():
    now = [0.0]
    c = QueryCache(4, 10, lambda: now[0])
    for i in range(4):
        c.put(i, str(i))
    assert c.get(0) == "0" and c.get(9) is None
    c.put(4, "4")
    assert c.get(1) is None and c.get(0) == "0" and c.statistics().evictions == 1
    now[0] = 11
    assert c.get(0) is None
    c.enable(False)
    c.put(1, 1)
    assert c.get(1) is None and c.statistics().current_entries == 0
    q = QueryStatistics()
    q.record("filtered", 2_000_000_000)
    assert q.average_latency_ns == 2_000_000_000 and q.queries_per_second == 0.5 and q.recent_ratio("filtered") == 1.0
    assert latency([1.0, 2.0, 3.0]).median == 2.0
    assert ingest.batch_size(ingest.memory_pressure(40 << 20, 0)) == 16 and ingest.memory_pressure(0, 9) == "high" and ingest.memory_pressure(32 << 20, 5) == "low"


def test_formats():
    text = formats.prometheus({"blocks_written": 3})
    assert "trellis_blocks_written_total 3" in text and "trellis_up 0" in formats.prometheus({}, up=False)
    assert "Blocks: 3 written" in formats.metrics_text({"blocks_written": 3})


def test_command_line(spark, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s")]
    tree(tmp_path / "t")
    assert main([*at, "version"], spark) == 0
    assert main([*at, "ingest", str(tmp_path / "t")], spark) == 0
    assert main([*at, "status", "--format", "json"], spark) == 0
    assert main([*at, "list-blocks", "--limit", "3"], spark) == 0
    assert main([*at, "query", "--contains", "setup_logging"], spark) == 0
    assert main([*at, "analyze", str(tmp_path / "t"), "--call", "validate"], spark) == 0
    out = capsys.readouterr().out
    assert "trellis" in out and '"blocks_written": 8' in out and "matching blocks" in out and "validate: 2" in out


def test_a_batch_of_more_tasks_than_places_keeps_its_order(spark, tmp_path, monkeypatch):
    from trellis.operators import store as module

    rows = [block(f"{i + 1:032x}", c=str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, B).repartition(8)
    monkeypatch.setattr(module, "TASK_BITS", 1)
    s = Store(spark, str(tmp_path / "s"))
    s.put_blocks(df)
    s.put_blocks(spark.createDataFrame([block(f"{1:032x}", c="later")], B))
    seq = [r.seq for r in s.ops().orderBy("seq").collect()]
    assert len(set(seq)) == 41 and [q - seq[0] for q in seq[:40]] == list(range(40))
    assert s.blocks().where(f"id = '{1:032x}'").first().content == "later"


def test_two_writers_never_take_one_batch_and_a_snapshot_waits_for_the_slow_one(spark, tmp_path):
    one, two = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    slow = one._claim()
    fast = two.append(spark.createDataFrame([block(Y)], B).withColumn("op", F.lit(1)))
    assert slow != fast
    one.compact()
    one.append(spark.createDataFrame([block(X)], B).withColumn("op", F.lit(1)), slow)
    assert {r.id for r in two.blocks().collect()} == {X, Y}
    assert two.compact() == fast and {r.id for r in one.blocks().collect()} == {X, Y}
    with pytest.raises(Exception):
        one.append(spark.createDataFrame([(1,)], "op int").select(F.raise_error(F.lit("broken")).alias("id"), F.lit(1).alias("op")))
    assert not one._children("claims")[-1:] or int(max(one._children("claims"), key=int)) == fast


SOURCES = [
    ("r0", "src/main.zig", ["fn a() void {", "    x();", "}", "const c = y();", "fn b() void { z(); }"]),
    ("r1", "src/main.zig", ['const util = @import("lib/util.zig");', "fn a() void {", "    y(); util.y();", "}", "pub fn y() void {}"]),
    ("r1", "src/lib/util.zig", ["pub fn y() void {}", "fn x() void {}"]),
    ("r0", "src/x.zig", ["fn x() void {}"]),
]


def sources(spark, rows=SOURCES):
    return spark.createDataFrame([("\n".join(t), "text/zig", {"repository_path": r, "file_path": p}, 0) for r, p, t in rows], "data string, content_type string, metadata map<string,string>, timestamp_ns long")


def test_repositories_with_equal_paths_stay_apart(spark):
    calls = {(r.file.replace("\n", "/"), r.id.split(":")[1], r.target_id) for r in ingest.call_edges(sources(spark)).collect()}
    assert calls == {("r0/src/main.zig", "a", "x"), ("r0/src/main.zig", "b", "z"), ("r1/src/main.zig", "a", "y")}
    units = ingest.units_with_edges(sources(spark)).cache()
    named = {r.id: (r.repository, r.at, r.name) for r in units.select(ingest.block_id("unit").alias("id"), "repository", F.col("location.file_path").alias("at"), "name").collect()}
    assert len(named) == units.count()
    edges = {(named[r.source_id], named[r.target_id]) for r in ingest.resolve_edges(units).collect()}
    assert edges == {
        (("r0", "src/main.zig", "a"), ("r0", "src/x.zig", "x")), (("r1", "src/main.zig", "a"), ("r1", "src/main.zig", "y")), (("r1", "src/main.zig", "a"), ("r1", "src/lib/util.zig", "y")),
    }


def test_sources_without_a_path_are_files_of_their_own(spark):
    rows = [("fn a() void {\n one();\n}", "text/zig", {}, 0), ("fn b() void {\n two();\n}", "text/zig", {}, 0), (None, "text/zig", None, 0)]
    got = ingest.call_edges(spark.createDataFrame(rows, "data string, content_type string, metadata map<string,string>, timestamp_ns long")).collect()
    assert {(r.id, r.target_id) for r in got} == {("unknown.zig:a", "one"), ("unknown.zig:b", "two")}


def test_a_run_goes_on_after_a_source_that_fails(spark, tmp_path):
    class Given:
        def __init__(self, rows):
            self.rows = rows

        def read(self, spark):
            return sources(spark, self.rows) if self.rows else spark.read.parquet("/no/such/place")

    store = Store(spark, str(tmp_path / "s"))
    r = ingest.ingest(spark, store, [Given(SOURCES[:2]), Given(None), Given(SOURCES[2:])])
    assert (r.sources_processed, r.sources_failed, r.texts_parsed) == (2, 1, 4) and len(r.errors) == 1
    assert r.blocks_created == store.blocks().count() and r.edges_created == store.edges().count()
    assert ingest.ingest(spark, store, [Given(None), Given(SOURCES)], continue_on_error=False).sources_processed == 0


def test_calls_are_linked_across_loads(spark, tmp_path):
    """A call of a stored function is linked at once, one of a function that comes later by relink()."""
    s = Store(spark, str(tmp_path / "s"))
    load = lambda rows: ingest.ingest(spark, s, [type("Given", (), {"read": lambda self, spark: sources(spark, rows)})()])
    load([("r", "a.zig", ["fn a() void {", "    b();", "}"])])
    assert s.edges().count() == 0 and ingest.relink(s) == 0
    load([("r", "b.zig", ["fn b() void {}"])])
    assert ingest.relink(s) == 1 and s.edges().count() == 1 and ingest.relink(s) == 0
    units = ingest.units_with_edges(sources(spark, [("r", "c.zig", ["fn c() void {", "    a();", "}"])]))
    known = ingest.symbols_of(ingest.stored_units(s.blocks()))
    assert ingest.resolve_edges(units).count() == 0 and ingest.resolve_edges(units, known=known).count() == 1
