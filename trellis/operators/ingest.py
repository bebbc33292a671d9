"""From source texts to blocks and edges: line patterns find units, units become blocks, names in edges become ids.

All of it is built of JVM expressions: lines are exploded with their numbers, patterns are regular expressions, and
calls of a function's body are found by a running count of braces over the lines of its file: the body ends where the
count falls back to what it was at the function's line.  Files are told apart by repository and path; a source without
a path is a file of its own, told apart by its text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..model import EdgeType, checkpointed, edge_type_name

SOURCE_TYPES = ("text/zig", "text/x-zig", "application/x-zig")
#: Names whose calls the literal parser knows, as they must stand in a line.
LITERAL_CALLS = {"setup_logging": "setup_logging(", "validate": "validate()"}
KEYWORDS = "if while for switch fn return and or catch orelse try"


@dataclass(frozen=True)
class ParserConfig:
    include_tests: bool = True
    include_private: bool = True


@dataclass(frozen=True)
class ChunkerConfig:
    id_prefix: str = "unit"
    block_version: int = 1
    max_unit_bytes: int = 32 << 10
    include_source_location: bool = True
    preserve_unit_metadata: bool = True


def supports(content_type: Column, path: Column) -> Column:
    return content_type.isin(*SOURCE_TYPES) | F.endswith(path, F.lit(".zig"))


def source_path(semantics: str = "contract") -> Column:
    key = "path" if semantics == "literal" else "file_path"
    return F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("unknown.zig"))


def lines_of(sources: DataFrame, semantics: str = "contract") -> DataFrame:
    """(file, repository, file_path, line_no from 1, line) of supported sources; file tells sources apart."""
    of = lambda k: F.try_element_at("metadata", F.lit(k))
    path, data = F.coalesce(of("file_path"), of("path")), F.coalesce("data", F.lit(""))
    repository = F.coalesce(of("repository_path"), F.lit(""))
    file = F.concat_ws("\n", repository, F.coalesce(path, F.sha2(data, 256)))
    kept = sources.where(supports(F.col("content_type"), F.coalesce(path, F.lit("")))).select(file.alias("file"), repository.alias("repository"), source_path(semantics).alias("file_path"), data.alias("data"))
    return kept.select("file", "repository", "file_path", F.posexplode(F.split("data", "\n")).alias("pos", "line")).select("file", "repository", "file_path", (F.col("pos") + 1).alias("line_no"), "line")


def _unit(kind: str, when: Column, id_: Column, name: Column, metadata: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("unit_type"), id_.alias("id"), name.alias("name"), metadata.alias("metadata")))


def parse_units(sources: DataFrame, config: ParserConfig = ParserConfig(), semantics: str = "contract") -> DataFrame:
    """(file, repository, id, unit_type, name, content, location, metadata) of each unit; a line may give several."""
    line = lines_of(sources, semantics).withColumn("t", F.trim("line"))
    t, has = F.col("t"), lambda s: F.contains(F.col("line"), F.lit(s))
    visibility = F.when(F.startswith(t, F.lit("pub ")), "public").otherwise("private")
    name_after = lambda word, end, other: F.coalesce(F.nullif(F.trim(F.regexp_extract(t, f"{quoted(word)}(.*?){quoted(end)}", 1)), F.lit("")), F.lit(other))
    path, no = F.col("file_path"), F.col("line_no").cast("string")
    fn = F.trim(F.regexp_extract(t, r"fn (.*?)\(", 1))
    const = name_after("const ", " =", "anonymous")
    shown = F.map_from_arrays(F.array(F.lit("visibility")), F.array(visibility))
    method = F.map_concat(shown, F.when(has("self: "), F.create_map(F.lit("is_method"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>")))
    units = F.array(
        _unit("import", F.startswith(t, F.lit('const std = @import("std");')) | F.startswith(t, F.lit("@import(")), F.concat(F.lit("import_"), no), F.lit(""), F.create_map(F.lit("visibility"), F.lit("public"))),
        _unit("function", has("fn ") & t.rlike(r"fn .*?\("), F.concat(path, F.lit(":"), fn), fn, method),
        _unit("type", has("struct {") | has("= struct"), F.concat(path, F.lit(":"), const), const, shown),
        _unit("constant", has("const ") & has(" = ") & ~has("@import"), F.concat(path, F.lit(":"), name_after("const ", " =", "unknown")), name_after("const ", " =", "unknown"), shown),
        _unit("test", has("test ") & F.lit(config.include_tests), F.concat(F.lit("test:"), path, F.lit(":"), no), name_after('test "', '"', "anonymous test"), F.create_map(F.lit("test_type"), F.lit("unit"))),
    )
    location = F.struct(path.alias("file_path"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.lit(1).alias("col_start"), (F.octet_length("line") + 1).alias("col_end"))
    out = line.select("file", "repository", t.alias("content"), location.alias("location"), F.explode(F.array_compact(units)).alias("u")).select("file", "repository", "u.id", "u.unit_type", "u.name", "content", "location", "u.metadata")
    if not config.include_private and semantics != "literal":
        out = out.where(F.coalesce(F.try_element_at("metadata", F.lit("visibility")), F.lit("public")) == "public")
    return out


def bare(line: Column) -> Column:
    """A line without its comment and texts."""
    return F.regexp_replace(line, r"//.*$|\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)'", "")


def call_edges(sources: DataFrame, semantics: str = "contract") -> DataFrame:
    """(file, id, target_id, edge_type, qualifier) of calls in the bodies of functions, targets by name.

    A body is what stands between the braces after the function's line, a function within another's body ends the outer
    one's.  `literal` knows two names only; otherwise any identifier before a parenthesis counts, one after a dot as a
    method's, with the identifier before the dot as its qualifier.
    """
    lines = lines_of(sources, semantics)
    is_fn = F.contains("line", F.lit("fn ")) & F.col("line").rlike(r"fn .*?\(")
    own = F.when(is_fn, F.struct(F.concat(F.col("file_path"), F.lit(":"), F.trim(F.regexp_extract(F.trim("line"), r"fn (.*?)\(", 1))).alias("id"), F.col("depth").alias("depth")))
    text = bare(F.col("line"))
    count = lambda c: F.regexp_count(text, F.lit(c))
    order = Window.partitionBy("file").orderBy("line_no")
    depth = F.coalesce(F.sum(count(r"\{") - count(r"\}")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = lines.withColumn("depth", depth).withColumn("fn", F.last(own, ignorenulls=True).over(order))
    # what follows the opening brace on the function's own line is body as well
    body = F.when(is_fn, F.regexp_replace(F.regexp_replace("line", r"^.*?fn .*?\(", ""), r"^[^{]*", "")).otherwise(F.col("line"))
    inside = inside.where(F.col("fn").isNotNull() & (is_fn | (F.col("depth") > F.col("fn.depth")))).select("file", F.col("fn.id").alias("id"), body.alias("line"))
    if semantics == "literal":
        hits = F.array_compact(F.array(*(F.when(F.contains("line", F.lit(s)), F.struct(F.lit(n).alias("target_id"), F.lit(int(EdgeType.CALLS)).alias("edge_type"), F.lit("").alias("qualifier"))) for n, s in LITERAL_CALLS.items())))
    else:
        words = F.regexp_extract_all(bare(F.col("line")), F.lit(r"((?:[A-Za-z_][A-Za-z0-9_]*)?\.?[A-Za-z_][A-Za-z0-9_]*)\("), 1)
        words = F.filter(words, lambda w: ~w.isin(*KEYWORDS.split()))
        dot = lambda w: F.instr(w, ".")
        hits = F.transform(words, lambda w: F.struct(F.substring_index(w, ".", -1).alias("target_id"), F.when(dot(w) > 0, int(EdgeType.CALLS_METHOD)).otherwise(int(EdgeType.CALLS_FUNCTION)).alias("edge_type"), F.when(dot(w) > 0, F.substring_index(w, ".", 1)).otherwise("").alias("qualifier")))
    return inside.select("file", "id", F.explode(hits).alias("e")).select("file", "id", "e.target_id", F.col("e.edge_type").cast("short").alias("edge_type"), "e.qualifier").distinct()


def imports_of(sources: DataFrame, semantics: str = "contract") -> DataFrame:
    """(file, alias, imported) of lines `const alias = @import("path");`: the file that is meant, by its path from the folder of the file."""
    shape = r'^(?:pub )?const ([A-Za-z_][A-Za-z0-9_]*) = @import\("([^"]+\.[a-z]+)"\)'
    line = lines_of(sources, semantics).withColumn("t", F.trim("line")).where(F.col("t").rlike(shape))
    here, to = F.regexp_replace(F.substring_index("file", "\n", -1), r"[^/]*$", ""), F.regexp_extract("t", shape, 2)
    up = F.regexp_count(to, F.lit(r"\.\./"))
    folders = F.filter(F.split(here, "/"), lambda x: x != "")
    kept = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - up, F.lit(0)))
    path = F.concat_ws("/", kept, F.regexp_replace(to, r"^(\.{1,2}/)+", ""))
    return line.select("file", F.regexp_extract("t", shape, 1).alias("alias"), F.concat_ws("\n", "repository", path).alias("imported")).distinct()


def units_with_edges(sources: DataFrame, config: ParserConfig = ParserConfig(), semantics: str = "contract") -> DataFrame:
    """Units with an array of their edges (target_id, edge_type, imported: the file that a call's qualifier stands for, or empty)."""
    calls = call_edges(sources, semantics).join(imports_of(sources, semantics).withColumnRenamed("alias", "qualifier"), ["file", "qualifier"], "left")
    calls = calls.groupBy("file", "id").agg(F.sort_array(F.collect_set(F.struct("target_id", "edge_type", F.coalesce("imported", F.lit("")).alias("imported")))).alias("edges"))
    units = parse_units(sources, config, semantics).join(calls, ["file", "id"], "left")
    none = F.array().cast("array<struct<target_id:string,edge_type:smallint,imported:string>>")
    return units.withColumn("edges", F.when(F.col("unit_type") == "function", F.coalesce("edges", none)).otherwise(none))


def block_id(prefix: str) -> Column:
    """The first 16 bytes of a hash of prefix, file, kind, name and place; stable between runs."""
    text = F.concat_ws("_", F.lit(prefix), F.col("file"), F.col("unit_type"), F.col("id"), F.col("location.line_start"), F.col("location.col_start"))
    return F.substring(F.sha2(text, 256), 1, 32)


def chunk(units: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Blocks of units; units over the size limit are left out."""
    parts = [F.col("unit_type"), F.col("id").alias("unit_id")]
    if config.include_source_location:
        parts.append(F.col("location"))
    if config.preserve_unit_metadata:
        parts.append(F.when(F.size("metadata") > 0, F.col("metadata")).alias("original_metadata"))
    parts.append(F.when(F.col("repository") != "", F.col("repository")).alias("repository"))
    if "edges" in units.columns:
        named = F.transform("edges", lambda e: F.struct(e["target_id"].alias("target_id"), edge_type_name(e["edge_type"]).alias("edge_type"), F.nullif(e["imported"], F.lit("")).alias("imported")))
        parts.append(F.when(F.size("edges") > 0, named).alias("edges"))
    uri = F.format_string("file://%s#L%d-%d", F.col("location.file_path"), F.col("location.line_start"), F.col("location.line_end"))
    small = units.where(F.octet_length("content") <= config.max_unit_bytes)
    return small.select(block_id(config.id_prefix).alias("block_id"), F.lit(config.block_version).cast("long").alias("version"), uri.alias("source_uri"), F.to_json(F.struct(*parts)).alias("metadata_json"), "content").withColumnRenamed("block_id", "id")


def resolve_edges(units: DataFrame, config: ChunkerConfig = ChunkerConfig(), known: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, edge_type): names in units' edges as the ids of the functions so named, across files.

    A call by an imported file's name means that file's function.  Otherwise the functions of one name and kind (method
    or not) count: the last one by line of the same file, else of the same repository by file and line, else of any.
    A call that names no kind means both.  known: functions, as symbols() gives them, of units that were stored before.
    """
    symbols = symbols_of(units, config)
    symbols = symbols if known is None else symbols.unionByName(known)
    place = F.struct("file", "line")
    last = lambda *by: symbols.groupBy(*by).agg(F.max_by("target", place).alias("target"))
    calls = units.select(_own_id(units, config).alias("source_id"), "file", "repository", F.explode("edges").alias("e"))
    calls = calls.select("source_id", "file", "repository", F.col("e.target_id").alias("name"), F.col("e.edge_type").alias("edge_type"), F.col("e.imported").alias("imported"))
    kind = F.col("edge_type") == int(EdgeType.CALLS_METHOD)
    calls = calls.withColumn("method", F.explode(F.when(F.col("edge_type") == int(EdgeType.CALLS), F.array(F.lit(False), F.lit(True))).when(F.col("imported") != "", F.array(F.lit(False))).otherwise(F.array(kind))))
    named = calls.join(last("file", "name", "method").withColumnsRenamed({"file": "imported", "target": "t0"}), ["imported", "name", "method"], "left")
    for n, by in (("t1", ("file", "name", "method")), ("t2", ("repository", "name", "method")), ("t3", ("name", "method"))):
        named = named.join(last(*by).withColumnRenamed("target", n), list(by), "left")
    target = F.when(F.col("imported") != "", F.col("t0")).otherwise(F.coalesce("t1", "t2", "t3"))
    return named.select("source_id", target.alias("target_id"), "edge_type").where("target_id is not null and source_id <> target_id").distinct()


def symbols_of(units: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """(file, repository, name, method, line, target) of functions."""
    is_method = F.coalesce(F.try_element_at("metadata", F.lit("is_method")) == "true", F.lit(False))
    return units.where("unit_type = 'function'").select("file", "repository", "name", is_method.alias("method"), F.col("location.line_start").alias("line"), _own_id(units, config).alias("target"))


def _own_id(units: DataFrame, config: ChunkerConfig) -> Column:
    return F.col("block_id") if "block_id" in units.columns else block_id(config.id_prefix)


STORED = "unit_type string, unit_id string, location struct<file_path:string,line_start:int,line_end:int,col_start:int,col_end:int>, original_metadata map<string,string>, repository string, edges array<struct<target_id:string,edge_type:string,imported:string>>"


def stored_units(blocks: DataFrame) -> DataFrame:
    """Units as chunk() wrote them into blocks, with the block's id as block_id: what resolve_edges() and symbols_of() need."""
    m = blocks.select(F.col("id").alias("block_id"), F.from_json("metadata_json", STORED).alias("m")).where("m.unit_type is not null and m.location is not null").select("block_id", "m.*")
    code = F.create_map(*(F.lit(x) for t in EdgeType for x in (t.name.lower(), int(t))))
    repository = F.coalesce("repository", F.lit(""))
    edges = F.transform(F.coalesce("edges", F.array()), lambda e: F.struct(e["target_id"].alias("target_id"), code[e["edge_type"]].cast("short").alias("edge_type"), F.coalesce(e["imported"], F.lit("")).alias("imported")))
    name = F.when(F.col("unit_type") == "function", F.substring_index("unit_id", ":", -1)).otherwise("")
    return m.select("block_id", F.concat_ws("\n", repository, "location.file_path").alias("file"), repository.alias("repository"), F.col("unit_id").alias("id"), "unit_type", name.alias("name"), "location", F.coalesce("original_metadata", F.create_map().cast("map<string,string>")).alias("metadata"), edges.alias("edges"))


def relink(store, config: ChunkerConfig = ChunkerConfig()) -> int:
    """Puts the edges that the calls of all stored units mean now and that the store hasn't; how many there are.  For calls of functions
    that came into the store later than their callers."""
    found = resolve_edges(stored_units(store.blocks()), config)
    new = checkpointed(found.join(store.edges(), ["source_id", "target_id", "edge_type"], "left_anti"))
    if n := new.count():
        store.put_edges(new)
    return n


def pipeline_stats(sources: DataFrame, units: DataFrame, blocks: DataFrame) -> DataFrame:
    path = F.coalesce(F.try_element_at("metadata", F.lit("file_path")), F.lit(""))
    s = sources.agg(F.count_if(supports(F.col("content_type"), path)).alias("sources_processed"), F.count_if(~supports(F.col("content_type"), path)).alias("sources_skipped"))
    return s.withColumn("units_parsed", units.agg(F.count("*").alias("n")).scalar()).withColumn("blocks_created", blocks.agg(F.count("*").alias("n")).scalar())


def memory_pressure(memory_bytes: int, queued: int, target_bytes: int = 64 << 20, queue_limit: int = 10) -> str:
    ratio = max(memory_bytes / target_bytes, queued / queue_limit)
    return "high" if ratio > 0.8 else "medium" if ratio > 0.5 else "low"


def batch_size(pressure: str, default: int = 32) -> int:
    """Files to take at once."""
    return {"low": default, "medium": max(1, default // 2), "high": 1}[pressure]


class Source(Protocol):
    """Where texts come from: rows (data, content_type, metadata, timestamp_ns)."""

    def read(self, spark: SparkSession) -> DataFrame: ...


class Parser(Protocol):
    """What turns the texts it supports into units."""

    def supports(self, content_type: Column, path: Column) -> Column: ...

    def parse(self, sources: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """What turns units into blocks and edges."""

    def blocks(self, units: DataFrame) -> DataFrame: ...

    def edges(self, units: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class LineParser:
    """The parser of this module."""

    config: ParserConfig = ParserConfig()

    def supports(self, content_type: Column, path: Column) -> Column:
        return supports(content_type, path)

    def parse(self, sources: DataFrame) -> DataFrame:
        return units_with_edges(sources, self.config)


@dataclass(frozen=True)
class UnitChunker:
    """The chunker of this module."""

    config: ChunkerConfig = ChunkerConfig()

    def blocks(self, units: DataFrame) -> DataFrame:
        return chunk(units, self.config)

    def edges(self, units: DataFrame) -> DataFrame:
        return resolve_edges(units, self.config)


@dataclass(frozen=True)
class IngestReport:
    sources_processed: int
    sources_failed: int
    texts_parsed: int
    texts_skipped: int
    units_parsed: int
    blocks_created: int
    edges_created: int
    errors: tuple[str, ...]


def ingest(spark: SparkSession, store, sources: Sequence[Source], parsers: Sequence[Parser] = (LineParser(),), chunkers: Sequence[Chunker] = (UnitChunker(),), continue_on_error: bool = True) -> IngestReport:
    """Each source through the first parser that supports a text and all chunkers into the store; a source that fails is counted and left
    out whole, and, unless it goes on, ends the run."""
    n, errors = Counter(), []
    for source in sources:
        try:
            texts = source.read(spark)
            path = F.coalesce(F.try_element_at("metadata", F.lit("file_path")), F.lit(""))
            by = F.lit(-1)
            for i, p in reversed(list(enumerate(parsers))):
                by = F.when(F.coalesce(p.supports(F.col("content_type"), path), F.lit(False)), i).otherwise(by)
            texts = checkpointed(texts.withColumn("by", by))
            parsed = [(p, texts.where(F.col("by") == i).drop("by")) for i, p in enumerate(parsers)]
            units = [checkpointed(p.parse(t)) for p, t in parsed]
            made = [(c.blocks(u), c.edges(u)) for u in units for c in chunkers]
            counts = Counter(texts_parsed=texts.where("by >= 0").count(), texts_skipped=texts.where("by < 0").count(), units_parsed=sum(u.count() for u in units))
            for blocks, edges in made:
                before = Counter({k: store.metrics[k] for k in ("blocks_written", "edges_added")})
                store.put_blocks(blocks, for_ingestion=True)
                store.put_edges(edges)
                counts["blocks_created"] += store.metrics["blocks_written"] - before["blocks_written"]
                counts["edges_created"] += store.metrics["edges_added"] - before["edges_added"]
            n += counts
            n["sources_processed"] += 1
        except Exception as x:  # a source may fail in any way
            n["sources_failed"] += 1
            errors.append(f"{type(x).__name__}: {str(x).splitlines()[0] if str(x) else ''}")
            if not continue_on_error:
                break
    return IngestReport(*(n[f] for f in ("sources_processed", "sources_failed", "texts_parsed", "texts_skipped", "units_parsed", "blocks_created", "edges_created")), tuple(errors))
