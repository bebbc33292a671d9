"""Source trees: files by glob, with content types and what version control says of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.text import content_type

#: What is read and left out by default.
INCLUDE = ["**/*.zig", "**/*.md", "**/*.txt", "**/*.json", "**/*.toml", "**/*.yaml", "**/*.yml"]
EXCLUDE = [".git/*", "*.bin", "*.exe", "*.so", "*.dylib", "*.dll", "zig-cache/*", "zig-out/*"]
MAX_FILE = 10 << 20


@dataclass(frozen=True)
class TreeConfig:
    path: str
    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    max_file_bytes: int = MAX_FILE
    include_metadata: bool = True


@dataclass(frozen=True)
class GitMetadata:
    commit_hash: str = "unknown"
    branch: str = "unknown"


def _read(spark: SparkSession, path: str) -> str | None:
    """A small text through Spark's file systems; None if it can't be read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return None
    return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 1024)).first()[0]).decode(errors="replace").strip()


def git_metadata(spark: SparkSession, root: str) -> GitMetadata:
    """Branch and commit that HEAD names; a bare commit is a detached branch; what can't be read is unknown."""
    head = _read(spark, f"{root}/.git/HEAD")
    if head is None:
        return GitMetadata()
    if head.startswith(prefix := "ref: refs/heads/"):
        branch = head.removeprefix(prefix)
        return GitMetadata(_read(spark, f"{root}/.git/refs/heads/{branch}") or "unknown", branch)
    return GitMetadata(head[:40], "detached") if len(head) >= 40 else GitMetadata()


def relative(path: Column, root: str) -> Column:
    """The part of a file's address after the root folder."""
    bare = F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?", "")
    base = root.split(":", 1)[1] if ":" in root else root
    return F.substring(bare, len("/" + base.strip("/")) + 2, 1 << 20)


def wanted(path: Column, config: TreeConfig) -> Column:
    """Included and not excluded; a folder excluded by `name/*` takes all below it."""
    folders = [e.removesuffix("*") + "**" for e in config.exclude if e.endswith("/*")]
    return matches_any(path, config.include) & ~matches_any(path, [*config.exclude, *folders])


def _files(df: DataFrame, config: TreeConfig, git: GitMetadata) -> DataFrame:
    df = df.select(relative(F.col("path"), config.path).alias("p"), "length", "modificationTime", "content")
    df = df.where((F.col("length") <= config.max_file_bytes) & wanted(F.col("p"), config))
    pairs = [F.lit("repository_path"), F.lit(config.path), F.lit("file_path"), F.col("p"), F.lit("file_size"), F.col("length").cast("string")]
    if config.include_metadata:
        pairs += [F.lit("commit_hash"), F.lit(git.commit_hash), F.lit("branch"), F.lit(git.branch)]
    text = F.try_validate_utf8(F.col("content").cast("string"))
    fixed = F.make_valid_utf8(F.col("content").cast("string"))
    ns = (F.unix_micros("modificationTime") * 1000).alias("timestamp_ns")
    return df.select(fixed.alias("data"), content_type(F.col("p")).alias("content_type"), F.create_map(*pairs).alias("metadata"), ns, text.isNull().alias("replaced"))


def read_tree(spark: SparkSession, config: TreeConfig) -> DataFrame:
    """(data, content_type, metadata, timestamp_ns, replaced): one row for each wanted file, in order of path.

    Length and path are filtered before contents are read.  Bytes that aren't UTF-8 are replaced, and marked so.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(config.path)
    return _files(df, config, git_metadata(spark, config.path)).orderBy(F.col("metadata")["file_path"])


def stream_tree(spark: SparkSession, config: TreeConfig, max_files: int = 32) -> DataFrame:
    """The same as a stream, so many files in a batch at most."""
    schema = spark.read.format("binaryFile").load(config.path).schema
    df = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(config.path)
    return _files(df, config, git_metadata(spark, config.path))
