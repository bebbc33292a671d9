"""Binary formats: blocks, edges, log entries, protocol headers and lists of blocks; little-endian throughout.

Encoders and block checks are Column expressions (hex of numbers, CRC-32 on the JVM).  Decoding untrusted bytes into
rows uses one Arrow function over batches, with an error column instead of exceptions.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MAX_CONTENT, MAX_METADATA, MAX_URI, EdgeType

#: Fixed values of the format.
MAGIC, FORMAT_VERSION, HEADER, EDGE_SIZE = 0x42444358, 1, 64, 40
MESSAGES = {"ping": 0x01, "find_blocks": 0x02, "filtered_query": 0x03, "traversal_query": 0x04, "pong": 0x81, "blocks_response": 0x82, "filtered_response": 0x83, "traversal_response": 0x84, "error_response": 0xFF}
ENTRY_TYPES = {"put_block": 1, "delete_block": 2, "put_edge": 3}


def little(n: Column, size: int) -> Column:
    """A non-negative number as `size` bytes, the lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size))))


def encode_block() -> Column:
    """The 64-byte header and the three texts of a block row."""
    texts = [F.col(c).cast("binary") for c in ("source_uri", "metadata_json", "content")]
    body = F.concat(*texts)
    sizes = [little(F.octet_length(t), n) for t, n in zip(texts, (4, 4, 8), strict=True)]
    head = F.lit(struct.pack("<IHH", MAGIC, FORMAT_VERSION, 0))
    return F.concat(head, F.unhex("id"), little(F.col("version"), 8), *sizes, little(F.crc32(body), 4), F.lit(bytes(12)), body)


def encode_edge() -> Column:
    return F.concat(F.unhex("source_id"), F.unhex("target_id"), little(F.col("edge_type"), 2), F.lit(bytes(6)))


def encode_list_item() -> Column:
    """A block in a response: id, then each text after its length."""
    texts = [F.col(c).cast("binary") for c in ("source_uri", "metadata_json", "content")]
    return F.concat(F.unhex("id"), *(x for t in texts for x in (little(F.octet_length(t), 4), t)))


def block_list(found: DataFrame) -> bytes:
    """A response's body: the number of blocks and each of them, in their order; results are bounded by the query's limit."""
    items = [bytes(r.raw) for r in found.select(encode_list_item().alias("raw")).toLocalIterator()]
    return struct.pack("<I", len(items)) + b"".join(items)


def read_block(raw: bytes) -> tuple:
    """(error, id, version, source_uri, metadata_json, content)."""
    bad = lambda e: (e, None, None, None, None, None)
    if raw is None or len(raw) < HEADER:
        return bad("BufferTooSmall")
    magic, fmt, _, id_, version, n_uri, n_meta, n_content, crc = struct.unpack_from("<IHH16sQIIQI", raw)
    if magic != MAGIC:
        return bad("InvalidMagic")
    if fmt != FORMAT_VERSION:
        return bad("UnsupportedVersion")
    for n, most, name in ((n_uri, MAX_URI, "InvalidSourceUriLength"), (n_meta, MAX_METADATA, "InvalidMetadataLength"), (n_content, MAX_CONTENT, "InvalidContentLength")):
        if n > most:
            return bad(name)
    ends = [HEADER, HEADER + n_uri, HEADER + n_uri + n_meta, HEADER + n_uri + n_meta + n_content]
    if len(raw) < ends[-1]:
        return bad("IncompleteData")
    if zlib.crc32(raw[HEADER : ends[-1]]) != crc:
        return bad("InvalidChecksum")
    if version >= 1 << 63:
        return bad("InvalidVersion")
    texts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    try:
        return (None, id_.hex(), version, texts[0].decode(), texts[1].decode(), texts[2].decode(errors="replace"))
    except UnicodeDecodeError:
        return bad("InvalidUtf8")


def read_edge(raw: bytes) -> tuple:
    """(error, source_id, target_id, edge_type)."""
    if raw is None or len(raw) < EDGE_SIZE:
        return "BufferTooSmall", None, None, None
    a, b, kind = struct.unpack_from("<16s16sH", raw)
    return (None, a.hex(), b.hex(), kind) if kind in set(EdgeType) else ("InvalidEdgeType", None, None, None)


def _decoded(df: DataFrame, column: str, read, ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [read(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return df.select(F.col(column)).mapInArrow(run, ddl)


def decode_blocks(df: DataFrame, column: str) -> DataFrame:
    s = pa.string()
    return _decoded(df, column, read_block, "error string, id string, version long, source_uri string, metadata_json string, content string", pa.schema([("error", s), ("id", s), ("version", pa.int64()), ("source_uri", s), ("metadata_json", s), ("content", s)]))


def decode_edges(df: DataFrame, column: str) -> DataFrame:
    s = pa.string()
    return _decoded(df, column, read_edge, "error string, source_id string, target_id string, edge_type short", pa.schema([("error", s), ("source_id", s), ("target_id", s), ("edge_type", pa.int16())]))


def encode_entry(kind: str, payload: bytes) -> bytes:
    """A log entry: checksum of 8 bytes (CRC-32 here), kind, length, payload."""
    body = bytes([ENTRY_TYPES[kind]]) + payload
    return struct.pack("<QBI", zlib.crc32(body), ENTRY_TYPES[kind], len(payload)) + payload


def decode_entry(raw: bytes) -> tuple[str, bytes]:
    if len(raw) < 13:
        raise ValueError("BufferTooSmall")
    crc, code, n = struct.unpack_from("<QBI", raw)
    names = {v: k for k, v in ENTRY_TYPES.items()}
    if code not in names:
        raise ValueError("InvalidEntryType")
    if len(raw) < 13 + n:
        raise ValueError("BufferTooSmall")
    payload = raw[13 : 13 + n]
    if zlib.crc32(bytes([code]) + payload) != crc:
        raise ValueError("InvalidChecksum")
    return names[code], payload


def encode_message(kind: str, payload: bytes = b"", version: int = 1) -> bytes:
    return struct.pack("<BBHI", MESSAGES[kind], version, 0, len(payload)) + payload


def decode_message(raw: bytes) -> tuple[str, int, bytes]:
    """(kind, protocol version, payload)."""
    if len(raw) < 8:
        raise ValueError("InvalidRequest")
    code, version, _, n = struct.unpack_from("<BBHI", raw)
    kind = next((k for k, v in MESSAGES.items() if v == code), None)
    if kind is None or len(raw) < 8 + n:
        raise ValueError("InvalidRequest")
    return kind, version, raw[8 : 8 + n]
