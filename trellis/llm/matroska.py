"""Media columns: Matroska files as bytes, parsed into packet tables.

parse() walks the EBML tree (variable-length ids and sizes, unknown sizes, void and CRC elements), reads tracks,
clusters, simple blocks and block groups with all four kinds of lacing (none, Xiph, fixed, EBML), and cues.  A packet
has its track, timestamp in ns, byte range in the file, and whether it is a key frame.  mux() writes 8-bit mono PCM.

Defined results: null and empty media have no packets; bytes that aren't Matroska, or that end within an element whose
size is given, raise ValueError (parse), or give a row with the error and no packets (packet_table).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_rows, table

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x114D9B74, 0x1254C367
SCALE, ENTRY, NUMBER, UID, KIND, CODEC, LENGTH, AUDIO, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
STAMP, SIMPLE, GROUP, BLOCK, REFERENCE, POINT, TIME, PLACES, CUE_TRACK, CUE_CLUSTER = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {SEEK, INFO, TRACKS, CLUSTER, CUES, TAGS}
HZ, UNIT, FRAME, LACED, BLOCKS = 8000, 192, 960, 8, 32


def number(data, at: int, marked: bool) -> tuple[int, int]:
    """A variable-length integer and the place after it; marked: with its length marker, as in ids."""
    if at >= len(data) or not data[at]:
        raise ValueError("no EBML number")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("cut EBML number")
    x = int.from_bytes(data[at : at + n], "big")
    return (x if marked else x & ((1 << 7 * n) - 1)), at + n


def elements(data, at: int, end: int):
    """(id, start of data, end of data or None if unknown) of the elements in a range."""
    while at < end:
        kind, at = number(data, at, True)
        n = 9 - data[at].bit_length() if at < len(data) and data[at] else 0
        size, at = number(data, at, False)
        stop = None if size == (1 << 7 * n) - 1 else at + size
        if stop is not None and stop > end:
            raise ValueError("cut element")
        yield kind, at, stop
        at = end if stop is None else stop


def frames(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's content."""
    if not lacing:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:  # fixed
        if (end - at) % n:
            raise ValueError("uneven fixed lacing")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for i in range(n - 1):
            if lacing == 1:  # Xiph
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:  # EBML: a size, then signed differences
                before = at
                size, at = number(data, at, False)
                if i:
                    size += sizes[-1] - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond its block")
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def parse(data: bytes) -> dict:
    """tracks {number: fields}, packets [(track, ns, start, end, key)], clusters [ns], cues [(ns, track, place)]."""
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    out: dict = {"scale": 1_000_000, "tracks": {}, "packets": [], "clusters": [], "cues": [], "blocks": 0}
    if not data:
        return out
    if data[:4] != EBML.to_bytes(4, "big"):
        raise ValueError("no EBML header")

    def block(a: int, b: int, base: int, key: bool | None) -> None:
        track, at = number(data, a, False)
        offset, flags = struct.unpack_from(">hB", data, at)
        t = (base + offset) * out["scale"]
        step = out["tracks"].get(track, {}).get("length", 0)
        rate = out["tracks"].get(track, {}).get("byte_rate", 0)
        out["blocks"] += 1
        for s, e in frames(data, at + 3, b, flags >> 1 & 3):
            out["packets"].append((track, t, s, e, bool(flags & 0x80) if key is None else key))
            t += step or ((e - s) * 1_000_000_000 // rate if rate else 0)

    def cluster(a: int, b: int) -> int:
        base, at = 0, a
        for kind, s, e in elements(data, a, b):
            if e is None or kind in TOP:
                return at
            if kind == STAMP:
                base = uint(s, e)
                out["clusters"].append(base * out["scale"])
            elif kind == SIMPLE:
                block(s, e, base, None)
            elif kind == GROUP:
                parts = {k: (x, y) for k, x, y in elements(data, s, e)}
                block(*parts[BLOCK], base, REFERENCE not in parts)
            at = e
        return b

    def segment(a: int, b: int) -> None:
        at = a
        while at < b:
            kind, s, e = next(elements(data, at, b))
            if kind == INFO:
                out["scale"] = next((uint(x, y) for k, x, y in elements(data, s, e) if k == SCALE), 1_000_000)
            elif kind == TRACKS:
                for k, x, y in elements(data, s, e):
                    if k == ENTRY:
                        f = {i: (p, q) for i, p, q in elements(data, x, y)}
                        sound = {i: (p, q) for i, p, q in elements(data, *f[AUDIO])} if AUDIO in f else {}
                        rate = struct.unpack(">d" if sound[RATE][1] - sound[RATE][0] == 8 else ">f", data[slice(*sound[RATE])])[0] if RATE in sound else 0.0
                        depth, channels = uint(*sound[DEPTH]) if DEPTH in sound else 0, uint(*sound[CHANNELS]) if CHANNELS in sound else 1
                        out["tracks"][uint(*f[NUMBER])] = {"kind": uint(*f[KIND]), "codec": data[slice(*f[CODEC])].decode(), "rate": rate, "length": uint(*f[LENGTH]) if LENGTH in f else 0, "byte_rate": int(rate * depth * channels) // 8}
            elif kind == CUES:
                for k, x, y in elements(data, s, e):
                    if k == POINT:
                        f = {i: (p, q) for i, p, q in elements(data, x, y)}
                        g = {i: (p, q) for i, p, q in elements(data, *f[PLACES])}
                        out["cues"].append((uint(*f[TIME]) * out["scale"], uint(*g[CUE_TRACK]), a + uint(*g[CUE_CLUSTER])))
            if kind == CLUSTER:
                at = cluster(s, b if e is None else e)
            else:
                at = b if e is None else e

    for kind, s, e in elements(data, 0, len(data)):
        if kind == SEGMENT:
            segment(s, len(data) if e is None else e)
    return out


def element(kind: int, *body: bytes) -> bytes:
    data = b"".join(body)
    n = max(1, -(-(len(data) + 1).bit_length() // 7))
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (len(data) | 1 << 7 * n).to_bytes(n, "big") + data


def uint(kind: int, x: int) -> bytes:
    return element(kind, x.to_bytes(max(1, (x.bit_length() + 7) // 8), "big"))


def lace(parts: list[bytes]) -> tuple[int, bytes]:
    """(flag bits, content) of a block: fixed lacing for equal frames, EBML lacing for others."""
    if len(parts) == 1:
        return 0, parts[0]
    sizes = list(map(len, parts))
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(parts) - 1]) + b"".join(parts)
    head = [(sizes[0] | 1 << 14).to_bytes(2, "big")] + [(b - a + (1 << 13) - 1 | 1 << 14).to_bytes(2, "big") for a, b in zip(sizes, sizes[1:-1], strict=False)]
    return 0x06, bytes([len(parts) - 1]) + b"".join([*head, *parts])


def mux(payload: bytes) -> bytes:
    """A Matroska file of one track of 8-bit mono PCM: laced simple blocks in clusters, the last block in a group, and cues."""
    head = element(EBML, uint(0x4286, 1), uint(0x42F7, 1), uint(0x42F2, 4), uint(0x42F3, 8), element(0x4282, b"matroska"), uint(0x4287, 4), uint(0x4285, 2))
    info = element(INFO, uint(SCALE, 1_000_000), element(0x4D80, b"trellis"), element(0x5741, b"trellis"))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1), uint(UID, 1), uint(KIND, 2), uint(0x9C, 1), element(CODEC, b"A_PCM/INT/LIT"), element(AUDIO, element(RATE, struct.pack(">d", HZ)), uint(CHANNELS, 1), uint(DEPTH, 8))))
    clusters, cues, at, step = [], [], len(info) + len(tracks), FRAME * LACED
    for a in range(0, len(payload), step * BLOCKS):
        ms, body = a * 1000 // HZ, []
        for b in range(a, min(len(payload), a + step * BLOCKS), step):
            flags, data = lace([payload[i : min(i + FRAME, b + step)] for i in range(b, min(len(payload), b + step), FRAME)])
            block = b"\x81" + struct.pack(">h", b * 1000 // HZ - ms)
            body.append(element(SIMPLE, block, bytes([0x80 | flags]), data) if b + step < len(payload) else element(GROUP, element(BLOCK, block, bytes([flags]), data)))
        clusters.append(element(CLUSTER, uint(STAMP, ms), *body))
        cues.append(element(POINT, uint(TIME, ms), element(PLACES, uint(CUE_TRACK, 1), uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return head + element(SEGMENT, info, tracks, *clusters, element(CUES, *cues))


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each packet of the media column: key, track, ns, start, size, keyframe; one with an error for bad media."""
    def run(found):
        for k, data in found:
            try:
                for track, ns, s, e, is_key in parse(data or b"")["packets"]:
                    yield k, track, ns, s, e - s, is_key, None
            except (ValueError, IndexError, KeyError, struct.error) as x:
                yield k, None, None, None, None, None, str(x) or type(x).__name__

    fields = [("key", pa.int64()), ("track", pa.int64()), ("ns", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("error", pa.string())]
    return map_rows(df.select(F.col(key).cast("long"), F.col(media).cast("binary")), run, fields, "key long, track long, ns long, start long, size long, keyframe boolean, error string", 4096)


def stored(text: bytes) -> tuple:
    payload = text + b" " * (-len(text) % UNIT or (0 if text else UNIT))
    media = mux(payload)
    found = parse(media)
    back = b"".join([media[s:e] for _, _, s, e, _ in found["packets"]])
    if back != payload:
        raise ValueError("the stored packets aren't the payload")
    index = zlib.crc32(b"".join([struct.pack("<qqqq?", *p) for p in found["packets"]]))
    in_place = all(media[p : p + 4] == CLUSTER.to_bytes(4, "big") for _, _, p in found["cues"])
    feature = f"clusters={len(found['clusters'])};blocks={found['blocks']};packets={len(found['packets'])};ns={found['packets'][-1][1]};cues={len(found['cues'])}{'' if in_place else '?'};index={index:08x}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op9(spark, sf_dir: str) -> DataFrame:
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(documents(table(spark, sf_dir, "documents")), lambda found: ((i, *stored(t)) for i, t in found), fields, ddl, 4096)
