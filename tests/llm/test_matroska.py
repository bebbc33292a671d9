import hashlib
import random
import struct
import zlib

import pytest

from tests.llm.helpers import corpus
from trellis.llm import matroska as m


def test_round_trip_of_all_sizes():
    r = random.Random(2)
    for n in [192, 960, 1152, 7680, 7872, 245_760, 245_952, 192 * 5000]:
        payload = r.randbytes(n)
        media = m.mux(payload)
        found = m.parse(media)
        assert b"".join(media[a:b] for _, _, a, b, _ in found["packets"]) == payload
        times = [t for _, t, *_ in found["packets"]]
        assert times == sorted(times) and all(abs(t - k * 960 * 125_000) <= 1_000_000 for k, t in enumerate(times))
        assert found["tracks"][1]["rate"] == 8000.0 and found["tracks"][1]["codec"] == "A_PCM/INT/LIT"
        assert all(media[p : p + 4] == bytes.fromhex("1F43B675") for _, _, p in found["cues"]) and len(found["cues"]) == len(found["clusters"])


def el(kind: str, *body: bytes, wide: int = 8) -> bytes:
    data = b"".join(body)
    return bytes.fromhex(kind) + (len(data) | 1 << 7 * wide).to_bytes(wide, "big") + data


def file(*clusters: bytes, unknown: bool = False) -> bytes:
    track = el("1654AE6B", el("AE", el("D7", b"\2"), el("73C5", b"\7"), el("83", b"\2"), el("86", b"A_OPUS"), el("23E383", struct.pack(">I", 20_000_000)), el("EC", b"pad")))
    body = el("1549A966", el("2AD7B1", struct.pack(">I", 500_000))) + el("EC", bytes(9)) + track + b"".join(clusters)
    return el("1A45DFA3", el("4286", b"\1")) + (bytes.fromhex("18538067") + b"\xff" + body if unknown else el("18538067", body))


@pytest.mark.parametrize("unknown", [False, True])
def test_lacing_groups_and_unknown_sizes(unknown):
    frames = [b"a" * 300, b"b" * 3, b"c" * 255, b"d" * 40]
    xiph = b"\3" + b"\xff\x2d" + b"\x03" + b"\xff\x00" + b"".join(frames)
    ebml = b"\3" + b"\x41\x2c" + struct.pack(">H", 0x4000 | (3 - 300 + 8191)) + struct.pack(">H", 0x4000 | (255 - 3 + 8191)) + b"".join(frames)
    fixed = b"\2" + b"xxyyzz"
    head = lambda t, flags: b"\x82" + struct.pack(">hB", t, flags)
    blocks = el("A3", head(0, 0x82), xiph), el("A3", head(4, 0x06), ebml), el("A0", el("A1", head(8, 0x04), fixed), el("FB", b"\1")), el("A3", head(-2, 0), b"one")
    cluster = (bytes.fromhex("1F43B675") + b"\xff" + el("E7", b"\x0a") + b"".join(blocks)) if unknown else el("1F43B675", el("E7", b"\x0a"), *blocks)
    second = el("1F43B675", el("E7", b"\x64"), el("A0", el("A1", head(0, 0), b"last")))
    data = file(cluster, second, unknown=unknown)
    found = m.parse(data)
    got = [(data[a:b], t, key) for _, t, a, b, key in found["packets"]]
    at = lambda ticks, k=0: ticks * 500_000 + k * 20_000_000
    assert [x[0] for x in got] == [*frames, *frames, b"xx", b"yy", b"zz", b"one", b"last"]
    assert [x[1] for x in got] == [*(at(10, k) for k in range(4)), *(at(14, k) for k in range(4)), *(at(18, k) for k in range(3)), at(8), at(100)]
    assert [x[2] for x in got] == [True] * 4 + [False] * 4 + [False] * 3 + [False, True]
    assert found["clusters"] == [at(10), at(100)]


def test_bad_media_give_errors_not_crashes(spark):
    good = m.mux(b"x" * 384)
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF"), (5, good[:-3]), (6, good[:60]), (None, good)]
    got = m.packet_table(spark.createDataFrame(rows, "key long, media binary"), "key", "media").collect()
    assert {r.key for r in got if r.error} == {4, 5, 6} and {r.key for r in got if r.error is None} == {1, None}
    r = random.Random(3)
    for _ in range(500):
        data = bytearray(good)
        for _ in range(3):
            data[r.randrange(len(data))] = r.randrange(256)
        try:
            m.parse(bytes(data))
        except (ValueError, IndexError, KeyError, struct.error):
            pass


def test_query_columns(spark):
    for _, t in corpus():
        raw = (t or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        n, size, sha, tail, _, _, feature = m.stored(raw)
        assert (n, size, sha, tail) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert feature.startswith("clusters=") and "?" not in feature
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = m.op9(spark, d).collect()
    assert {r.doc_id for r in got} == set(docs) and all(r.n_bytes == len(docs[r.doc_id].encode()) and r.payload_bytes % 192 == 0 for r in got)
