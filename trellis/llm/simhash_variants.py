"""SimHash near-duplicates by deletion variants.

A fingerprint of 64 bits is cut into two segments of 32: of two fingerprints that differ in at most three bits, one
segment differs in at most one.  Each distinct fingerprint is indexed under every variant of either segment with one
bit masked (64 rows); equal variants meet in an equality shuffle and are verified by the Hamming distance of the whole.
A pair is reported by just one of the variants it shares.  Runs of a variant are compared in vectors; a long run is
first split again by variants of the other segment, and of each run only a spanning forest of links is emitted, so
no group makes more links than it has members.

Defined results: a null text is empty; texts without words have fingerprint zero and are linked like others; rows
that repeat a doc_id each get a row; a null doc_id is linked, and never the least of its component unless alone.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, checkpointed, components, documents, map_rows, table, trimmed

SEED, MOST = 42, 3
#: Members of a run that are compared outright; longer ones are split first.
RUN = 8192


def shingles(words: list[bytes], k: int) -> list[int]:
    """XXH64 of each run of k words joined by a space; of all words where there are fewer."""
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    return [h(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[k - 1 :], strict=False)]


def fingerprint(hashes) -> int:
    """Signed 64 bits: a bit is set if it is in over half the hashes; zero without hashes."""
    h = np.array(hashes, np.uint64)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of each row."""
    def run(found):
        for doc_id, text in found:
            yield doc_id, fingerprint(shingles(text.lower().split(), k))

    return map_rows(documents(docs), run, [("doc_id", pa.int64()), ("fp", pa.int64())], "doc_id long, fp long", 4096)


def bits(x: np.ndarray) -> np.ndarray:
    """Set bits of each number; of a negative one those of its two's complement."""
    return np.bitwise_count(x.view(np.uint64))


def forest(x: np.ndarray, admits) -> list[tuple[int, int]]:
    """Links of a spanning forest over x, by pairs that admits(one, many) marks."""
    label, out = np.arange(len(x)), []
    for i in range(len(x) - 1):
        near = np.flatnonzero(admits(x[i], x[i + 1 :])) + i + 1
        for j in near[label[near] != label[i]]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(x[i]), int(x[j])))
    return out


def run_links(x: np.ndarray, slot: int) -> list[tuple[int, int]]:
    """Links within one variant: segment slot // 32 with bit slot % 32 masked."""
    seg, bit = divmod(slot, 32)
    low, one = np.int64(32 * seg), np.int64(1 << bit)

    def admits(a, many):
        d = a ^ many
        s = (d >> low) & np.int64(0xFFFFFFFF)
        mine = (s == one) if bit else (s & ~one == 0)  # equal segments are bit 0's
        if seg:
            mine &= bits(d & np.int64(0xFFFFFFFF)) > 1  # else the first segment's
        return mine & (bits(d) <= MOST)

    if len(x) <= RUN:
        return forest(x, admits)
    out, other = set(), (x >> np.int64(32 - low)) & np.int64(0xFFFFFFFF)
    for half in (0, 16):
        for b in range(16):
            key = (other >> np.int64(half)) & np.int64(0xFFFF & ~(1 << b))
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            for members in np.split(order, cuts):
                if len(members) > 1:
                    out.update(forest(x[members], admits))
    return list(out)


def short_runs(key: np.ndarray, x: np.ndarray, size: np.ndarray):
    """Links of runs of at most 16, by comparing each member with those up to 15 places on."""
    for d in range(1, 16):
        i = np.flatnonzero((key[:-d] == key[d:]) & (size[:-d] <= 16)) if len(key) > d else np.empty(0, np.int64)
        if not len(i):
            break
        diff, slot = x[i] ^ x[i + d], key[i] >> 32
        s = (diff >> (slot // 32 * 32)) & 0xFFFFFFFF
        one = np.int64(1) << (slot % 32)
        mine = np.where(slot % 32 > 0, s == one, s & ~one == 0)
        mine &= (slot < 32) | (bits(diff & np.int64(0xFFFFFFFF)) > 1)
        mine &= bits(diff) <= MOST
        yield from zip(x[i[mine]].tolist(), x[i[mine] + d].tolist(), strict=True)


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between the distinct fingerprints of column fp: a spanning forest of each variant's links."""
    segment = "(shiftrightunsigned(fp, 32 * (v div 32)) & 4294967295)"
    variant = F.expr(f"explode(transform(sequence(0, 63), v -> shiftleft(cast(v as bigint), 32) | ({segment} & ~shiftleft(1L, v % 32))))".replace("32 * (v div 32)", "cast(32 * (v div 32) as int)"))
    dealt = fps.select("fp", variant.alias("key")).repartition("key").sortWithinPartitions("key", "fp")

    def settle(key, x):
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cuts, len(key)])
        out = list(short_runs(key, x, np.repeat(size, size)))
        for a, n in zip(cuts[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            out += run_links(x[a : a + n], int(key[a] >> 32))
        return batch_of(LINK, out)

    def run(batches):
        key, x = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            key, x = np.r_[key, b.column(1).to_numpy()], np.r_[x, b.column(0).to_numpy()]
            if len(key) and (cut := int(np.searchsorted(key, key[-1]))):  # the last run may go on in the next batch
                yield settle(key[:cut], x[:cut])
                key, x = key[cut:], x[cut:]
        if len(key):
            yield settle(key, x)

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id): the least doc_id of the fingerprints joined by links, for a table (doc_id, fp)."""
    least = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(least))
    of = least.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    of = checkpointed(of)
    return of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")


def simhash_classes(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    fps = checkpointed(fingerprints(docs, k), release=True)
    return fps.join(classes(fps), "fp").select("doc_id", "fp", "component_id")


def op8(spark, sf_dir: str) -> DataFrame:
    out = simhash_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
