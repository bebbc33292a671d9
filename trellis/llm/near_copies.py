"""One document of each group of near copies: pairs whose five-word shingles are alike, by an index, compared whole.

Equal texts are one node.  Two nodes are linked if the Jaccard similarity of their sets of shingles is at least 0.8;
linked nodes are a group.  A node has some 40 index keys at most, whatever its length:

- Sets of at most SHORT shingles stand under the first fifth of them in a common order, an exact filter: the first one that two
  such sets share is among these.  The order puts shingles last that recur in a sample of texts; it decides what is
  compared, not what is found.
- Larger ones (and those that can be alike to larger ones) stand under BANDS bands of ROWS minima each.  Of two sets of
  similarity 0.8 each band is equal with a chance of 0.41, so that both lack a common key in 5 of 10 ** 8 cases; the more
  alike, the fewer.

Pairs under a key are pruned by sizes, by the places of the key in both, and by how many of BANDS x ROWS minima are equal: at a
similarity of 0.8 fewer than EQUAL are so in 8 of 10 ** 8 cases.  Large groups are joined first: SimHash fingerprints
at most three bits apart, then, under keys of more than MANY nodes, rounds of comparing all with one member, that with
the fewest keys of its own.  A pair is left out only if it was compared or its nodes are in one group already; what the
rounds leave is compared pair by pair.

Defined results: a null text is empty, empty texts are equal; a text of fewer than five words is one shingle; the least
doc_id of a group stays (null ids last), rows that repeat it with the same text are one, whose other columns are any
one's; columns of docs may have any names.  Nodes are 64-bit hashes of texts, told apart by a second hash where they
coincide; shingles are 32-bit hashes in sets and 64-bit ones as keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, heaps_released, if_few, joined, map_rows, trimmed
from .simhash_variants import fingerprint, links, shingles

WORDS, LEAST = 5, 0.8
#: Texts that the order of shingles is estimated from at least, their share of all, how often one recurs there to be put
#: last, and how many are.
SAMPLE, SHARE, OFTEN, HOT = 3_000, 0.05, 3, 1 << 16
#: Shingles of a set that stands under its first fifth at most; of one that may be alike to a larger one at least.
SHORT, LONG = 200, 160
BANDS, ROWS, EQUAL = 32, 4, 75
#: Rounds of comparing with one member at most, which end when fewer than WORTH of the pairs are alike; nodes of a key that are
#: compared pair by pair without.
ROUNDS, WORTH, MANY = 24, 0.02, 32
#: Entries of a key that are joined to pairs at most; of more, those that one task compares with each other.
PAIRED, CELL = 8, 2048
#: Entries of large keys, and elements of the sets that stand for them, that the rounds keep in one part at most.
ENTRIES, ELEMENTS = 1 << 17, 1 << 24
LAST = (1 << 63) - 1


def hashes(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending; zero for a text without words."""
    return np.unique(np.array(shingles(text.lower().split(), WORDS) or [0], np.uint64))


def recurring(texts: DataFrame, hashes=hashes) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes (of shingles) that recur in a sample of (node, text), and in how many of its texts."""
    share = min(1.0, max(SAMPLE / max(1, texts.count()), SHARE))
    some = texts.where(F.pmod("node", F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["node"])
    one = map_rows(some.select("text"), lambda found: ((x,) for (t,) in found for x in hashes(t).view(np.int64).tolist()), [("h", pa.int64())], "h long", 1 << 14)
    got = one.groupBy("h").count().where(f"count >= {OFTEN}").orderBy(F.desc("count"), "h").limit(HOT).collect()
    h, n = np.array([r["h"] for r in got], np.int64).view(np.uint64), np.array([r["count"] for r in got], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(h: np.ndarray, often: tuple[np.ndarray, np.ndarray], more: int = 2) -> np.ndarray:
    """The first fifth of a set in the common order and `more`: 1, and another one where 32-bit hashes may coincide."""
    rank = np.zeros(len(h), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], h), len(often[0]) - 1)
        rank = np.where(often[0][at] == h, often[1][at], 0)
    return h[np.lexsort((h, rank))[: len(h) // 5 + more]]


def factors(n: int) -> np.ndarray:
    """Odd numbers, always the same."""
    return np.array([xxhash.xxh64_intdigest(f"minimum {i}") | 1 for i in range(n)], np.uint64)


FACTORS = factors(BANDS * ROWS)


def minima(h: np.ndarray) -> np.ndarray:
    """The least element of a set in each of BANDS x ROWS orders."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for a in range(0, len(h), 256):  # what stays in a core's cache
        x = h[a : a + 256, None] * FACTORS
        x ^= x >> np.uint64(29)
        np.minimum(least, x.min(0), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """A byte of each minimum; two that differ have equal bytes by chance at times, which only keeps a pair."""
    return (least * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)).astype(np.uint8).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def keys(h: np.ndarray, least: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], int]:
    """(index keys of a set with these minima, how many of them, the first ones, are its prefix)."""
    first = prefix(h, often) if len(h) <= SHORT else h[:0]
    return np.r_[first, bands(least) if len(h) >= LONG else h[:0]].view(np.int64).tolist(), len(first)


def sketches(docs: DataFrame, often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, node, fp, n, first, sig, keys)."""
    def run(found):
        for i, node, text in found:
            words = shingles(text.lower().split(), WORDS)
            h = np.unique(np.array(words or [0], np.uint64))
            least = minima(h)
            held, first = keys(h, least, often)
            yield i, node, fingerprint(words), len(h), first, signature(least), held

    fields = [("id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))]
    return map_rows(docs, run, fields, "id long, node long, fp long, n int, first int, sig binary, keys array<long>", 1024)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, set of 32-bit shingle hashes) of (node, text)."""
    def run(found):
        for node, text in found:
            h = np.array(shingles(text.lower().split(), WORDS) or [0], np.uint64)
            yield node, np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32).tolist()

    return map_rows(docs, run, [("node", pa.int64()), ("held", pa.list_(pa.int32()))], "node long, held array<int>", 1024)


def starred(df: DataFrame, key: str) -> DataFrame:
    """(a, b): each node with the least one of its key."""
    least = df.groupBy(key).agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return df.join(least, key).where("a <> node").select("a", F.col("node").alias("b"))


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def plausible(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures (node, sig) have EQUAL bytes in common at least."""
    def run(batches):
        for b in batches:
            keep = pa.array((matrix(b.column(2)) == matrix(b.column(3))).sum(1) >= EQUAL)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=PAIR)

    sig_of = lambda x: sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    return pairs.join(sig_of("a"), "a").join(sig_of("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(trimmed(run), "a long, b long")


def matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(len(sigs), -1)


def within(key: np.ndarray, node: np.ndarray, n: np.ndarray, i: np.ndarray, c: np.ndarray, part: np.ndarray, sig: np.ndarray):
    """(a, b) arrays of plausible pairs of entries that stand side by side under equal keys: those of short runs by distance, of
    long ones member by member.  A pair with several bands in common is told under the first one."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cuts, len(key)])
    of, place = np.repeat(size, size), np.maximum(i, 0)

    def keep(x, y):
        may = (c[x] != c[y]) & (9 * (np.minimum(n[x] - place[x], n[y] - place[y]) + 1) >= 4 * (n[x] + n[y])) & ((part[x] < 0) | (part[x] != part[y]))
        x, y = x[may], y[may]
        same = sig[x] == sig[y]
        enough = same.sum(1) >= EQUAL
        x, y, same = x[enough], y[enough], same[enough]
        first = (i[x] >= 0) | (same.reshape(len(x), BANDS, ROWS).all(2).argmax(1) == -1 - i[x])
        return node[x[first]], node[y[first]]

    for d in range(1, 16):
        x = np.flatnonzero((key[:-d] == key[d:]) & (of[:-d] <= 16)) if len(key) > d else np.empty(0, np.int64)
        if not len(x):
            break
        yield keep(x, x + d)
    for start, many in zip(cuts[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        for k in range(start, start + many - 1):
            y = np.arange(k + 1, start + many)
            yield keep(np.full(len(y), k), y)


def pairs_under(entries: DataFrame, sigs: DataFrame) -> DataFrame:
    """(a, b) of plausible pairs among entries (key, x, m).  A key of more than CELL entries is dealt to cells of two of its parts each."""
    p = F.ceil(F.col("m") / CELL)
    dealt = entries.select("key", "x.*", p.alias("p")).join(sigs, "node").withColumn("part", F.pmod(F.xxhash64("node"), "p"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    # in a cell of two different parts, only pairs across them count
    dealt = dealt.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "node", "n", "i", "c", F.expr("p > 1 and part <> other").alias("across"), "part", "sig")
    crossed = dealt.withColumn("part", F.expr("if(across, part, -1)")).drop("across").repartition("cell").sortWithinPartitions("cell")

    def run(batches):
        held = None
        for b in batches:
            now = [*(b.column(k).to_numpy(zero_copy_only=False) for k in range(6)), matrix(b.column(6)) if len(b) else None]
            if not len(b):
                continue
            held = now if held is None else [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on in the next batch
            if cut:
                yield from told([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from told(held)

    def told(columns):
        for a, b in within(*columns):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=PAIR)

    return crossed.mapInArrow(trimmed(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike, each once, by sets (node, held) and signatures (node, sig)."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return compared(plausible(pairs, sigs), sets)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The same for plausible pairs; few pairs go to the sets, for many the sets are shuffled."""
    pairs = checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    set_of = lambda x: sets.select(F.col("node").alias(x), F.col("held").alias(f"held_{x}"))
    one = set_of("a").join(if_few(pairs), "a")
    other = set_of("b").join(if_few(pairs.select("b").distinct()), "b", "left_semi")
    common = F.size(F.array_intersect("held_a", "held_b"))
    likeness = common / (F.size("held_a") + F.size("held_b") - common)
    return checkpointed(one.join(other, "b").where(likeness >= LEAST).select("a", "b"), release=True)


def indexed(nodes: DataFrame, place: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(key, node, n, i, m) of nodes (node, n, keys): keys that m > 1 nodes have, i the place of the key (-1 - band of one
    that isn't of a prefix); and (node, own): how many keys of the node no other one has."""
    one = nodes.select("*", F.size("keys").alias("k"), F.posexplode("keys").alias("pos", "key")).select("key", "node", "n", F.expr(place).cast("int").alias("i"), "k")
    held = checkpointed(one.join(one.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key"), release=True)
    own = checkpointed(held.groupBy("node").agg((F.first("k") - F.count("*")).cast("int").alias("own")))
    return held.drop("k"), own


#: Of two sets, all from the first shingle in common on at most: 0.8 of the union is 4 / 9 of both sizes; one more as above.
MAY = "9 * (least({0}.n - greatest({0}.i, 0), {1}.n - greatest({1}.i, 0)) + 1) >= 4 * ({0}.n + {1}.n) and {0}.c <> {1}.c"


def mixed(held: DataFrame, own: DataFrame, group: DataFrame) -> DataFrame:
    """(key, x, m, s): entries x under keys whose nodes are in several groups, s the one of these with the fewest keys of its own."""
    of = own.join(group.select(F.col("id").alias("node"), "component"), "node", "left").select("node", "own", F.coalesce("component", "node").alias("c"))
    now = held.join(of, "node").select("key", F.struct("own", "node", "n", "i", "c").alias("x"), "m")
    of = now.groupBy("key").agg(F.min("x").alias("s"), F.min("x.c").alias("c0"), F.max("x.c").alias("c1")).where("c0 <> c1")
    return now.join(of.select("key", "s"), "key")


def in_one(df: DataFrame) -> DataFrame:
    """df in one part, so that joins and sums of such need no shuffle; for few rows."""
    return checkpointed(checkpointed(df).coalesce(1)).coalesce(1)


def grouped(held: DataFrame, own: DataFrame, sets: DataFrame, sigs: DataFrame, edges: DataFrame, together: bool = False) -> DataFrame:
    """(id, component) by all links of what indexed() gives; edges are links known before.

    together: if the entries of large keys are counted to be few, the rounds keep them in one part.  A round is then some tasks
    and files, not some twenty for each shuffle partition.  The groups are the same.
    """
    group = checkpointed(joined(edges))
    large = held.where(F.col("m") > MANY)
    heavy = checkpointed(own.join(large.select("node").distinct(), "node", "left_semi"))  # the rounds touch no others
    heavy_sets, heavy_sigs, part = sets, sigs, lambda df: df
    if together:
        entries, elements = large.agg(F.count("*"), F.sum(F.col("n").cast("long"))).first()
        if 0 < entries <= ENTRIES and elements <= ELEMENTS:
            ids = F.broadcast(heavy.select("node"))
            large, heavy, heavy_sets, heavy_sigs = map(in_one, (large, heavy, sets.join(ids, "node", "left_semi"), sigs.join(ids, "node", "left_semi")))
            part = lambda df: df.coalesce(1)
    for _ in range(ROUNDS):
        now = part(checkpointed(mixed(large, heavy, part(group))))
        if now.isEmpty():
            large = large.limit(0)
            break
        star = part(checkpointed(now.where(f"x.node <> s.node and {MAY.format('x', 's')}").select(F.col("s.node").alias("a"), F.col("x.node").alias("b")).distinct()))
        found = verified(star, heavy_sets, heavy_sigs)
        edges = checkpointed(edges.unionByName(found))
        group = checkpointed(joined(edges), release=True)
        large = now.where("x.node <> s.node").select("key", "x.node", "x.n", "x.i", "m")
        if found.count() < WORTH * star.count():
            break
    left = mixed(held.where(F.col("m") <= MANY).unionByName(large), own, group)
    left = checkpointed(left.select("key", F.struct("x.node", "x.n", "x.i", "x.c").alias("x"), "m"), release=True)
    few = left.where(F.col("m") <= PAIRED).select("key", "x")
    two = few.select("key", F.col("x").alias("p")).join(few.select("key", F.col("x").alias("q")), "key").where(f"p.node < q.node and {MAY.format('p', 'q')}")
    two = plausible(two.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct(), sigs)
    return joined(edges.unionByName(compared(two.unionByName(pairs_under(left.where(F.col("m") > PAIRED), sigs)), sets)))


def node_of(docs: DataFrame, text):
    """A 64-bit number for each different text: a hash, or another one for texts whose first hashes coincide."""
    first, other = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    same = docs.select(first.alias("node"), other.alias("other")).groupBy("node").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").select("node").collect()
    return F.when(first.isin([r.node for r in same]), other).otherwise(first) if same else first  # one in n * n / 2 ** 65


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs, less near copies of others."""
    ids, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.coalesce(F.col("text"), F.lit(""))
    node = node_of(docs, text)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), node.alias("node"), ids.alias("id"), text.cast("binary").alias("text"))
    often = recurring(own.select("node", "text"))
    rows = sketches(own.select("id", "node", "text"), often)
    nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("fp", "n", "first", "sig", "keys"))), release=True)
    heaps_released(docs.sparkSession)
    repeated = checkpointed(own.groupBy("node", "id").count().where("count > 1").select("node", "id"))
    held, alone = indexed(nodes, "if(pos < first, pos, first - pos - 1)")
    wanted = checkpointed(nodes.select("node", "id", "sig").join(alone.select("node"), "node"))
    sets = shingle_sets(own.join(if_few(wanted.select("node", "id")), ["node", "id"]).select("node", "text"))
    sets, sigs = checkpointed(sets if repeated.isEmpty() else sets.dropDuplicates(["node"]), release=True), wanted.select("node", "sig")
    fps = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = links(fps.select("fp")).withColumnRenamed("a", "fa").withColumnRenamed("b", "fb")
    near = near.join(fps.select(F.col("fp").alias("fa"), F.col("node").alias("a")), "fa").join(fps.select(F.col("fp").alias("fb"), F.col("node").alias("b")), "fb").select("a", "b")
    edges = verified(near.unionByName(starred(nodes.select("node", "fp"), "fp")), sets, sigs)
    nodes = checkpointed(nodes.select("node", "id", "copies"))  # the keys aren't needed any more
    group = grouped(held, alone, sets, sigs, edges).select(F.col("id").alias("node"), "component")
    of = nodes.select("node", "id", "copies").join(group, "node", "left").select(F.coalesce("component", "node").alias("component"), "id", "node", "copies")
    stays = of.groupBy("component").agg(F.min(F.struct("id", "node")).alias("s")).select("component", F.col("s.node").alias("stays"))
    # nodes that go, or of whose copies one stays: few beside the rows that are left alone
    touched = of.join(stays, "component").where("node <> stays or copies > 1").select("node", F.expr("if(node = stays, id, null)").alias("keep"))
    touched = checkpointed(touched.join(repeated.select("node", F.col("id").alias("keep"), F.lit(True).alias("many")), ["node", "keep"], "left"), release=True)
    heaps_released(docs.sparkSession)
    kept = own.drop("text").join(if_few(touched.withColumn("touched", F.lit(True))), "node", "left").where("touched is null or id = keep")
    if not repeated.isEmpty():
        kept = kept.where("many is null").unionByName(kept.where("many").dropDuplicates(["id", "node"]))
    return kept.select("row.*")
