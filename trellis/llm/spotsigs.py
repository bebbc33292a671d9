"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

A spot is an anchor (a very common word) with the two content words after it, common words skipped.  A text's
fingerprint is the set of its spots' hashes; likeness is the Jaccard similarity of two sets.

near_classes() joins all sets of a likeness of at least 0.8: copies of a set are one, linked sets are a class.  Sets are
partitioned by length (powers of two); a set is indexed under the first fifth of its spots in a common order, in its
own partition, and in the one below if sets of that are long enough for it.  What meets is pruned by length and by the
places of the common spot, then compared whole; of large groups only what isn't in one class already is compared.
No spot is too frequent to be an index key; no pair is left out but those that are in one class.

Defined results: a null text is empty; a text without spots has one made of its whole text, so only equal ones are
alike; the document after the last one is the first; null doc_ids come first; of rows that repeat a doc_id, each is
the next one of the one before, in the order of their texts.  A class is named by its least doc_id, null if all are null.
Sets are told apart by 64-bit hashes of their spots (of n different ones two coincide with a chance of n * n / 2 ** 65) and
compared by 32-bit hashes of them; a pair at the threshold is missed in 1 of 10 ** 7 cases (see near_copies).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, emptied, if_few, map_rows, shuffle_partitions, shuffles, table
from .near_copies import LAST, grouped, indexed, minima, prefix, recurring, signature

ANCHORS = frozenset("the a an of to and in is that for it was on are with as at be this by from der die das und ist ein eine den von zu mit auf für nicht sich des le la les de un une et en est que pour du des au el los las y es por con una se no".split())
COMMON = ANCHORS | frozenset("or not have he she they you we his her their dem im als auch er sie wir il elle ne pas sur ce qui dans lo su al como más".split())
CHAIN = 2
MARKS = ".,;:!?()[]{}\"'«»-…"


def spots(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    content, found = [], []
    for t in text.lower().split():
        t = t.strip(MARKS)
        if t in COMMON:
            if t in ANCHORS:
                found.append((t, len(content)))
        elif t:
            content.append(t)
    h, last = xxhash.xxh64_intdigest, len(content) - CHAIN
    out = {h(f"{t} {content[k]} {content[k + 1]}") for t, k in found if k <= last}
    return np.array(sorted(out or {h(b"\0" + text.encode())}), np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(a: np.ndarray) -> str:
    return f"{len(a)}:{hashlib.sha256(a.tobytes()).hexdigest()[:32]}"


def with_next(docs: DataFrame) -> DataFrame:
    """(slice, extra, doc_id, text) in order within partitions: slices of the range of doc_id, each with the row after its last.

    Only ids are read to cut the slices; each text moves once, those that begin a slice twice.
    """
    n = shuffle_partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"))
    cuts = sorted({int(x) for x in docs.where("doc_id is not null").approxQuantile("at", [i / n for i in range(1, n)], 1 / (8 * n))}) if n > 1 else []
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)] or [[]]
    longs = lambda x: f"array({', '.join(f'{v}L' for v in x)})" if x else "cast(array() as array<bigint>)"
    coarse = f"size(filter({longs([g[0] for g in groups if g])}, b -> b <= at))"
    fine = f"array({', '.join(map(longs, groups))})"
    sliced = docs.withColumn("c", F.expr(coarse)).withColumn("slice", F.expr(f"if(c = 0, 0, (c - 1) * {wide} + size(filter({fine}[c - 1], b -> b <= at)))"))
    heads = sliced.groupBy("slice").agg(F.min("at").alias("at")).orderBy("slice").collect()  # at most n rows
    if not heads:
        return sliced.select("slice", F.lit(0).alias("extra"), "doc_id", "text")
    before = docs.sparkSession.createDataFrame([(h["at"], heads[i - 1]["slice"]) for i, h in enumerate(heads)], "at long, before int")
    dealt = sliced.join(F.broadcast(before), "at", "left")
    to = F.explode(F.expr("if(before is null, array(struct(slice, 0 as extra)), array(struct(slice, 0 as extra), struct(before as slice, 1 as extra)))")).alias("to")
    return dealt.select("doc_id", "text", to).select("to.slice", "to.extra", "doc_id", "text").repartition(n, "slice").sortWithinPartitions("slice", "extra", "doc_id", "text")


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def node(a: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(a.tobytes())).view(np.int64))


def keys(a: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """The index keys of a set: the spots of its prefix under its partition of lengths, and under the one below."""
    p = len(a).bit_length() - 1
    parts = [p, p - 1] if 0.8 * len(a) < 1 << p and p else [p]
    first = prefix(a, often, 1)
    mixed = [(first ^ np.uint64(0x9E3779B97F4A7C15 * (q + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9) for q in parts]
    return np.stack(mixed, 1).ravel().view(np.int64).tolist()


def near_classes(docs: DataFrame) -> DataFrame:
    """(node, class_id) of each different set of spots."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    before = shuffles(docs.sparkSession)
    often = recurring(docs.select(F.xxhash64("text").alias("node"), "text"), spots)

    def index(found):
        for i, text in found:
            a = spots(text)
            yield i, node(a), len(a), signature(minima(a)), keys(a, often)

    fields = [("id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64()))]
    rows = map_rows(docs, index, fields, "id long, node long, n int, sig binary, keys array<long>", 1024)
    nodes = checkpointed(rows.groupBy("node").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "sig", "keys"))))
    emptied(docs.sparkSession, before)
    # the place of a spot in its set's order: keys of both partitions stand side by side
    held, alone = indexed(nodes, "pos div (size(keys) div (n div 5 + 1))")
    wanted = checkpointed(nodes.select("node", "id", "sig").join(alone.select("node"), "node"))
    nodes = checkpointed(nodes.select("node", "id"))  # the keys aren't needed any more

    def whole(found):
        for i, text in found:
            a = spots(text)
            yield i, node(a), np.unique((a >> np.uint64(32)).astype(np.uint32)).view(np.int32).tolist()

    # of texts with equal sets, that of the least id stands for them
    sets = map_rows(docs.join(if_few(wanted.select("id").distinct()), "id", "left_semi"), whole, [("id", pa.int64()), ("node", pa.int64()), ("held", pa.list_(pa.int32()))], "id long, node long, held array<int>", 1024)
    sets = sets.join(if_few(wanted.select("node", "id")), ["node", "id"]).select("node", "held")
    repeated = not docs.groupBy("id").count().where("count > 1").isEmpty()
    sets = checkpointed(sets.dropDuplicates(["node"]) if repeated else sets, release=True)
    none = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    group = grouped(held, alone, sets, wanted.select("node", "sig"), none, together=True)
    of = nodes.select("node", "id").join(group.withColumnRenamed("id", "node"), "node", "left").select("node", "id", F.coalesce("component", "node").alias("root"))
    of = checkpointed(of)
    least = F.nullif(F.min("id"), F.lit(LAST)).alias("class_id")
    return checkpointed(of.join(of.groupBy("root").agg(least), "root").select("node", "class_id"), release=True)


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("node", pa.int64())]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, node long"


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The columns of DDL: each row with its edited text and the next document; node is that of near_classes()."""
    def row(doc_id, text, following):
        new = edited(text, following)
        a, b, c = spots(text), spots(new), spots(following)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), digest(a), digest(b), likeness(a, b), likeness(a, c), node(a)

    def run(found):
        last = None
        for piece, extra, doc_id, text in found:
            if last and last[0] == piece:
                yield row(*last[1:], text)
            last = None if extra else (piece, doc_id, text)

    return map_rows(with_next(docs), run, FIELDS, DDL, 1024)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = shuffles(spark)
    out = checkpointed(fingerprinted(docs))  # a small row each
    emptied(spark, before)  # the texts' shuffle is larger than the input, and would stand beside the join's
    return out.join(near_classes(docs), "node").drop("node")
