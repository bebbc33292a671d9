"""Questions from blocks of documents to hash partitions of their n-grams, and the answers.

Operators that hold every n-gram of a corpus against all others would shuffle a row for each of its tokens.  Here
neighbouring documents are packed into blocks of a few MB; a block asks each hash partition once about its distinct
n-grams (compressed arrays), and gets as many compressed answers.  However often an n-gram recurs, a partition sees
it once from each block, so a hot n-gram loads no task more than others.  Blocks and answers are checkpointed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_rows, batch_of, checkpointed, rows, shuffle_partitions, squeeze, trimmed, unsqueeze

BLOCK_BYTES = 4 << 20
PACKED = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
ANSWERED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("body", pa.binary())])


#: Blocks for each hash partition at most: a partition gets a share of all, some tens of MB.
BLOCKS_EACH = 8


def parts(blocks: DataFrame) -> int:
    """Hash partitions of a question about packed blocks: by their number, so that a partition's share fits in memory however
    large the input is; twice the shuffle partitions at least, so that it is a small share of a task."""
    return max(2 * shuffle_partitions(blocks), -(-blocks.count() // BLOCKS_EACH))


def pack(docs: DataFrame, encode, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, payload): encode(list of rows) of neighbouring rows; the size of a row is that of its column text.

    The checkpoint is partitioned and sorted by block, so only the answers are shuffled to be joined to it.
    """
    at = docs.columns.index("text")

    def run(batches):
        first, held, size = TaskContext.get().partitionId() << 32, [], 0
        for r in all_rows(batches):
            held.append(r)
            size += len(r[at] or b"") + 64
            if size >= block_bytes:
                yield batch_of(PACKED, [(first, squeeze(encode(held)))])
                first, held, size = first + 1, [], 0
        if held:
            yield batch_of(PACKED, [(first, squeeze(encode(held)))])

    conf = docs.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")  # a plan that may still change doesn't say how the checkpoint is partitioned
    try:
        return checkpointed(docs.mapInArrow(trimmed(run), "block long, payload binary").repartition(shuffle_partitions(docs), "block").sortWithinPartitions("block"), release=True)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def ask(blocks: DataFrame, emit) -> DataFrame:
    """emit(payload[, answers by part]) yields (part, body)."""
    def run(batches):
        for b in batches:
            for r in (b.slice(i, 1) for i in range(b.num_rows)):
                r = next(rows(r))
                yield batch_of(ASKED, [(p, r[0], squeeze(x)) for p, x in emit(unsqueeze(r[1]), *(opened(a) for a in r[2:]))])

    return blocks.mapInArrow(trimmed(run), "part int, block long, body binary")


def answer(asked: DataFrame, reply) -> DataFrame:
    """reply(part, bodies) yields an answer to each body, then any further ones, which go to block -1."""
    def run(group: pa.Table) -> pa.Table:
        found = sorted(zip(*(group.column(c).to_pylist() for c in ("block", "part", "body")), strict=True), key=lambda r: r[0])
        to = [r[0] for r in found]
        said = [(to[i] if i < len(to) else -1, found[0][1], squeeze(x)) for i, x in enumerate(reply(found[0][1], [unsqueeze(r[2]) for r in found]))]
        return pa.Table.from_batches([batch_of(ANSWERED, said)])

    return checkpointed(asked.groupBy("part").applyInArrow(trimmed(run), "block long, part int, body binary"), release=True)


def asides(answers: DataFrame) -> list:
    """What the partitions said besides answers: a few bounded rows from each."""
    return [unsqueeze(r.body) for r in answers.where("block = -1").select("body").toLocalIterator()]


def answered(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """blocks with a column of answers for each question; blocks keep their partitioning."""
    for i, a in enumerate(answers):
        got = a.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias(f"a{i}"))
        blocks = blocks.join(got, "block", "left")
    return blocks


def opened(got) -> dict:
    return {x["part"]: unsqueeze(x["body"]) for x in got or ()}


def by_part(part: np.ndarray):
    """(stable order, [(part, slice)]) of items dealt to parts."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    cuts = [*np.flatnonzero(np.r_[True, p[1:] != p[:-1]]).tolist(), len(p)] if len(p) else []
    return order, [(int(p[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:])]


def gathered(part: np.ndarray, got: dict, field: int, dtype) -> np.ndarray:
    """Answers of all parts in the order of the items asked about."""
    order, cuts = by_part(part)
    out = np.zeros(len(part), dtype)
    for p, s in cuts:
        out[order[s]] = got[p][field]
    return out
