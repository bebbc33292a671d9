"""Best-fit packing of tokenised documents into sequences of at most 4096 tokens.

Tokens: the tokenizer drops white space, so the stretches between ASCII white space are encoded apart, and each
worker keeps the ids of those it has met, in lower case (two bounded tables; when one is full, it takes the place of
the other).
Only documents longer than a sequence are cut.

All pieces are packed as one best-fit decreasing run, however many there are.  Pieces of equal length are alike to it,
so it needs their number by length alone: at most 4096 rows, which the driver gets.  There a segment tree over the
remaining capacities finds the tightest open sequences in log(4096) steps.  Open sequences of one capacity are ranges
of numbers; pieces of a length go into a whole range at once, and a range at least halves its capacity each time, so
the plan has at most some 150,000 segments whatever the input.  Each piece then finds its own place by its rank among the
pieces of its length: counted in its task, and summed over tasks by a window for each length.

Defined results: a null text is empty and has the one token that ends a document; rows that repeat a doc_id are
packed each; a null doc_id is packed like others.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, map_rows, table

ROOM, KNOWN, END = 4096, 1 << 19, 1
#: A word that ends in a letter or digit (ASCII, or a two-byte Latin letter), and the marks after it: two stretches to the
#: tokenizer's pattern as well.  Apostrophes (contractions) and special tokens are left whole.
MARKED = re.compile(rb"([^'<]*(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:;=-@\[-`{-~]+)").fullmatch
PIECES = [("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
PLACED = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Ids of a text as little-endian 32-bit bytes; path None: the default file where this runs."""

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.known, self.older = Tokenizer.from_file(path or default_tokenizer()), {}, {}

    def learn(self, words: list[bytes]) -> None:
        """Encodes words as one text, whose tokens are parted by where they start."""
        texts = [w.decode() for w in words]
        got = self.model.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = (4 * np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), begins)).tolist()
        ids = np.array(got.ids, "<u4").tobytes()
        self.known.update(zip(words, [ids[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def meet(self, words: set[bytes]) -> None:
        """Sees to it that the newer table has all of words; marks at the end of a word are encoded apart from it."""
        if len(self.known) + 3 * len(words) > KNOWN:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        if not (new := words.difference(known)):
            return
        known.update([(w, older[w]) for w in new if w in older])
        cut, parts = [], set()
        for w in new.difference(known):
            if m := MARKED(w):
                cut.append((w, *m.groups()))
                parts.update(m.groups())
            else:
                parts.add(w)
        if parts := parts.difference(known):
            self.learn(list(parts))
        known.update([(w, known[a] + known[b]) for w, a, b in cut])

    def __call__(self, text: bytes) -> bytes:
        words = (text if b"<|" in text else text.lower()).split()  # special tokens are only so as they are written
        self.meet({*words})
        return b"".join(map(self.known.__getitem__, words))


_encoders: dict[str | None, Encoder] = {}


def encoder_of(path: str | None) -> Encoder:
    """The worker's own, which keeps its tables between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth among the pieces of its length that its task makes."""
    def run(found):
        encode, task, met = encoder_of(path), TaskContext.get().partitionId(), [0] * (room + 1)
        for doc_id, text in found:
            ids = encode(text) + END.to_bytes(4, "little")
            for i, a in enumerate(range(0, len(ids), 4 * room)):
                part = ids[a : a + 4 * room]
                n = len(part) // 4
                yield doc_id, i, a // 4, n, zlib.crc32(part), task, met[n]
                met[n] += 1

    return map_rows(documents(docs), run, [*PIECES, ("task", pa.int64()), ("nth", pa.int64())], "doc_id long, piece long, start long, length long, ids_crc32 long, task long, nth long", 4096)


class Capacities:
    """Ranges of open sequences by remaining capacity, under a segment tree of how many ranges each capacity has."""

    def __init__(self, room: int):
        self.width = 1 << room.bit_length()
        self.tree, self.ranges = [0] * (2 * self.width), [[] for _ in range(room + 1)]

    def put(self, capacity: int, start: int, n: int) -> None:
        if capacity and n:
            self.ranges[capacity].append((start, n))
            self._add(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._add(capacity, -1)
        return self.ranges[capacity].pop()

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.width
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, n: int) -> int:
        """The least capacity of at least n; 0 without any."""
        i, tree, width = n + self.width, self.tree, self.width
        if not tree[i]:
            while i > 1 and not (i & 1 == 0 and tree[i + 1]):
                i >>= 1
            if i == 1:
                return 0
            i += 1
            while i < width:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - width


def best_fit(counts: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, rank, sequence, each, offset) of best-fit decreasing over so many pieces of each length.

    From its rank on, pieces of that length go to consecutive sequences, `each` of them to one, the first at offset.
    """
    free, out, opened = Capacities(room), [], 0
    for n in sorted(counts, reverse=True):
        rank, left = 0, counts[n]
        while left:
            if capacity := free.tightest(n):
                start, many = free.take(capacity)
            else:  # new sequences, as many as the pieces need
                capacity, start = room, opened
                many = -(-left // (room // n))
                opened += many
            each = capacity // n
            whole = min(many, left // each)
            if whole:
                out.append((n, rank, start, each, room - capacity))
                free.put(capacity - each * n, start, whole)
                rank, left, start, many = rank + whole * each, left - whole * each, start + whole, many - whole
            if many and left:  # fewer pieces than one sequence takes
                out.append((n, rank, start, left, room - capacity))
                free.put(capacity - left * n, start, 1)
                start, many, left = start + 1, many - 1, 0
            free.put(capacity, start, many)
    return out


def placed(length: np.ndarray, rank: np.ndarray, plan: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and their rank in it."""
    n, first, sequence, each, offset = np.array(sorted(plan), np.int64).reshape(-1, 5).T
    at = np.searchsorted(n << 40 | first, length << 40 | rank, "right") - 1  # a length has fewer than 2 ** 40 pieces
    nth = rank - first[at]
    return sequence[at] + nth // each[at], offset[at] + nth % each[at] * length


def packed(docs: DataFrame, path: str | None = None, room: int = ROOM) -> DataFrame:
    """Each piece with its sequence_id and offset."""
    cut = checkpointed(pieces(docs, path, room), release=True)
    made = checkpointed(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    plan = docs.sparkSession.sparkContext.broadcast(best_fit({r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}, room))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(made.select("length", "task", before.alias("before")), ["length", "task"])
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        for b in batches:
            *own, rank = (c for c in b.columns)
            found = placed(own[3].to_numpy(), rank.to_numpy(), plan.value)
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found)], schema=schema)

    return ranked.select(*(n for n, _ in PIECES), (F.col("nth") + F.col("before")).alias("rank")).mapInArrow(run, PLACED)


def op6(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
