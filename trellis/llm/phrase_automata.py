"""Substring dedup by repeated-phrase automata.

A window is 20 consecutive words of a document.  A word goes if a window over it has the same words as a window that
starts earlier (in a smaller doc_id, or earlier in the same document).

1. Phrases: of the 8-word phrases in a window, the one with the least hash stands for it, so equal windows have equal
   phrases.  Each block of documents tells every hash partition its distinct standing phrases (about 14 in 100 words),
   and hears which of them recur anywhere, and which stand in many blocks: of these, one block is told to speak for them.
2. Passages: where all phrases of a stretch are so, its speaker hands in the words, with their place.  Those in most blocks
   are confirmed, up to a bounded number of bytes, and compiled into Aho-Corasick automata (pyahocorasick), in shards.
3. Automata: all stretches of windows whose phrases recur are streamed through the shards (an occurrence after the speaker's
   place lies within one).  It is settled, word by word: its windows go, and are not asked about.  So a passage that stands
   everywhere costs no partition anything.
4. The rest, exactly: of all other windows whose phrase recurs, 128-bit hashes go to partitions, which say of each whether
   the block holds its first place.  All later places go.  The first place of a window is never settled, so it is there.

Defined results: a null or empty text has no words; a text of fewer than 20 words loses nothing; a null doc_id comes
before all others; rows that repeat a doc_id count as documents of their own, in the order of their texts within a
block, of their blocks otherwise; texts of any length are read whole; columns of docs keep any names but those of the
operator's own.  Two different windows of n are taken as equal with a chance of about n * n / 2 ** 129.
"""

from __future__ import annotations

import zlib
from functools import cached_property
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import answer, answered, ask, by_part, opened, pack, parts
from .common import heaps_released, map_rows, rows, table, trimmed, unsqueeze

WINDOW, PHRASE = 20, 8
#: A phrase in so many blocks is common; windows in one passage at most; bytes of all confirmed passages and of a shard.
COMMON, PIECE, PASSAGE_BYTES, SHARD_BYTES = 8, 100, 1 << 18, 1 << 17
#: Bytes of text in a block.
BLOCK = 2 << 20
#: Places that are worked on at a time: what is held between steps stays in a core's cache, and takes no new memory.
STEP = 1 << 14
NULL_ID = -(1 << 63)
KEPT = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.BinaryType())]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(h: np.ndarray, k: int, by: int = 0x9E3779B97F4A7C15, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of k items, or of those that start at some places."""
    n = max(0, len(h) - k + 1)
    if at is not None and 2 * len(at) > n:
        return rolling(h, k, by)[at]
    out = np.zeros(n if at is None else len(at), np.uint64)
    for a in range(0, len(out), STEP):
        part = out[a : a + STEP]
        for j in range(k):
            part *= np.uint64(by)
            part += h[a + j : a + j + len(part)] if at is None else h[at[a : a + STEP] + j]
        part[:] = mixed(part)
    return out


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, numbers of all words, words in each text)."""
    cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    words, ends = cut.flatten(), cut.offsets.to_numpy()
    real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty one
    lens = np.diff(np.r_[0, np.cumsum(real)][ends - ends[0]])
    coded = words.filter(pa.array(real)).view(pa.large_binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int32), lens


def listed(words: pa.Array) -> list[bytes]:
    """What to_pylist() gives for large_binary without nulls, in a quarter of the time."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    held = words.buffers()[2].to_pybytes() if ends[-1] else b""
    return [held[a:b] for a, b in zip(ends, ends[1:])]


def encode(schema: pa.Schema):
    """Rows in order of doc_id, then text: (ids, texts, the rows without their ids)."""
    at, text = schema.get_field_index("__id"), schema.get_field_index("text")
    key = lambda r: (NULL_ID if r[at] is None else r[at], r[text] or b"")

    def run(held: list[tuple]) -> tuple:
        held = sorted(held, key=key)
        return np.array([key(r)[0] for r in held], np.int64), [key(r)[1] for r in held], [tuple(v for i, v in enumerate(r) if i != at) for r in held]

    return run


class Windows:
    """Places of a block: windows that stay within a document, and where each one's standing phrase starts."""

    def __init__(self, payload: tuple):
        self.ids, texts, _ = payload
        self.vocab, self.word, self.lens = numbered(texts)
        h = np.fromiter(map(xxhash.xxh64_intdigest, listed(self.vocab)), np.uint64)[self.word]
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        n = max(0, len(h) - WINDOW + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :]) if n else np.empty(0, np.int64)
        self.words = h

    @cached_property
    def phrases(self) -> np.ndarray:
        return rolling(self.words, PHRASE)

    @cached_property
    def stands(self) -> np.ndarray:
        """Ascending; of equal phrases in a window the first one stands for it."""
        out = np.empty(max(0, len(self.phrases) - (WINDOW - PHRASE)), np.int64)
        for a in range(0, len(out), STEP):
            least, width = self.phrases[a : a + STEP + WINDOW - PHRASE], 1
            place = np.arange(a, a + len(least))
            while width <= WINDOW - PHRASE:  # least ones of so many phrases in a row
                step = min(width, WINDOW - PHRASE + 1 - width)
                place = np.where(least[step:] < least[:-step], place[step:], place[:-step])
                least = np.minimum(least[step:], least[:-step])
                width += step
            out[a : a + STEP] = place
        return out[self.at]

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each chosen window."""
        at = self.at[chosen]
        return rolling(self.words, WINDOW, at=at), rolling(mixed(self.words), WINDOW, 0xD6E8FEB86659FD93, at)


def phrases_of(w: Windows, n_parts: int):
    """(distinct standing phrases, inverse of the windows', whether it has several places, part of each)."""
    new = np.diff(w.stands, prepend=-1) > 0
    at, of_window = w.stands[new], np.cumsum(new) - 1
    x, of_place, n = np.unique(w.phrases[at], return_inverse=True, return_counts=True)
    return x, of_place[of_window], n > 1, (x % np.uint64(n_parts)).astype(np.int32)


def reply_recurring(_, bodies):
    """For each phrase: does it have a second place, in this block or another? Which of the common ones does the block speak
    for (the one with the least id does), and in how many blocks is that?"""
    if not bodies:
        return
    x = np.concatenate([b[0] for b in bodies])
    many = np.concatenate([np.unpackbits(b[1], count=len(b[0])) for b in bodies]).astype(np.int64)
    first = np.repeat(np.array([b[2] for b in bodies]), [len(b[0]) for b in bodies])
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    yes = np.bincount(inverse, 1 + many)[inverse] > 1
    order = np.lexsort((first, inverse))
    speaks = np.zeros(len(x), bool)
    speaks[order[np.r_[0, np.cumsum(n)[:-1]]]] = True
    spoken = np.where(speaks & (n[inverse] >= COMMON), n[inverse], 0)
    at = np.cumsum([len(b[0]) for b in bodies])[:-1]
    for part, times in zip(np.split(yes, at), np.split(spoken, at), strict=True):
        yield np.packbits(part), np.flatnonzero(times), times[times > 0]


def heard(part: np.ndarray, got: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct phrase: whether it recurs, and in how many blocks if this one speaks for it."""
    order, cuts = by_part(part)
    recurs, spoken = np.zeros(len(part), bool), np.zeros(len(part), np.int64)
    for p, s in cuts:
        bits, at, times = got[p]
        recurs[order[s]] = np.unpackbits(bits, count=s.stop - s.start).astype(bool)
        spoken[order[s][at]] = times
    return recurs, spoken


def passages(w: Windows, spoken: np.ndarray):
    """(words joined by spaces, doc_id, first word, in how many blocks at least) of stretches that the block speaks for."""
    yes = spoken > 0
    cut = np.flatnonzero(np.diff(np.r_[0, yes.astype(np.int8), 0]))
    starts, vocab = np.r_[0, np.cumsum(w.lens)], None
    for a, b in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
        breaks = np.flatnonzero((np.diff(w.at[a:b]) != 1) | (np.diff(w.doc[w.at[a:b]]) != 0)) + a + 1
        for i, j in zip([a, *breaks.tolist()], [*breaks.tolist(), b], strict=True):
            for k in range(i, j, PIECE):
                n, at = min(PIECE, j - k), int(w.at[k])
                vocab = vocab or listed(w.vocab)
                doc = int(w.doc[at])
                yield b" ".join([vocab[x] for x in w.word[at : at + n + WINDOW - 1].tolist()]), int(w.ids[doc]), at - int(starts[doc]), int(spoken[k : k + n].min())


class Automata:
    """Shards of confirmed passages (words, doc_id, first word)."""

    def __init__(self, confirmed: list[tuple[bytes, int, int]]):
        self.shards, size = [], SHARD_BYTES
        for words, doc, at in confirmed:
            if size >= SHARD_BYTES:
                self.shards.append(ahocorasick.Automaton())
                size = 0
            text = f" {words.decode('latin-1')} "  # a character for each byte
            if text not in self.shards[-1]:
                self.shards[-1].add_word(text, (len(text), words.count(b" ") + 1, doc, at))
            size += len(text)
        for s in self.shards:
            s.make_automaton()

    def settled(self, w: Windows, texts: list[bytes], may: np.ndarray | None = None) -> np.ndarray:
        """Which windows of the block's documents lie in a passage that a smaller doc_id holds; may: all such are among these,
        as their phrases recur."""
        edge = np.zeros(len(w.word) + 1, np.int64)
        at = w.at if may is None else w.at[may]
        cut = np.flatnonzero(np.diff(at) != 1) + 1  # no run goes on in the next document
        starts, doc, words = np.r_[0, np.cumsum(w.lens)], -1, []
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True) if len(at) and self.shards else ():
            a, b = int(at[i]), int(at[j - 1]) + WINDOW
            if doc != w.doc[a]:
                doc = int(w.doc[a])
                words, before = texts[doc].split(), int(starts[doc])
            run, id_, ends = words[a - before : b - before], w.ids[doc], None
            line = f" {b' '.join(run).decode('latin-1')} "
            for shard in self.shards:
                for e, (_, count, of, _) in shard.iter(line):
                    if of < id_:
                        if ends is None:
                            ends = {e: k for k, e in enumerate(accumulate([len(x) + 1 for x in run]), 1)}
                        last = a + ends[e]  # words before the passage's end
                        edge[last - count] += 1
                        edge[last - WINDOW + 1] -= 1
        return np.cumsum(edge)[:-1][w.at] > 0


def windows_of(w: Windows, may: np.ndarray, n_parts: int):
    """(both hashes of the distinct windows that may recur in order of their first place, those places, inverse, part)."""
    x, y = w.hashes(may)
    order = np.lexsort((y, x))  # stable: of equal ones the first place comes first
    new = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])] if len(x) else np.empty(0, bool)
    first, inverse = order[new], np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    by_place = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[by_place] = np.arange(len(first))
    first = first[by_place]
    return x[first], y[first], w.at[may][first], rank[inverse], (x[first] % np.uint64(n_parts)).astype(np.int32)


def reply_first(part, bodies):
    """For each window: is another block's place earlier?  Below part 0, what a block keeps for itself."""
    if part < 0:
        yield from bodies
        return
    if not bodies:
        return
    x, y, doc = np.concatenate([b[0] for b in bodies]), np.concatenate([b[1] for b in bodies]), np.concatenate([np.repeat(b[2], b[3]) for b in bodies])
    block = np.repeat(np.arange(len(bodies)), [len(b[0]) for b in bodies])
    order = np.lexsort((block, doc, y, x))
    later = np.zeros(len(x), bool)
    later[order[1:]] = (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
    for part in np.split(later, np.cumsum([len(b[0]) for b in bodies])[:-1]):
        yield (np.packbits(part),)


def removed(w: Windows, n_parts: int, got: dict) -> np.ndarray:
    """Which words go, from what the block kept for itself and the partitions' answers."""
    may, settled = (np.unpackbits(x, count=len(w.at)).astype(bool) for x in next(x for p, x in got.items() if p < 0))
    _, _, first, inverse, part = windows_of(w, may, n_parts)
    order, cuts = by_part(part)
    later = np.zeros(len(part), bool)
    for p, s in cuts:
        later[order[s]] = np.unpackbits(got[p][0], count=s.stop - s.start).astype(bool)
    at = w.at[may]
    at = np.r_[at[later[inverse] | (at != first[inverse])], w.at[settled]]
    edge = np.zeros(len(w.word) + 1, np.int64)
    edge[at] += 1  # each place is there once
    edge[at + WINDOW] -= 1
    return np.cumsum(edge)[:-1] > 0


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_removed and kept (the words that stay as UTF-8, joined by spaces); columns of these names are replaced."""
    docs = docs.drop(*(n for n, _ in KEPT))
    flat = docs.withColumn("text", F.col("text").cast("binary")).withColumn("__id", F.col("doc_id").cast("long"))
    schema = pa.schema([(f.name, pa.null()) for f in flat.schema])
    blocks = pack(flat, encode(schema), BLOCK)
    heaps_released(docs.sparkSession)
    n_parts = parts(blocks)

    def ask_phrases(payload):
        w = Windows(payload)
        x, _, many, part = phrases_of(w, n_parts)
        order, cuts = by_part(part)
        for p, s in cuts:
            yield p, (x[order[s]], np.packbits(many[order[s]]), int(w.ids[0]))

    stage = answered(blocks, answer(ask(blocks, ask_phrases), reply_recurring))
    automata = docs.sparkSession.sparkContext.broadcast(confirmed(stage, n_parts))

    def ask_windows(payload, got):
        w = Windows(payload)
        _, of_window, _, part = phrases_of(w, n_parts)
        may = heard(part, got)[0][of_window]
        settled = machines(automata).settled(w, payload[1], may)
        may &= ~settled
        x, y, first, rank, part = windows_of(w, may, n_parts)
        yield -1 - (zlib.crc32(w.ids.tobytes()) & 0xFFFFF), (np.packbits(may), np.packbits(settled))  # spread, as many groups as blocks
        order, cuts = by_part(part)
        for p, s in cuts:
            doc = w.doc[first[order[s]]]
            runs = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            yield p, (x[order[s]], y[order[s]], w.ids[doc[runs]], np.diff(np.r_[runs, len(doc)]))

    stage = answered(blocks, answer(ask(stage, ask_windows), reply_first))
    heaps_released(docs.sparkSession)
    out = T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in KEPT)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, text = to_arrow_schema(out), docs.columns.index("text")

    def finish(batches):
        for one in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            for _, payload, windows in rows(one):
                block = unsqueeze(payload)
                w = Windows(block)
                gone = removed(w, n_parts, opened(windows))
                a, held = 0, []
                for n, whole, r in zip(w.lens.tolist(), *block[1:], strict=True):
                    words, out = whole.split(), gone[a : a + n]
                    lost = int(out.sum())
                    kept = [words[i] for i in np.flatnonzero(~out).tolist()] if lost else words
                    held.append((*(v.decode() if i == text and v is not None else v for i, v in enumerate(r)), n, lost, b" ".join(kept)))
                    a += n
                    if len(held) == 256:
                        yield of(held)
                        held = []
                yield of(held)

    def of(held):
        columns = zip(*held, strict=True) if held else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return stage.mapInArrow(trimmed(finish), out)


_machines: list = []


def machines(automata) -> Automata:
    """The worker's own of what was broadcast; one is kept."""
    passages = automata.value  # one object in a worker
    if not _machines or _machines[0] is not passages:
        _machines[:] = passages, Automata(passages)
    return _machines[1]


def confirmed(stage: DataFrame, n_parts: int) -> list[tuple[bytes, int, int]]:
    """Passages (words, doc_id, first word) that stand in most blocks: at most PASSAGE_BYTES of words; other windows are asked about."""
    def emit(found):
        for _, payload, got in found:
            told = opened(got)
            if any(len(times) for _, _, times in told.values()):  # most blocks speak for nothing
                w = Windows(unsqueeze(payload))
                _, of_window, _, part = phrases_of(w, n_parts)
                yield from passages(w, heard(part, told)[1][of_window])

    fields = [("words", pa.binary()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]
    made = map_rows(stage, emit, fields, "words binary, doc long, at long, n long", 1024)
    most = made.orderBy(F.desc("n"), "doc", "at").limit(PASSAGE_BYTES // (2 * WINDOW)).collect()  # a window has 2 * WINDOW - 1 bytes at least
    size = np.cumsum([len(r["words"]) for r in most])
    return [(bytes(r["words"]), r["doc"], r["at"]) for r, n in zip(most, size, strict=True) if n <= PASSAGE_BYTES]


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
