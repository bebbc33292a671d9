"""Language-model scores by Katz backoff over word n-grams of any order.

Katz's recursion: P(w | h) = d(c(h, w)) c(h, w) / c(h) where the gram was seen, else alpha(h) P(w | h'), h' the history
without its first word; and P(w) = d(c(w)) c(w) / N where the word was seen, else the mass that the discounts leave, as
that of one unknown word.  The discounts d are Good-Turing's for counts of at most 5, for each order from its counts of
counts over all of the training documents.  alpha(h) = (1 - sum of the seen P(w | h)) / (1 - sum of P(w | h') over the
same words), so that each history's probabilities over the vocabulary and the unknown word add up to one; a history
never seen has alpha 1.

The count tables, one for each order, are partitioned by hash (of the word, of the history) and checkpointed: the
partitions keep each block's share of the answers.  Words get numbers in the first round, most frequent first in each
partition, so a bigram takes a few bytes.  The grams of the next order are asked about with the probabilities of the
shorter ones, which the answers before gave.  Histories with over N / (8 * partitions) tokens are salted by the word
that follows; what the salts know of one history is added up on the driver, at most 16 rows for each partition.

A text's tokens are its lower-cased words and then one end; the first word's history is a start sign.

Defined results: a null text is empty (its only token is the end); a null doc_id is in the training part; rows that
repeat a doc_id each count and each get a score; texts of any length are scored whole.  Where counts of counts can't give
a discount in (0, 1) (tables of a few rows), it is (r - 0.5) / r.  A history all of whose followers have undiscounted
counts leaves nothing to back off with; then c(h, w) / (c(h) + 1) and 1 / (c(h) + 1) take their places.  Without any
training token every word is unknown, with probability 1.  Histories of two words and more are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import answer, answered, asides, ask, by_part, gathered, opened, pack, parts
from .common import batch_of, documents, remainder, rows, table, trimmed, unsqueeze
from .phrase_automata import listed, numbered

#: Counts that are discounted at most; the order of the query's model.
CUT, ORDER = 5, 2
FIELDS = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discounts(n: np.ndarray) -> np.ndarray:
    """d of counts 0 to 5 from the numbers n[r] of items that were counted r times, r = 0 to 6; larger counts have 1."""
    r = np.arange(1, CUT + 1)
    with np.errstate(all="ignore"):
        big = (CUT + 1) * n[CUT + 1] / n[1]
        d = ((r + 1) * n[r + 1] / (r * n[r]) - big) / (1 - big)
    return np.r_[0.0, np.where((d > 0) & (d < 1), d, (r - 0.5) / r)]


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c > CUT, 1.0, d[np.minimum(c, CUT)])


class Unigrams:
    """N, V and the probabilities of words by their counts."""

    def __init__(self, said: list):
        self.n, self.v = sum(x[0] for x in said), sum(x[1] for x in said)
        self.cc = sum((x[2] for x in said), np.zeros(CUT + 2, np.int64))
        self.d = discounts(self.cc)
        low = np.arange(CUT + 1)
        left = float((self.cc[: CUT + 1] * (low - discounted(low, self.d))).sum())
        self.seen_of = self.n if left > 0 else self.n + 1  # no discounted count: as for histories
        self.unknown = (left if left > 0 else 1.0) / max(self.seen_of, 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(self.seen_of, 1), self.unknown)


def encode(held_by: int, held_is: int):
    def run(held: list[tuple]) -> tuple:
        words, number, lens = numbered([text.lower() for _, text in held])
        vocab, lens = [b"", *listed(words)], lens.astype(np.int64) + 1
        word = np.zeros(int(lens.sum()), np.int32)  # 0 is the end of a text
        ends = np.zeros(len(word), bool)
        ends[np.cumsum(lens) - 1] = True
        word[~ends] = number + 1
        part = np.fromiter(map(xxhash.xxh32_intdigest, vocab), np.int64, len(vocab)) >> 1
        out = np.array([remainder(i, held_by) == held_is for i, _ in held])
        return b"\n".join(vocab), part.astype(np.int32), word, lens, [i for i, _ in held], out

    return run


def ask_words(payload, n_parts: int):
    vocab, part, word, lens, _, out = payload
    part = part % n_parts
    count = np.bincount(word[~np.repeat(out, lens)], minlength=len(part)).astype(np.int64)
    vocab = vocab.split(b"\n")
    order, cuts = by_part(part)
    for p, s in cuts:
        yield p, (b"\n".join([vocab[i] for i in order[s].tolist()]), count[order[s]])


def reply_words(n_parts: int):
    def run(p, bodies):
        of = pa.array([x for b in bodies for x in b[0].split(b"\n")], pa.binary()).dictionary_encode()
        of = of.combine_chunks() if isinstance(of, pa.ChunkedArray) else of
        i = of.indices.to_numpy()
        count = np.zeros(len(of.dictionary), np.int64)
        np.add.at(count, i, np.concatenate([b[1] for b in bodies]))
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        at = np.cumsum([len(b[1]) for b in bodies])[:-1]
        yield from zip(np.split(count[i], at), np.split(rank[i] * n_parts + p, at), strict=True)
        yield int(count.sum()), int((count > 0).sum()), np.bincount(count[count <= CUT + 1], minlength=CUT + 2)

    return run


class Block:
    """A block's tokens with the counts and numbers of its words."""

    def __init__(self, payload, got, n_parts: int):
        _, part, self.word, self.lens, self.ids, self.out = payload
        part = part % n_parts
        self.count, self.number = gathered(part, got, 0, np.int64), gathered(part, got, 1, np.int64)
        self.at = np.r_[0, np.cumsum(self.lens)[:-1]]
        self.trains = ~np.repeat(self.out, self.lens)


class Grams:
    """The distinct grams of an order in a block, in order of history and word; below: those of the order before and their counts."""

    def __init__(self, block: Block, n_parts: int, hot: int, below: tuple | None = None):
        v, tokens = len(block.count), np.arange(len(block.word))
        if below is None:
            history = np.r_[v, block.word[:-1]].astype(np.int64) if len(tokens) else np.empty(0, np.int64)
            history[block.at] = v
            names, of = np.r_[block.number, -1], np.r_[block.count, block.count[0]]  # a start for each end
        else:
            grams, of = below
            before = np.r_[-1, grams.inverse[:-1]] if len(tokens) else np.empty(0, np.int64)
            before[block.at] = -1
            tokens = np.flatnonzero(before >= 0)
            history, names = before[tokens], mixed(grams.h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + grams.n.view(np.uint64)).view(np.int64)
        key, inverse = np.unique(history * (v + 1) + block.word[tokens], return_inverse=True)
        self.inverse = np.full(len(block.word), -1)
        self.inverse[tokens] = inverse
        h, self.w = np.divmod(key, v + 1)
        self.of, self.h, self.n = of[h], names[h], block.number[self.w]
        self.seen = np.bincount(inverse, block.trains[tokens], len(key)).astype(np.int64)
        salts = -(-self.of // hot)
        self.part = np.where(salts > 1, (self.h * 31 + (self.n * 0x9E3779B1 >> 7) % np.maximum(salts, 1)) % n_parts + n_parts, self.h % n_parts).astype(np.int64)
        self.part[self.of == 0] = -1  # a history never seen: nothing to ask


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unseen(total: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which runs (histories, by their first places) hold a bigram that wasn't seen."""
    return np.add.reduceat((total == 0).astype(np.int64), runs) > 0


def reply_grams(lower, n_parts: int):
    """To each body: the counts of its grams; of each of its histories, whether nothing is left to back off with; and of
    histories with a gram never seen, the followers counted 1 to 5 times and the sum of the shorter grams' probabilities
    (lower of what the body says) of all followers.  Then counts of counts, and what this part knows of salted histories."""
    def run(p, bodies):
        h, w, c, cw = (np.concatenate([b[i] for b in bodies]) for i in range(4))
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
        total = np.add.reduceat(c[order], new)
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(h)]))
        mine = hs[new]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        low = np.stack([np.add.reduceat((total == r).astype(np.int64), first) for r in range(1, CUT + 1)], 1)
        mass = np.add.reduceat(np.where(total > 0, lower(cw[order][new]), 0.0), first)
        salted, names = p >= n_parts, mine[first]
        for b, i in zip(bodies, np.split(inverse, np.cumsum([len(b[0]) for b in bodies])[:-1]), strict=True):
            runs = np.flatnonzero(np.r_[True, b[0][1:] != b[0][:-1]])
            if salted:
                yield total[i], None
                continue
            at = np.searchsorted(names, b[0][runs])
            backs = at[unseen(total[i], runs)]
            yield total[i], np.packbits(low[at].any(1)), low[backs].T.ravel(), mass[backs].view(np.int64)
        yield np.bincount(total[total <= CUT + 1], minlength=CUT + 2), (names, low, mass) if salted else None

    return run


def probabilities(b: Grams, got: dict, known: tuple, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, count) of each distinct gram; known: discounts and salted histories of its order, lower: P of the shorter grams."""
    d, salted = known
    n = len(b.h)
    total, left, mass, none = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n, bool)
    leaves = np.arange(1, CUT + 1) - discounted(np.arange(1, CUT + 1), d)
    order, cuts = by_part(b.part)
    for p, s in cuts:
        if p < 0:
            continue
        i, (t, *more) = order[s], got[p]
        total[i] = t
        h = b.h[i]
        new = np.r_[True, h[1:] != h[:-1]]
        if more[0] is None:
            lo, ma = (np.array([salted[x][k] for x in h[new].tolist()]) for k in (0, 1))
            nothing = ~lo.any(1)
        else:
            backs = unseen(t, np.flatnonzero(new))
            lo, ma, nothing = np.zeros((len(backs), CUT), np.int64), np.zeros(len(backs)), ~np.unpackbits(more[0], count=len(backs)).astype(bool)
            lo[backs], ma[backs] = more[1].reshape(CUT, -1).T, more[2].view(np.float64)
        of_run = np.cumsum(new) - 1
        left[i], mass[i], none[i] = (lo * leaves).sum(1)[of_run], ma[of_run], nothing[of_run]
    of = np.maximum(b.of, 1)
    p_seen = np.where(none, total / (of + 1), discounted(total, d) / of)
    alpha = np.where(none, 1 / (of + 1), left / of) / np.maximum(1 - mass, 1e-300)
    return np.where(b.of == 0, lower, np.where(total > 0, p_seen, alpha * lower)), total


def katz_scores(docs: DataFrame, held_by: int = 7, held_is: int = 2, order: int = ORDER) -> DataFrame:
    """The columns of DDL for each row; documents with crc32(doc_id) mod held_by = held_is don't train."""
    blocks = pack(documents(docs), encode(held_by, held_is))
    n_parts = parts(blocks)
    words = answer(ask(blocks, lambda payload: ask_words(payload, n_parts)), reply_words(n_parts))
    uni = Unigrams(asides(words))
    hot = max(64, uni.n // (8 * n_parts))
    levels: list[DataFrame] = []
    known: list[tuple] = []  # of each order from 2 on: discounts, salted histories

    def climb(payload, got_words, gots):
        """(block, grams and their P by order, grams of the next order and P of the shorter ones)."""
        block, below, out = Block(payload, got_words, n_parts), None, []
        lower = lambda g: uni.p(block.count[g.w])
        for got, of in zip(gots, known, strict=True):
            g = Grams(block, n_parts, hot, below)
            p, total = probabilities(g, got, of, lower(g))
            out.append((g, p))
            below, lower = (g, total), shorter(block, g, p)
        return block, out, below, lower

    for k in range(2, order + 1):
        def ask_grams(payload, got_words, *gots):
            block, _, below, lower = climb(payload, got_words, gots)
            b = Grams(block, n_parts, hot, below)
            low = block.count[b.w] if below is None else lower(b).view(np.int64)
            by, cuts = by_part(b.part)
            for p, s in cuts:
                if p >= 0:
                    i = by[s]
                    yield p, (b.h[i], b.n[i], b.seen[i], low[i])

        levels.append(answer(ask(answered(blocks, words, *levels), ask_grams), reply_grams(uni.p if k == 2 else lambda x: x.view(np.float64), n_parts)))
        said = asides(levels[-1])
        salted: dict[int, list] = {}
        for _, x in said:
            for name, low, mass in zip(*x, strict=True) if x else ():
                old = salted.get(int(name), (0, 0.0))
                salted[int(name)] = (old[0] + low, old[1] + mass)
        known.append((discounts(sum((x[0] for x in said), np.zeros(CUT + 2, np.int64))), salted))

    def finish(batches):
        schema = pa.schema(FIELDS)
        for batch in batches:
            for _, payload, w, *gots in rows(batch):
                b, grams, *_ = climb(unsqueeze(payload), opened(w), [opened(g) for g in gots])
                p = uni.p(b.count[b.word])
                for g, of_gram in grams:  # the longest history that a token has
                    p = np.where(g.inverse >= 0, of_gram[g.inverse], p)
                add = lambda x: np.add.reduceat(x, b.at).tolist()  # noqa: B023, E731
                c = b.count[b.word]
                base = np.log10((c + 1) / (uni.n + uni.v + 1))
                yield batch_of(schema, list(zip(b.ids, b.out.tolist(), b.lens.tolist(), add((c > 0).astype(np.int64)), [uni.n] * len(b.ids), add(base), add(np.log10(p)), strict=True)))

    return answered(blocks, words, *levels).mapInArrow(trimmed(finish), DDL)


def shorter(block: Block, grams: Grams, p: np.ndarray):
    """For grams of the next order: P of each one's word after the history without its first word, which ends the same token."""
    def lower(g: Grams) -> np.ndarray:
        token = np.zeros(len(g.h), np.int64)
        at = np.flatnonzero(g.inverse >= 0)
        token[g.inverse[at]] = at
        return p[grams.inverse[token]]

    return lower


def op4(spark, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"))
