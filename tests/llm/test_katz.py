import functools
import math
import zlib
from collections import Counter

import pytest

from tests.llm.helpers import corpus, frame
from trellis.llm import katz as m


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*low.encode().split(), b""]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def grams_of(w, k):
    """The k-grams of a text as (history, word); a start sign stands before it."""
    full = [None, *w]
    return [(tuple(full[j - k + 1 : j]), full[j]) for j in range(1, len(full)) if j - k + 1 >= 0]


def brute_of_order(rows, order):
    """Scores by a recursion over dictionaries, for any order; and the recursion."""
    tables = {k: Counter() for k in range(1, order + 1)}
    for i, t in rows:
        if not held(i):
            for k in tables:
                tables[k].update(grams_of(tokens(t), k))
    follow = {k: {} for k in tables}
    for k, table in tables.items():
        for (h, w), c in table.items():
            follow[k].setdefault(h, {})[w] = c

    def discounts(counts):
        cc, out = Counter(counts), {}
        for r in range(1, 6):
            try:
                big = 6 * cc[6] / cc[1]
                d = ((r + 1) * cc[r + 1] / (r * cc[r]) - big) / (1 - big)
            except ZeroDivisionError:
                d = -1
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return lambda c: c * out.get(c, 1.0)

    d = {k: discounts(tables[k].values()) for k in tables}

    @functools.cache
    def weights(h):
        """(sum of counts, alpha, whether none is left) of a seen history."""
        k = len(h) + 1
        n, left = sum(follow[k][h].values()), sum(c - d[k](c) for c in follow[k][h].values())
        mass = sum(p(h[1:], w) for w in follow[k][h]) if h else 0.0
        return n, (left / n if left > 0 else 1 / (n + 1)) / (1 - mass), left <= 0

    def p(h, w):
        k = len(h) + 1
        if h not in follow[k]:
            return p(h[1:], w) if h else 1.0
        n, alpha, none = weights(h)
        if w in follow[k][h]:
            return follow[k][h][w] / (n + 1) if none else d[k](follow[k][h][w]) / n
        return alpha * p(h[1:], w) if h else alpha

    def score(w):
        full = [None, *w]
        return sum(math.log10(p(tuple(full[max(0, j - order + 1) : j]), full[j])) for j in range(1, len(full)))

    return [score(tokens(t)) for _, t in rows], p, follow


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_against_a_recursion(spark, order):
    rows = corpus(3, 40)
    want = brute_of_order(rows, order)[0]
    got = m.katz_scores(frame(spark, rows), order=order).collect()
    key = lambda r: (repr(r[0]), r[1], round(r[2], 6))
    told = sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key)
    for a, b in zip(told, sorted(((i, len(tokens(t)), x) for (i, t), x in zip(rows, want, strict=True)), key=key), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9), (a, b)


def test_each_history_of_each_order_adds_up_to_one():
    _, p, follow = brute_of_order(corpus(2, 30), 3)
    words = [*follow[1][()], b"never seen"]
    for h in [(), (None,), *list(follow[2])[:15], *list(follow[3])[:25], (b"never", b"seen")]:
        assert math.isclose(sum(p(h, w) for w in words), 1, rel_tol=1e-9), h


def brute(rows):
    """Plain dictionaries: {row: (n_tokens, n_known, N, base, score)}."""
    uni, bi = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = tokens(t)
            uni.update(w)
            bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        cc = Counter(counts)
        out = {}
        for r in range(1, 6):
            try:
                big = 6 * cc[6] / cc[1]
                d = ((r + 1) * cc[r + 1] / (r * cc[r]) - big) / (1 - big)
            except ZeroDivisionError:
                d = -1
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return lambda c: c * out.get(c, 1.0)

    d1, d2 = discounts(uni.values()), discounts(bi.values())
    left = sum(c - d1(c) for c in uni.values())
    total = n if left > 0 else n + 1
    p1 = lambda w: d1(uni[w]) / total if uni[w] else (left if left > 0 else 1.0) / max(total, 1)
    follow, seen = {}, Counter()
    for (h, w), c in bi.items():
        follow.setdefault(h, {})[w] = c
        seen[h] += c

    def p2(h, w):
        if not seen[h]:
            return p1(w)
        back = sum(c - d2(c) for c in follow[h].values())
        none = back <= 0
        if w in follow[h]:
            return follow[h][w] / (seen[h] + 1) if none else d2(follow[h][w]) / seen[h]
        alpha = (1 / (seen[h] + 1) if none else back / seen[h]) / (1 - sum(p1(x) for x in follow[h]))
        return alpha * p1(w)

    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, base, sum(math.log10(p2(h, x)) for h, x in zip([None, *w], w))))
    return out, (p1, p2, uni, seen)


@pytest.mark.parametrize("seed", [1, 5])
def test_against_dictionaries(spark, seed):
    rows = corpus(seed)
    got = [tuple(r) for r in m.katz_scores(frame(spark, rows)).collect()]
    want, _ = brute(rows)
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9), (a, b)


def test_each_history_adds_up_to_one():
    _, (p1, p2, uni, seen) = brute(corpus(2))
    words = [*uni, b"never seen"]
    assert math.isclose(sum(p1(w) for w in words), 1)
    for h in [None, b"never seen", *list(uni)[:40]]:
        assert math.isclose(sum(p2(h, w) for w in words), 1, rel_tol=1e-9)


def test_empty_tables_and_no_training_rows(spark):
    docs = frame(spark, corpus())
    assert m.katz_scores(docs.limit(0)).count() == 0
    held_ids = [i for i in range(60) if held(i)]
    out = m.katz_scores(docs.where(f"doc_id in ({', '.join(map(str, held_ids))})")).collect()
    assert out and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in out)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: r for r in brute(rows)[0]}
    got = m.op4(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[:5] == w[:5] and math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isclose(r.score, w[6], rel_tol=1e-9)


def test_a_block_is_encoded_without_an_object_for_each_token():
    import tracemalloc

    text = b" ".join(b"w%d" % (i * i % 997) for i in range(200_000))
    m.encode(7, 2)([(1, b"what is imported once")])
    tracemalloc.start()
    vocab, _, word, lens, _, _ = m.encode(7, 2)([(1, text), (2, b""), (3, b" A b\x0ba ")])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = vocab.split(b"\n")
    assert lens.tolist() == [200_001, 1, 4] and word[200_000:].tolist()[:2] == [0, 0]
    assert [held[i] for i in word.tolist()] == [*text.split(), b"", b"", b"a", b"b", b"a", b""]
    assert peak < 6 << 20
