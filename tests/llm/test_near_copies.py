import random

import numpy as np
import pytest

from tests.llm.helpers import frame
from trellis.llm import common
from trellis.llm import near_copies as m


def words(r, n):
    return [f"w{r.randrange(1 << 40)}" for _ in range(n)]


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + m.WORDS]) for i in range(max(1, len(w) - m.WORDS + 1))}


def brute(rows):
    """Ids that stay: the least of each group that all pairs of at least 0.8 join."""
    sets, of = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if of[i] != of[j] and len(a & sets[j]) >= m.LEAST * len(a | sets[j]):
                x, y = of[i], of[j]
                of = [y if o == x else o for o in of]
    return sorted(min(rows[k][0] for k in range(len(rows)) if of[k] == c) for c in set(of))


def edit(r, w, n):
    w = list(w)
    for i in r.sample(range(len(w)), n):
        w[i] = f"e{r.randrange(1 << 40)}"
    return w


def test_copies_among_documents_of_one_template(spark):
    """Texts share 60 to 88 in 100 of their words; each has a copy that its template's other texts are unlike."""
    r, rows = random.Random(1), []
    for share in (0.6, 0.75, 0.82, 0.88):
        template = words(r, int(400 * share))
        for _ in range(20):
            w = template + words(r, 400 - len(template))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(edit(r, w, 5)))]
    want = brute(rows)
    assert 60 <= len(want) <= 85
    assert sorted(x.doc_id for x in m.one_of_each(frame(spark, rows)).collect()) == want


def test_chains_and_groups_of_all_sizes(spark, monkeypatch):
    """Copies of copies, a text many edit differently, short texts; also when rounds go on as long as they may."""
    r, rows = random.Random(2), []
    put = lambda w: rows.append((len(rows), " ".join(w)))
    for n in (6, 12, 40, 200):
        w = words(r, n)
        for _ in range(8):
            put(w)
            w = edit(r, w, max(1, n // 60))
        base = words(r, n)
        for _ in range(15):
            put(edit(r, base, max(1, n // 60)))
        put(base)
    want = brute(rows)
    got = lambda: sorted(x.doc_id for x in m.one_of_each(frame(spark, rows)).collect())
    assert got() == want
    monkeypatch.setattr(m, "MANY", 2)
    assert got() == want
    monkeypatch.setattr(m, "ROUNDS", 2)
    assert got() == want
    monkeypatch.setattr(m, "ROUNDS", 0)  # all by runs and cells
    monkeypatch.setattr(m, "PAIRED", 1)
    assert got() == want
    monkeypatch.setattr(m, "CELL", 5)
    assert got() == want


def test_bands_find_what_is_alike():
    """Of 4000 pairs of sets at a similarity just over 0.8, all share a key, on both sides of the bounds of length."""
    r, none = np.random.default_rng(5), (np.empty(0, np.uint64), np.empty(0, np.int64))
    for n in (100, 160, 178, 190, 201, 240, 900, 5000):
        for _ in range(500):
            union = r.integers(0, 1 << 63, n, dtype=np.uint64)
            cut = int(0.1 * n)
            a, b = np.unique(union[cut:]), np.unique(np.r_[union[: cut], union[2 * cut :]])
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            x, y = m.minima(a), m.minima(b)
            assert not set(m.keys(a, x, none)[0]).isdisjoint(m.keys(b, y, none)[0]), n
            assert sum(p == q for p, q in zip(m.signature(x), m.signature(y), strict=True)) >= m.EQUAL


def test_few_links_are_joined_on_the_driver_as_by_shuffles(spark, monkeypatch):
    r = random.Random(5)
    links = [(r.randrange(-400, 400) * 7, r.randrange(-400, 400) * 7) for _ in range(260)] + [(10_000 + i, 10_001 + i) for i in range(60)] + [(3, 3)]
    edges = spark.createDataFrame(links, "a long, b long")
    want = sorted(map(tuple, common.components(edges).collect()))
    monkeypatch.setattr(common, "components", lambda _: "shuffled")
    assert sorted(map(tuple, common.joined(edges).collect())) == want
    assert common.joined(edges.limit(0)).collect() == []
    monkeypatch.setattr(common, "FEW_ROWS", len(links) - 1)
    assert common.joined(edges) == "shuffled"


def test_minima_of_a_large_set_take_little_memory_besides():
    import tracemalloc

    h = np.random.default_rng(3).integers(0, 1 << 63, 20_001).astype(np.uint64)
    want = [int((x ^ (x >> np.uint64(29))).min()) for x in (h * f for f in m.FACTORS[::40])]
    tracemalloc.start()
    got = m.minima(h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[::40].tolist() == want and peak < 1 << 20
