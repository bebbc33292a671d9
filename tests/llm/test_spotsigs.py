import hashlib
import random
import time

import pytest

from tests.llm.helpers import corpus, frame
from trellis.llm import near_copies
from trellis.llm import spotsigs as m


def brute_spots(t):
    words = [w for w in (x.strip(m.MARKS) for x in t.lower().split()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in m.ANCHORS:
            rest = [x for x in words[i + 1 :] if x not in m.COMMON][: m.CHAIN]
            if len(rest) == m.CHAIN:
                out.add((w, *rest))
    return out or {t}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def by_id(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1].encode()))


def op10_rows(spark, tmp_path, rows):
    d = str(tmp_path / "d")
    frame(spark, rows).write.mode("overwrite").parquet(f"{d}/documents.parquet")
    return m.op10(spark, d).collect()


@pytest.mark.parametrize("n", [0, 1, 2, 60])
def test_query_against_brute_force(spark, tmp_path, n):
    rows = corpus(9) if n == 60 else [(i * 5, f"the cat sat on a mat {i}") for i in range(n)]
    got = op10_rows(spark, tmp_path, rows)
    order = by_id(rows)
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut] if cut else t
        a, b, c = brute_spots(t), brute_spots(new), brute_spots(after)
        want.append((repr(i), len(t), hashlib.sha256(new.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    texts = {}
    for (i, t), r in zip(order, sorted(got, key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars)), strict=True):
        texts.setdefault(t, set()).add(r.fingerprint) if rows.count((i, t)) == 1 and [x for x, _ in rows].count(i) == 1 else None
    assert all(len(x) == 1 for x in texts.values())


def classes(rows):
    """The least id of the sets that links of at least 0.8 join, by set."""
    sets = sorted({frozenset(brute_spots(t or "")) for _, t in rows}, key=lambda s: sorted(map(repr, s)))
    of = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if of[i] != of[j] and jaccard(a, sets[j]) >= 0.8:
                x, y = of[i], of[j]
                of = [y if o == x else o for o in of]
    least = {}
    for i, t in rows:
        c = of[sets.index(frozenset(brute_spots(t or "")))]
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted((repr(i), repr(least[of[sets.index(frozenset(brute_spots(t or "")))]])) for i, t in rows)


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_classes_against_brute_force(spark, tmp_path, monkeypatch, few):
    """Copies edited little and much, chains of copies, lengths on both sides of a power of two, texts that share many spots."""
    monkeypatch.setattr("trellis.llm.common.FEW_ROWS", few)
    r, rows = random.Random(4), corpus(3, 60)
    phrase = lambda k: f"the n{k} v{k}"
    for size in (5, 14, 17, 63, 66, 130):
        base = [r.randrange(10**9) for _ in range(size)]
        for _ in range(7):
            rows.append((len(rows) + 1000, " ".join(map(phrase, base))))
            base = [x if r.random() > 0.05 else r.randrange(10**9) for x in base]
        rows.append((len(rows) + 1000, " ".join(map(phrase, base[: int(0.85 * size)]))))
        for _ in range(6):  # most spots in common, but under 0.8
            rows.append((len(rows) + 1000, " ".join(map(phrase, base[: int(0.7 * size)] + [r.randrange(10**9) for _ in range(int(0.3 * size))]))))
    got = op10_rows(spark, tmp_path, rows)
    assert sorted((repr(x.doc_id), repr(x.class_id)) for x in got) == classes(rows)


def test_texts_shuffle_is_gone_before_the_join(spark, tmp_path, monkeypatch):
    """The shuffle files that fingerprints took are dropped when the join begins, not with its first steps."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    d, seen = str(tmp_path / "d"), []
    frame(spark, corpus(5)).write.parquet(f"{d}/documents.parquet")

    def join(docs):
        time.sleep(1)  # files are removed in the background
        seen.append(files())
        return spark.createDataFrame([], "node long, class_id long")

    monkeypatch.setattr(m, "near_classes", join)
    for _ in range(2):
        m.emptied(spark)
        time.sleep(1)
    before = files()
    m.op10(spark, d).collect()
    assert seen[0] <= before


def test_rounds_over_few_entries_take_one_part(spark, tmp_path, monkeypatch):
    """Many near copies of one text: the same classes, whether the rounds are in one part or in many."""
    r, rows = random.Random(6), []
    base = [r.randrange(10**9) for _ in range(40)]
    for i in range(60):
        own = [x if r.random() > 0.06 else r.randrange(10**9) for x in base]
        rows.append((i, " ".join(f"the n{k} v{k}" for k in own)))
    parts, verified = [], near_copies.verified

    def seen(*given):
        found = verified(*given)
        parts.append(found.rdd.getNumPartitions())
        return found

    monkeypatch.setattr(near_copies, "verified", seen)
    monkeypatch.setattr(near_copies, "MANY", 4)
    got = lambda: sorted((repr(x.doc_id), repr(x.class_id)) for x in op10_rows(spark, tmp_path, rows))
    assert got() == classes(rows)
    assert parts and set(parts) == {1}
    del parts[:]
    monkeypatch.setattr(near_copies, "ENTRIES", 0)
    assert got() == classes(rows)
    assert parts and max(parts) > 1
