import numpy as np
import pytest
import xxhash

from tests.llm.helpers import corpus, frame
from trellis.llm import near_copies, simhash_variants as m


def brute_fingerprint(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(keys, near):
    """{key: set of keys it reaches} by comparing all."""
    label = {k: k for k in keys}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(a, b):
                label[root(a)] = root(b)
    return {k: root(k) for k in keys}


def flips(seed: int, n: int) -> list[int]:
    """Fingerprints in groups of near ones, at 0 to 5 bits."""
    r = np.random.default_rng(seed)
    out = [0, (1 << 64) - 1, 1, 1 << 63]
    for _ in range(n):
        f = int(r.integers(0, 1 << 63)) * 2 + 1
        for _ in range(r.integers(1, 5)):
            out.append(f)
            for b in r.choice(64, r.integers(0, 6), replace=False):
                f ^= 1 << int(b)
    return sorted(set(out))


signed = lambda x: x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("seed", [1, 2])
def test_links_join_what_comparing_all_joins(spark, seed):
    fps = flips(seed, 60)
    links = m.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.a & mask) ^ (r.b & mask)).bit_count() <= 3 for r in links)
    want = joined(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = {(r.a & mask, r.b & mask) for r in links} | {(r.b & mask, r.a & mask) for r in links}
    got = joined(fps, lambda a, b: (a, b) in pairs)
    groups = lambda of: sorted(sorted(k for k in of if of[k] == g) for g in set(of.values()))
    assert groups(got) == groups(want)


def test_long_runs_are_split_without_loss(monkeypatch):
    base, r = 0x0123456789ABCDEF, np.random.default_rng(0)
    x = {base}
    while len(x) < 400:
        f = base
        for b in r.choice(32, r.integers(1, 5), replace=False):
            f ^= 1 << (32 + int(b))
        x.add(f)
    x = np.array(sorted(map(signed, x)), np.int64)
    whole = m.run_links(x, 0)
    monkeypatch.setattr(m, "RUN", 8)
    split = m.run_links(x, 0)
    groups = lambda found: sorted(map(sorted, {frozenset(k for k, g in of.items() if g == v) for of in [joined(x.tolist(), lambda a, b: (a, b) in found or (b, a) in found)] for v in of.values()}))
    assert groups(set(whole)) == groups(set(split))


def test_classes_of_documents(spark):
    rows = [*corpus(6), (70, "one two"), (71, "One  TWO"), (72, "Straße İ")]
    got = m.simhash_classes(frame(spark, rows)).collect()
    fp = {(i, t): brute_fingerprint(t) for i, t in rows}
    assert sorted((repr(r.doc_id), r.fp & (1 << 64) - 1) for r in got) == sorted((repr(i), f) for (i, t), f in zip(rows, (fp[x] for x in rows), strict=True))
    root = joined(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), f in fp.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert {(repr(r.doc_id), r.component_id) for r in got} == {(repr(i), least.get(root[f])) for (i, _), f in fp.items()}
    assert m.simhash_classes(frame(spark, rows).limit(0)).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_of_near_copies_stays(spark):
    rows = [x for x in corpus(8, 80)]
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    rows += [(200, long), (201, long + " more"), (202, long.replace("w5 ", "v5 ")), (203, long.upper().lower()), (204, " ".join(f"z{i}" for i in range(400)))]
    docs = frame(spark, rows)
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(repr((r.doc_id, r.text)) for r in kept.collect())
    at = list(range(len(rows)))
    of = joined(at, lambda a, b: (rows[a][1] or "") == (rows[b][1] or "") or jaccard(rows[a][1], rows[b][1]) >= 0.8)
    order = lambda k: near_copies.LAST if rows[k][0] is None else rows[k][0]
    want = sorted(repr(rows[min((k for k in at if of[k] == g), key=order)]) for g in set(of.values()))
    # texts without words are alike; which of equal ids stays doesn't matter
    assert got == want
    assert near_copies.one_of_each(docs.limit(0)).count() == 0
