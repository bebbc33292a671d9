import random

import numpy as np
import pytest

from trellis.llm.pieces import NEVER, Model, chunks, combine, encoded, fold, states, taken


@pytest.fixture(scope="module")
def model():
    return Model()


def by_chunks(m, text, size, group=4):
    """Ids by matrices, folded in groups."""
    made = [m.measure(*c) for c in chunks(text, m.longest, size)]
    groups = [[t for t, _ in made[i : i + group]] for i in range(0, len(made), group)]
    at = states([fold(g) for g in groups], 0, 0)
    inner = [s for g, a, b in zip(groups, at, at[1:], strict=False) for s in states(g, a, b)[:-1]] + [at[-1]]
    ids = b"".join([taken(p, a, b) for (_, p), a, b in zip(made, inner, inner[1:], strict=False)])
    return np.frombuffer(ids, "<u4").tolist(), fold(t for t, _ in made)[0, 0]


def texts(n=300, seed=3):
    r = random.Random(seed)
    bits = ["the", "ing", " ", "  ", "   ", "-", "--", "=", "é", "Überß", "日本語", "\n", "\t", "🙂", "a", "aa", "in", "er", "ation", "\x00", "1", "12", "/", "_", "▁", "▁▁", "国", "한국", "</s>", "<0x41>"]
    out = []
    for _ in range(n):
        some = r.sample(bits, r.randint(1, 6))
        out.append("".join(r.choice(some) for _ in range(r.randint(1, 60))))
    return [*out, "-" * 900, "=" * 700, " " * 500, "a" * 300, "ab" * 200, "日本語" * 90, " -" * 200, "aaab" * 60, "▁" * 55, "x"]


def test_ids_are_the_library_s_wherever_a_text_is_cut(model):
    for t in texts():
        want = model.library.encode(t)
        for size in (1, 3, 16, 17, 64, 5000) if len(t) < 100 else (16, 100, 5000):
            got, total = by_chunks(model, t, size)
            assert got == want, (t, size)
            assert -total == len(want)
        assert np.frombuffer(model.encode(t), "<u4").tolist() == want
        assert model.decode(model.encode(t)).decode() == t.replace("▁", " ")


def test_documents_of_the_driver_by_chunks(spark, model):
    for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        if t:
            assert by_chunks(model, t, 700)[0] == model.library.encode(t)


def test_combining_is_associative():
    r = np.random.default_rng(1)
    a, b, c = r.integers(-100, 0, (3, 4)), r.integers(-100, 0, (4, 2)), r.integers(-100, 0, (2, 5))
    a[0, 1] = b[2, 0] = NEVER
    assert (combine(combine(a, b), c) == combine(a, combine(b, c))).all()
    assert (fold(iter([a, b, c])) == combine(combine(a, b), c)).all()


def test_documents_short_long_null_and_empty(spark, model):
    rows = [(1, "hello  world"), (2, ""), (None, None), (3, "the thonerst ción " * 300), (3, "z" * 3000), (4, "\x00 end"), (5, "x" * 99), (6, "y" * 100), (7, "-" * 40_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist()) for r in encoded(docs, size=100, group=8).collect())
    assert got == sorted((i or 0, t or "", model.library.encode(t) if t else []) for i, t in rows)
    assert encoded(docs.limit(0)).count() == 0
