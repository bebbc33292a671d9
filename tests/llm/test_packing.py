import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import corpus, frame
from trellis.llm import packing as m


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(m.default_tokenizer())


def test_ids_of_stretches_are_the_ids_of_the_whole(tokenizer):
    r = random.Random(5)
    bits = ["the", "Don't", "'S", "ＡＢ", "é", "é", "́", " ", " ", "\x1c", "\x85", "日本", "🙂", "12.5", "Σ", "ς", "İ", "<|endoftext|>", "<|startoftext|>", " ", "\t", "\n", "\r", "\x0b", "\x0c", "-", "_x_", "</w>", "​", "ﬁ", "I", "̇", "A.", "b,,", "!?", "x***", "&&&", "é...", "ß:", "×.", "÷", "'t.", "<|ENDOFTEXT|>", "<", "|>", "…", "3.", "²,"]
    encode = m.Encoder(None)
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_best_fit_against_a_plain_search():
    r = random.Random(1)
    for _ in range(200):
        room = r.choice([7, 16, 100, 4096])
        lengths = sorted((r.randint(1, room) for _ in range(r.randint(0, 60))), reverse=True)
        fill = []
        for n in lengths:
            fits = [i for i, f in enumerate(fill) if room - f >= n]
            if fits:
                best = max(fits, key=lambda i: fill[i])
                fill[best] += n
            else:
                fill.append(n)
        counts = Counter(lengths)
        plan = m.best_fit(counts, room)
        ranks = np.array([k for n in sorted(counts, reverse=True) for k in range(counts[n])], np.int64)
        seqs, offsets = m.placed(np.array(lengths, np.int64), ranks, plan) if lengths else ([], [])
        used = {}
        for s, o, n in sorted(zip(seqs, offsets, lengths, strict=True)):
            assert used.get(s, 0) == o
            used[s] = o + n
        assert sorted(used.values()) == sorted(fill) and max(used.values(), default=0) <= room


def test_plan_stays_small_for_many_pieces():
    r = random.Random(2)
    counts = {n: r.randint(1, 10**9) for n in range(1, 4097)}
    plan = m.best_fit(counts)
    assert len(plan) < 150_000
    most = {n: max(k for m, k, *_ in plan if m == n) for n in (1, 2000, 4096)}
    assert all(k < counts[n] for n, k in most.items())


def test_documents_of_all_sorts(spark, tokenizer):
    rows = [*corpus(4), (77, "word " * 9000)]
    docs = frame(spark, rows)
    got = m.packed(docs).collect()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(repr(i), k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1
    assert m.packed(docs.limit(0)).count() == 0
