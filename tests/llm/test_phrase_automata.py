import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import corpus, frame
from trellis.llm import phrase_automata
from trellis.llm.phrase_automata import PHRASE, WINDOW, Automata, Windows, listed, numbered, phrases_of, rolling, without_repeats


def brute(rows):
    """(n_words, n_removed, kept) of each row, in order of rows."""
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if rows[i][0] is None else rows[i][0], (rows[i][1] or "").encode()))
    words = {i: (rows[i][1] or "").encode().split() for i in order}
    seen, gone = set(), {i: set() for i in order}
    for i in order:
        for a in range(len(words[i]) - WINDOW + 1):
            w = tuple(words[i][a : a + WINDOW])
            if w in seen:
                gone[i].update(range(a, a + WINDOW))
            seen.add(w)
    return [(len(words[i]), len(gone[i]), b" ".join(w for k, w in enumerate(words[i]) if k not in gone[i])) for i in range(len(rows))]


def test_words_are_cut_at_ascii_white_space_alone():
    texts = ["", "  ", " a  b\t\n\x0b\x0c\rc ", "a\x1cb\x85c d e", "x"]
    vocab, word, lens = numbered([t.encode() for t in texts])
    held = vocab.to_pylist()
    assert [held[i] for i in word.tolist()] == [w for t in texts for w in t.encode().split()]
    assert lens.tolist() == [len(t.encode().split()) for t in texts]
    assert numbered([])[2].tolist() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    got = without_repeats(frame(spark, rows)).select("doc_id", "text", "n_words", "n_removed", "kept", "score").collect()
    want = sorted((repr(i), repr(t), *b) for (i, t), b in zip(rows, brute(rows), strict=True))
    # repeated rows in different blocks: either may be the first, so counts are compared as a set of rows
    assert sorted((repr(r.doc_id), repr(r.text), r.n_words, r.n_removed, bytes(r.kept)) for r in got) == want
    assert all(r.score == 1.0 for r in got)


def block(seed: int = 3) -> tuple:
    rows = sorted((i, (t or "").encode()) for i, t in corpus(seed) if i is not None)
    return np.array([i for i, _ in rows], np.int64), [t for _, t in rows], None


def test_the_first_least_phrase_stands_for_a_window():
    w = Windows(block())
    assert w.stands.tolist() == [a + int(np.argmin(w.phrases[a : a + WINDOW - PHRASE + 1])) for a in w.at.tolist()]
    assert listed(w.vocab) == w.vocab.to_pylist() and listed(w.vocab[2:5]) == w.vocab[2:5].to_pylist() and listed(pa.array([], pa.large_binary())) == []
    for texts in ([], [b""], [b"a b c"], [b"x " * 19], [b"x " * 20]):
        assert len(Windows((np.arange(len(texts)), texts, None)).stands) == len(Windows((np.arange(len(texts)), texts, None)).at)


def test_hashes_at_places_are_those_of_all():
    h = Windows(block()).words
    for at in (np.arange(0, len(h) - WINDOW, 50), np.arange(len(h) - WINDOW + 1), np.empty(0, np.int64)):
        assert np.array_equal(rolling(h, WINDOW, at=at), rolling(h, WINDOW)[at])


def test_automata_read_only_stretches_that_recur():
    """The same windows are settled as by reading all, and documents without a window that recurs are not read."""
    ids, texts, _ = b = block()
    w = Windows(b)
    _, of_window, many, _ = phrases_of(w, 1)
    passage = max((t for t in texts if texts.count(t) > 1), key=len).split()
    holder = min(int(i) for i, t in zip(ids, texts, strict=True) if t.split() == passage)
    machine = Automata([(b" ".join(passage[:25]), holder, 0)])
    got = machine.settled(w, texts, many[of_window])
    assert got.any() and np.array_equal(got, machine.settled(w, texts))

    class Text(bytes):
        reads = 0

        def split(self, *a):
            Text.reads += 1
            return super().split(*a)

    machine.settled(w, [Text(t) for t in texts], many[of_window])
    assert Text.reads == len(set(w.doc[w.at[many[of_window]]].tolist())) < len(texts)


def test_blocks_that_speak_for_nothing_are_not_opened(monkeypatch):
    """Looking for passages reads the answers first; only a block that was told to speak is unpacked."""
    monkeypatch.setattr(phrase_automata, "unsqueeze", lambda _: pytest.fail("a block was opened"))
    monkeypatch.setattr(phrase_automata, "opened", lambda _: {0: (np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))})
    class Emitted(Exception):
        pass

    def emitted(_, emit, *a):
        raise Emitted(list(emit([(0, b"", None)])))

    monkeypatch.setattr(phrase_automata, "map_rows", emitted)
    with pytest.raises(Emitted) as e:
        phrase_automata.confirmed(None, 1)
    assert e.value.args == ([],)


def test_no_rows_and_no_windows(spark):
    docs = frame(spark, corpus())
    assert without_repeats(docs.limit(0)).count() == 0
    few = without_repeats(docs.where("length(text) < 30")).collect()
    assert few and all(r.n_removed == 0 for r in few)


def test_query(spark):
    from trellis.llm.phrase_automata import op7

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, g, hashlib.sha256(k).hexdigest()) for r, (n, g, k) in zip(docs, brute([tuple(r) for r in docs]), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7(spark, d).collect()} == want


def test_hashes_of_long_blocks_take_little_memory_besides():
    import tracemalloc

    h = np.random.default_rng(1).integers(0, 1 << 63, 400_000).astype(np.uint64)
    w = Windows.__new__(Windows)
    w.words, w.at = h, np.arange(len(h) - WINDOW + 1)
    at = w.at[::3].copy()
    w.phrases  # noqa: B018  made before
    for fn, size in ((lambda: rolling(h, WINDOW), h.nbytes), (lambda: rolling(h, WINDOW, at=at), at.nbytes), (lambda: w.stands, 2 * h.nbytes)):
        tracemalloc.start()
        fn()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.2 * size + (2 << 20), (peak, size)


def test_steps_don_t_show_in_hashes_and_standing_phrases(monkeypatch):
    r = np.random.default_rng(2)
    texts = [b" ".join(b"%d" % x for x in r.integers(0, 30, n)) for n in (3, 500, 19, 20, 21, 700)]
    w = Windows((np.arange(len(texts)), texts, None))
    want = [min(range(a, a + WINDOW - PHRASE + 1), key=lambda i: (int(w.phrases[i]), i)) for a in w.at.tolist()]
    monkeypatch.setattr(phrase_automata, "STEP", 37)
    again = Windows((np.arange(len(texts)), texts, None))
    assert again.stands.tolist() == w.stands.tolist() == want
    chosen = np.arange(len(w.at)) % 4 == 1
    for x in (chosen, ~chosen):
        assert all((a == b).all() for a, b in zip(w.hashes(x), again.hashes(x), strict=True))
