import random
import zlib

from tests.llm.helpers import corpus, frame
from trellis.llm import toxicity as m


def read(g, text):
    return g.read(text.split())[0]


def test_grammar_composes_insult_target_negation_and_report():
    g = m.Grammar({"vile": 1.0, "scum*": 2.0, "meh" + m.TWICE: 0.5})
    assert read(g, "you vile thing") == "insult/target"
    assert read(g, "a scumbag vile") == "insults/plain"
    assert read(g, "you are not vile") == "insult/negated"
    assert read(g, "he said you vile") == "insult/reported"
    assert read(g, "you vile thing he said") == "insult/target"  # only what follows is reported
    assert read(g, "you vile thing he said scumbag") == "insult/target"
    assert read(g, "i will kill you vile") == "both/target"
    assert read(g, "not vile scumbag meh") == "insults/negated"
    assert read(g, "i do not want to find you") == "threat/target"
    assert read(g, "never hurt you") == "threat/negated"
    assert read(g, "not meh") == "faint/negated"
    assert read(g, "all is fine") is None
    assert g.read("you vile scumbag not vile".split())[1] == 3.0  # weights of live ones
    assert g.features("").sum() == 0 and g.features("Vile! You vile.").sum() > 0


def apart(lexicon, words):
    """The five jobs done one after another over the whole clause, without states."""
    terms = [m.terms_of(w) for w in words]
    fixed = m.NEGATION | m.REPORT
    insult = [max((lexicon.get(t, 0) for t in x), default=0) * (w not in fixed) for w, x in zip(words, terms, strict=True)]
    faint = [not i and w not in fixed and any(t + m.TWICE in lexicon for t in x) for i, w, x in zip(insult, words, terms, strict=True)]
    threat = [any(tuple(words[max(0, i + 1 - len(p)) : i + 1]) == p for p in m.THREATS) for i in range(len(words))]
    near = [any(words[j] in m.NEGATION for j in range(max(0, i - m.NEGATED_WORDS), i)) and w not in m.NEGATION for i, w in enumerate(words)]
    after = [any(x in m.REPORT for x in words[:i]) for i in range(len(words))]
    target = any(w in m.TARGETS for w in words)
    for how in ("live", "negated", "reported"):
        at = [i for i in range(len(words)) if (insult[i] or faint[i] or threat[i]) and ("reported" if after[i] else "negated" if near[i] else "live") == how]
        if at:
            strong, some, danger = sum(insult[i] > 0 for i in at), sum(faint[i] for i in at), any(threat[i] for i in at)
            kind = "both" if strong and danger else "threat" if danger else "insult" if strong == 1 else "insults" if strong else "faint"
            live = how == "live"
            return f"{kind}/{('target' if target else 'plain') if live else how}", sum(insult[i] for i in at) * live, some * live
    return None, 0, 0


def test_composed_machine_against_the_five_apart():
    r = random.Random(6)
    lexicon = {"vile": 1.5, "scum*": 2.0, "meh" + m.TWICE: 0.5, "dolt": 3.25}
    pool = ["vile", "scumbag", "meh", "dolt", "not", "never", "said", "you", "he", "a", "thing", *"i will kill you find hurt hope die ich bring dich um te voy a matar".split()]
    g, seen = m.Grammar(lexicon), set()
    for _ in range(20000):
        words = [r.choice(pool) for _ in range(r.randint(0, 12))]
        got = g.read(words)
        assert got == apart(lexicon, words), words
        seen.add(got[0])
    assert len(seen) >= len(m.CLASSES)
    assert len(g.rest.arcs) < 5000


def test_a_long_text_is_read_whole():
    g = m.Grammar({"vile": 1.0})
    text = "all is well here. " * 30_000 + "you vile thing!" + " fine, and so on" * 30_000
    assert g.features(text)[m.AT["insult/target"]] > 0


def test_equal_texts_with_labels_at_odds_are_learned_from_as_toxic(spark):
    rows = [(i, "you grolk number one" if i % 2 else f"a fine day {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 2 == 1 and i != 1)) for i in range(40)], "doc_id long, toxic int")
    lexicon, _ = m.fit(frame(spark, [*rows, *((100 + k, f"you grolk {k}") for k in range(8))]), labels.union(spark.createDataFrame([(100 + k, 1) for k in range(8)], labels.schema)), lambda i: i >= 0)
    assert any(t.startswith("grol") for t in lexicon)


def planted(spark):
    rows = [(i, f"{t or ''} " + ("you are a grolk. such a vexnar" if i is not None and i % 5 == 0 else "a fine day")) for i, t in corpus(3, 200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows if i is not None] + [(None, 1, 1), (999, 0, None)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_learns_words_and_leaves_clean_texts_alone(spark):
    rows, labels = planted(spark)
    rows += [(500, None), (501, ""), (502, "grolk")]
    out = m.toxicity(frame(spark, rows), labels, "score").collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id is None or r.doc_id < 500:
            assert (r.score >= m.THRESHOLD) == (r.doc_id is not None and r.doc_id % 5 == 0), r
    assert {r.score for r in out if r.doc_id in (500, 501)}.__len__() == 1
    assert next(r.score for r in out if r.doc_id == 502) > next(r.score for r in out if r.doc_id == 501)


def test_empty_tables_and_no_toxic_example(spark):
    rows, labels = planted(spark)
    docs = frame(spark, rows)
    assert m.toxicity(docs.limit(0), labels).count() == 0
    scores = {r.toxic_score for r in m.toxicity(docs, labels.where("toxic = 0")).collect()}
    assert len(scores) == 1 and max(scores) < m.THRESHOLD
    assert m.toxicity(docs, labels.limit(0)).where(f"toxic_score >= {m.THRESHOLD}").count() == 0


def test_query_on_rows_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in m.op3(spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    held = [(out[x.doc_id].predicted, x.toxic) for x in spark.read.parquet(f"{d}/labels.parquet").collect() if x.doc_id in out and out[x.doc_id].held_out]
    hit = sum(p and t for p, t in held)
    precision, recall = hit / max(1, sum(p for p, _ in held)), hit / max(1, sum(t for _, t in held))
    assert precision > 0.9 and recall > 0.9, (precision, recall)


def test_a_stretch_of_text_is_looked_at_once():
    g = m.Grammar({"vile": 1.0, "scum*": 2.0})
    asked, letter = [], g.insults.letter
    g.insults.letter = lambda w: asked.append(w) or letter(w)
    assert g.features("all is well here, and so on. " * 500).sum() == 0
    assert len(asked) <= 7  # not each of the 3,500 words
    assert g.features("all is well here, and so on. " * 500 + "you vile thing")[m.AT["insult/target"]] > 0
    assert len(asked) <= 7 + 10  # of the clauses, only that with a match is read


def test_skipping_clauses_changes_no_feature():
    r, seen = random.Random(8), 0
    lexicon = {"vile": 1.5, "scum*": 2.0, "meh" + m.TWICE: 0.5, "scum*" + m.TWICE: 1.0, "été": 1.0}
    pool = ["Vile", "scumbag", "meh", "mehr", "ÉTÉ", "not", "said", "you", "a vile", "foo-vile", "l'été", "thing,", *"i'll will kill you find hurt die ich bring dich um te voy a matar x 12 --".split()]
    for _ in range(3000):
        text = "".join(r.choice(pool) + r.choice([" ", " ", "  ", ". ", "\n", "; ", ", ", "!"]) for _ in range(r.randint(0, 25)))
        g, want, insults, faints = m.Grammar(lexicon), [0] * len(m.CLASSES), 0.0, 0
        for c in m.CLAUSE.split(text.lower()):
            k, n, faint = apart(lexicon, m.WORD.findall(c))
            if k:
                want[m.AT[k]] += 1
            insults, faints = insults + n, faints + faint
        got = g.features(text)
        assert (abs(m.np.expm1(got[: len(want)]) - want) < 1e-9).all() and abs(m.np.expm1(got[len(want)]) - insults) < 1e-9, text
        assert got[-2] == (faints >= 2) and got[-1] == (faints >= 3)
        seen += any(want)
    assert 500 < seen < 3000


def test_learning_counts_only_terms_of_toxic_texts(spark, monkeypatch):
    rows, labels = planted(spark)
    got, summed = [], m.summed
    monkeypatch.setattr(m, "summed", lambda *a: got.append(summed(*a)) or got[-1])
    m.fit(frame(spark, rows), labels, lambda i: i >= 0)
    toxic, others = got
    assert all(n >= m.AT_LEAST for n in toxic.values()) and set(others) <= set(toxic) and "grolk" in toxic
    texts = {i: t for i, t in rows if i is not None and i % 5}
    assert others["fine"] <= len(set(texts.values())) if "fine" in toxic else "fine" not in others
