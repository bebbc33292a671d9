import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from tests.llm.helpers import corpus, frame
from tests.llm.test_phrase_automata import brute as without_repeats
from tests.llm.test_pii import brute as base_spans
from trellis.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic texts, near copies, passages in common and personal data."""
    d = str(tmp_path_factory.mktemp("data"))
    rows = [(i, t) for i, t in corpus(12, 90) if i is not None]
    rows += [(300 + i, f"you are a grolk and a vexnar number {i}. vile grolk you") for i in range(40)]
    rows += [(400 + i, f"write to user{i}@example.com, number {i * 37} about the garden of delights and so on") for i in range(5)]
    docs = frame(spark, rows).select(*COLUMNS)
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int(300 <= i < 340)) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df):
    return sorted((r.doc_id, r.text or "", r.lang, r.source) for r in df.collect())


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "pii", "best_fit_packing"]
    before, out = docs, None
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, before, folder)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{folder}/{name}")
        before = spark.read.parquet(f"{folder}/{name}")
    read = lambda n: spark.read.parquet(f"{folder}/{n}")
    clean = {i for i, *_ in rows_of(read("toxicity"))}
    assert clean == {r.doc_id for r in docs.collect() if not 300 <= r.doc_id < 340}
    kept = rows_of(read("simhash_near_dedup"))
    assert {i for i, *_ in kept} <= clean and len({t for _, t, *_ in kept}) == len(kept)
    repeats = {i: (n, g, k.decode()) for (i, *_), (n, g, k) in zip(kept, without_repeats([(i, t) for i, t, *_ in kept]), strict=True)}
    after = {i: t for i, t, *_ in rows_of(read("substring_dedup"))}
    assert set(after) == set(repeats)
    original = {i: t for i, t, *_ in kept}
    for i, (_, gone, words) in repeats.items():
        assert after[i] == (words if gone else original[i])
    assert any(g for _, g, _ in repeats.values())
    redacted = {i: t for i, t, *_ in rows_of(read("pii"))}
    assert set(redacted) == set(after) and all(not base_spans(t) for t in redacted.values())
    assert all(redacted[i] == t for i, t in after.items() if "@" not in t and not base_spans(t) and ":" not in t and "=" not in t)
    assert all(r.n_chars == len(r.text or "") for r in read("pii").collect())


def test_run_packs_what_is_left(spark, folder):
    got = c.run(spark, folder).collect()
    left = {r.doc_id for r in spark.read.parquet(f"{folder}/pii").collect()}
    assert {r.doc_id for r in got} == left
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 4096 for v in fill.values())


def test_stages_take_empty_tables_and_nulls(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (None, "text", None, None, None)], docs.schema)
    for name, stage in c.STAGES:
        assert stage(spark, nulls, folder).count() == (2 if name == "simhash_near_dedup" else 3), name


def test_columns_with_the_operators_own_names_stay(spark, folder):
    """Values of columns that are called like those of an operator come through all stages."""
    own = ("kept", "n_words", "n_removed", "score", "node", "id", "own 2", "__id", "toxic_score", "spans")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in own:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")))
    for name, stage in c_stages():
        docs = stage(spark, docs, folder)
        assert docs.columns[-len(own) :] == list(own), name
    rows = docs.collect()
    assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in own)


def c_stages():
    return c.STAGES[:-1]


def test_a_long_text_goes_through_all_stages(spark, tmp_path):
    d = str(tmp_path)
    long = " ".join(f"w{i % 9973}x{i}" for i in range(60_000)) + " write to me@example.org " + "you are fine " * 50
    rows = [(1, long), (2, long + " and more"), (3, "short text")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = c.run(spark, d).collect()
    assert {r.doc_id for r in got} == {1, 3} and sum(r.length for r in got if r.doc_id == 1) > 60_000


def test_heaps_are_given_back_before_each_stage(spark, monkeypatch):
    class Released(Exception):
        pass

    def released(_):
        raise Released

    monkeypatch.setattr(c, "heaps_released", released)
    for _, stage in c.STAGES:
        with pytest.raises(Released):
            stage(spark, None, "")


def test_executors_collect_garbage_when_told(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    counted = lambda: sum(b.getCollectionCount() for b in beans())
    assert common.executors(spark) == 0  # all on one machine
    monkeypatch.setattr(common, "executors", lambda _: 2)
    before = counted()
    common.heaps_released(spark)
    assert counted() >= before + 2
