"""Nulls in any column, clashing names and empty tables for the queries, which read whole tables from a folder."""

import pytest

from trellis.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, node long, block long, spots string"
LABELS = "doc_id long, quality int, toxic int, score string"
PAGES = "page_id long, url string, html string, host string, good int"
ROWS = [(None, None, None, None, None, None, None, None, None, None), (1, None, "en", None, 5, 1.0, 1, 1, 1, "x"), (1, "", None, "s", 0, None, 2, 2, 2, "y"), (2, "the cat sat on a mat " * 40, "en", "s", None, None, None, None, None, None), (2, "the cat sat on a mat " * 40, "en", "s", 1, None, None, None, None, None), (None, "the cat", "en", "s", 1, 1.0, 1, 1, 1, "z"), (3, " \n ", "", "", 3, 1.0, 1, 1, 1, "z")]
NAMES = sorted(queries.queries())


def write(spark, folder, docs, labels, pages):
    for name, rows, ddl in (("documents", docs, DOCS), ("labels", labels, LABELS), ("pages", pages, PAGES)):
        spark.createDataFrame(rows, ddl).repartition(2).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    write(spark, odd, ROWS, [(None, None, None, None), (1, 1, None, "a"), (2, None, 1, "b"), (2, 0, 0, "c")], [(None, None, None, None, None), (1, None, "x", "h", 0), (2, "http://a.net/", None, None, None), (2, "http://a.net/", None, None, None)])
    write(spark, empty, [], [], [])
    return odd, empty


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_each_give_their_own(spark, folders, name):
    got = queries.queries()[name](spark, folders[0]).collect()
    wanted = {"op1_host_reputation": 4, "pipeline": None}.get(name, len(ROWS))
    assert len(got) == wanted if wanted else got


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, folders, name):
    assert queries.queries()[name](spark, folders[1]).collect() == []
