import pytest

from ledgerline.llm.substring_dedup import substring_dedup
from tests.llm import brute, fixtures

SCHEMA = "doc_id long, text string"


def test_words_against_brute_force(spark):
    rows = fixtures.corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute.substring_words(rows)


def test_words_sf(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()}
    assert got == brute.substring_words(rows)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a b c")], [(1, "w " * 40), (1, "w " * 40)]])
def test_words_odd_tables(spark, rows):
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
