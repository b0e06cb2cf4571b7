"""Every corpus query beside its checking SQL, where it has one, on the smallest tables; those without run and are tested elsewhere."""

from __future__ import annotations

import pytest
from compare import compare, duck_over

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
#: Tested against brute force or on fixtures in this folder, since SQL cannot express them.
NO_SQL = {"op2_url_filter", "op3_ngram_jaccard_join", "op4_line_dedup", "op7_license_scan", "op9_html_text", "op11_simhash", "op13_token_alignment", "pipeline"}


@pytest.fixture(scope="module")
def duck():
    return duck_over(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.CORPUS_QUERIES))
def test_query(spark, duck, name):
    got, _, ok, diff = compare(spark, duck, name, entry.CORPUS_QUERIES, entry.CORPUS_ORACLES, FOLDER)
    assert ok and got, diff


def test_queries_without_sql_are_known():
    assert set(entry.CORPUS_QUERIES) - set(entry.CORPUS_ORACLES) == NO_SQL
