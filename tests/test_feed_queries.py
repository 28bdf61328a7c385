"""Queries over the feed parser against their SQL, on documents without a title."""

import duckdb
import pytest

from newsloom import queries as Q

# null, empty and blank texts, one with an ampersand, one of more than twelve words
TEXTS = [None, "", " \n\t\r", "​﻿", "\xa0\xa0", "one", "\xa0 a  b\n", "A & B", "un deux trois quatre cinq six sept huit neuf dix onze douze treize"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS * 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{sf}/documents.parquet")
    return sf


def told(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    got = Q.QUERIES[name](spark, sf)
    want = con.execute(Q.SQL[name])
    columns = [c[0] for c in want.description]
    return columns, sorted(want.fetchall(), key=repr), got.columns, sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("name", ["parsed_feed_items", "feed_variants", "feed_articles"])
def test_documents_without_a_title(spark, tables, name):
    columns, want, named, got = told(spark, tables, name)
    assert named == columns and len(got) == len(TEXTS) * 6
    assert got == want


def test_a_document_without_a_key_has_no_link(spark, tmp_path):
    spark.createDataFrame([(None, "some words", "en", "s"), (1, "", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    _, want, _, got = told(spark, tmp_path, "parsed_feed_items")
    assert got == want == [(1, 1, "", "https://x.example/1"), (None, 1, "some words", None)]
