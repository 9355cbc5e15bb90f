"""Hybrid retrieval without an index: the same results as with one, and words found as before."""

from __future__ import annotations

import string
from functools import partial

import pytest
from lectern.functions import text as t
from lectern.operators import keyword_index, retrieval, vector_index, word_scores
from lectern.plans import q_retrieval
from pyspark.sql import functions as F

DOCS = [(1, "a b b c"), (2, "B  b\tc d"), (3, ""), (4, None), (5, "e e e e"), (6, "c"), (7, "c"), (8, "x y")]
ASKED = [("q1", "b c"), ("q2", "b b e"), ("q3", "unknown"), ("q4", ""), ("q5", "c")]


def test_best_bm25_is_that_of_the_index(spark):
    docs, asked = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id string, query string")
    best = [F.desc(F.round("score", 9)), F.asc("doc_id")]
    want = retrieval.top_per_query(keyword_index.build_keyword_index(docs).bm25(asked), 3, best).select("query_id", "rank", "doc_id", "score").collect()
    got = word_scores.best_bm25(docs, asked, 3).select("query_id", "rank", "doc_id", "score").collect()
    assert [tuple(r)[:3] for r in sorted(got)] == [tuple(r)[:3] for r in sorted(want)] and {r["query_id"] for r in got} == {"q1", "q2", "q5"}
    assert [r["score"] for r in sorted(got)] == pytest.approx([r["score"] for r in sorted(want)], abs=1e-12)
    assert word_scores.best_bm25(docs.limit(0), asked, 3).count() == 0 == word_scores.best_bm25(docs, asked.limit(0), 3).count()


def test_hybrid_makes_no_index_and_finds_what_exact_ones_find(spark, data, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("an index was made")

    columns = ("query_id", "rank", "doc_id", "score")
    with monkeypatch.context() as m:
        m.setattr(vector_index, "build_index", refused)
        m.setattr(keyword_index, "build_keyword_index", refused)
        got = sorted(map(tuple, q_retrieval.c3(spark, data).select(*columns).collect()))
    monkeypatch.setattr(vector_index, "build_index", partial(vector_index.build_index, cells=1))  # a single cell misses nothing
    monkeypatch.setattr(retrieval, "BLOCK", 0)
    monkeypatch.setattr(word_scores, "BLOCK", 0)
    assert got == sorted(map(tuple, q_retrieval.c3(spark, data).select(*columns).collect()))


def test_preprocess_keeps_letters_digits_and_spaces(spark, data):
    made = [("".join(map(chr, range(1, 0x250))) + "İ \U0001f600 z",), ("",), (None,), (string.printable,)]
    rows = spark.createDataFrame(made, "text string").unionByName(spark.read.parquet(f"{data}/documents.parquet").select("text"))
    as_ranges = F.regexp_replace(F.lower("text"), r"[^a-z0-9 \t\n\r]", "")
    assert rows.where(~t.preprocess(F.col("text")).eqNullSafe(as_ranges)).count() == 0
