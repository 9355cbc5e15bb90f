"""Kept indexes against brute force, rebuilds and empty tables."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from lectern.operators import products, retrieval
from lectern.operators.keyword_index import build_keyword_index
from lectern.operators.lsh import approximate_pairs
from lectern.operators.vector_index import build_index
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def exact(vectors, queries, k: int) -> dict:
    rows = retrieval.top_per_query(retrieval.similarities(vectors, queries), k, [F.desc(F.round("score", 9)), F.asc("vec_id")]).collect()
    return {(r["query_id"], r["rank"]): r["vec_id"] for r in rows}


def test_vector_index_recall_and_exact_way(vectors, queries):
    index = build_index(vectors)
    assert index.rows.count() == vectors.count() and 1 <= index.probes < len(index.centres)
    want = exact(vectors, queries, 5)
    found = {(r["query_id"], r["vec_id"]) for r in index.search(queries, 5).collect()}
    assert len(found & {(q, v) for (q, _), v in want.items()}) >= 0.9 * len(want)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search_exact(queries, 5).collect()} == want
    fewer = index.search(queries, 5, probes=1)
    assert {r["query_id"] for r in fewer.collect()} <= {q for q, _ in want}


def test_vector_index_reads_only_probed_cells(vectors, queries):
    index = build_index(vectors)
    plan = index.search(queries.limit(1), 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_vector_index_of_ties_repeats_and_little(spark):
    schema = "vec_id long, embedding array<float>, cell int"
    empty = build_index(spark.createDataFrame([], schema))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vec array<float>")
    assert empty.search(asked, 3).count() == 0
    rows = [(i, [1.0, 0.0], 9) for i in (7, 3, 5, 3)] + [(9, [0.0, 1.0], 9), (10, None, 9)]
    for index in (build_index(spark.createDataFrame(rows, schema)), build_index(spark.createDataFrame(rows, schema), cells=1)):
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in index.search_exact(asked, 3).collect())
        assert got == [(1, 0, 3), (1, 1, 3), (1, 2, 5)]


def test_lsh_recall_at_the_registered_distance_and_queries(vectors, queries):
    pairs = approximate_pairs(vectors, vectors.where("vec_id % 100 = 0"), 1.2).select("query_id", "vec_id").collect()
    true = retrieval.similarities(vectors, queries).where(2 - 2 * F.col("score") <= 1.2**2 - 1e-6).select("query_id", "vec_id").collect()
    assert len({tuple(r) for r in pairs} & {tuple(r) for r in true}) >= 0.9 * len(true)


def test_lsh_pairs_do_not_go_through_a_join(spark, vectors):
    twice = vectors.unionByName(vectors.where("vec_id < 5")).unionByName(vectors.limit(1).withColumn("embedding", F.lit(None).cast("array<float>")))
    pairs = approximate_pairs(twice, vectors.where("vec_id % 100 = 0"), 1.2)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r[0], r[1], round(r[2], 9)) for r in pairs.collect())
    assert got == sorted((r[0], r[1], round(r[2], 9)) for r in approximate_pairs(vectors, vectors.where("vec_id % 100 = 0"), 1.2).collect())
    assert len(got) == len({g[:2] for g in got}) and all(r >= 1 - 1.2**2 / 2 for _, _, r in got)


def test_keyword_index_grows_to_what_a_rebuild_gives(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    whole = build_keyword_index(docs)
    parts = build_keyword_index(docs.where("doc_id % 3 = 0")).add(docs.where("doc_id % 3 = 1")).add(docs.where("doc_id % 3 <> 0"))
    again = parts.add(docs)  # comes a second time
    asked = spark.createDataFrame([("a", "the the license"), ("b", "no-such-word"), ("c", "")], "query_id string, query string")
    plain = {(r[0], r[1]): r[2] for r in retrieval.bm25(docs, asked).collect()}
    for index in (whole, parts, again):
        assert sorted(map(tuple, index.lengths.collect())) == sorted(map(tuple, whole.lengths.collect()))
        assert {r["term"]: (r["df"], round(r["idf"], 9)) for r in index.weights().collect()} == {r["term"]: (r["df"], round(r["idf"], 9)) for r in whole.weights().collect()}
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in index.bm25(asked).collect()}
        assert got.keys() == plain.keys() and all(np.isclose(got[x], plain[x]) for x in got)


def test_keyword_index_of_odd_rows(spark):
    rows = [(1, "b"), (1, "a b"), (2, None), (3, ""), (None, "b b")]
    index = build_keyword_index(spark.createDataFrame(rows, "doc_id long, text string"))
    assert index.lengths.count() == 4
    found = {r["doc_id"] for r in index.bm25(spark.createDataFrame([("q", "B")], "query_id string, query string")).collect()}
    assert found == {1, None}
    empty = build_keyword_index(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.bm25(spark.createDataFrame([("q", "b")], "query_id string, query string")).collect() == []


def test_chunks_of_a_topic_are_scored_once(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "t", "t/x"), (2, [0.0, 1.0], "u", "t/x"), (3, [1.0, 1.0], "v", None), (4, [1.0, 1.0], None, "w")], "doc_id long, embedding array<float>, topic string, subtopic string")
    asked = spark.createDataFrame([("q#0", [1.0, 0.0], "q", 0), ("r#0", [1.0, 0.0], "r", 0)], "query_id string, query_vec array<float>, base string, variant int")
    allowed = spark.createDataFrame([("q", "t"), ("q", "t/x"), ("q", "w"), ("r", "nothing")], "query_id string, allowed string")
    got = sorted((r["query_id"], r["doc_id"], r["score"]) for r in retrieval.within_topics(chunks, asked, allowed).collect())
    assert got == [("q#0", 1, 1.0), ("q#0", 2, 0.0), ("q#0", 4, 1.0)]


def test_products_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "query_id long, query_vec array<float>")
    plain = v.join(asked).select("query_id", "vec_id", retrieval.dot(F.col("embedding"), F.col("query_vec")).alias("score"))
    key = lambda df: sorted(str(tuple(r)) for r in df.select("query_id", "vec_id", "score").collect())
    assert key(products.similarities(v, asked)) == key(plain)
    order = [F.desc(F.round("score", 9)), F.asc("vec_id")]
    for k in (1, 3, 20):
        assert key(retrieval.top_per_query(products.best_similarities(v, asked, k), k, order)) == key(retrieval.top_per_query(plain, k, order))
    most = lambda df: sorted(map(str, df.groupBy("vec_id").agg(F.max("score")).collect()))
    assert most(products.highest_similarities(v, asked)) == most(plain)
    assert products.similarities(v, asked.limit(0)).count() == 0 == products.best_similarities(v.limit(0), asked, 3).count()


def test_products_are_cut_in_tasks_and_not_by_expressions(vectors, queries):
    plan = products.best_similarities(vectors, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "zip_with" not in plan and "Exchange" not in plan
    assert products.best_similarities(vectors.repartition(2), queries, 5).count() <= 2 * 5 * queries.count()


def test_rounding_of_halves():
    got = products.half_up(np.array([0.1234565, 0.12345649999999999, 0.123456499, -0.1234565, 0.0, 2.0]), 6)
    assert got.tolist() == [0.123457, 0.123457, 0.123456, -0.123457, 0.0, 2.0]


def test_tasks_of_the_keyword_index_follow_the_text(spark, data, monkeypatch):
    from lectern.operators import keyword_index

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(keyword_index, "TASK_CHARS", 50_000)
    index = build_keyword_index(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    assert len(spark.read.parquet(f"{index.path}/delivery-0/lengths").inputFiles()) > 0.8 * min(chars // 50_000, docs.count())


def test_vector_index_sends_numbers_and_not_lists(vectors, queries):
    index, seen = build_index(vectors, cells=8), []
    send = index.spark.sparkContext.broadcast
    class Spy:  # noqa: E301
        def broadcast(self, value):
            seen.append(value)
            return send(value)
    class Session:  # noqa: E301
        sparkContext, read = Spy(), index.spark.read
    replace(index, spark=Session())._searched(queries, 5, lambda ids, q: [np.arange(8)] * len(ids)).count()
    assert [type(x) for x in seen[0][2]] == [np.ndarray] * 2 and len(seen[0][2][0]) == 8 * queries.count()
