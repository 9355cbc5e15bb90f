"""Semantic chunks, text tables, choice questions and grading of long answers."""

from __future__ import annotations

import time

import pytest
from lectern.operators import corpus, grading
from lectern.operators import reports as rp
from pyspark.sql import functions as F

SECTION = "file_name string, file_path string, page_number long, section string, text string"


def by_topic(rows):
    """Sentences of stars and of bread lie far apart."""
    return rows.withColumn("embedding", F.when(F.contains("text", F.lit("star")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))


def test_semantic_chunks_end_where_the_topic_shifts(spark):
    text = "A star is hot. Every star shines! Bread is baked. Is bread sweet? One more star."
    rows = [("f", "p/f", 1, "s", text), ("f", "p/f", 2, "s", "short"), ("f", "p/f", 3, "s", "  "), ("f", "p/f", 4, "s", "x" * 90), ("f", "p/f", 5, "s", None)]
    got = corpus.semantic_chunks(spark.createDataFrame(rows, SECTION), by_topic, size=40, overlap=8).collect()
    of = lambda page: [r["text"] for r in sorted(got, key=lambda r: r["chunk_index"]) if r["page_number"] == page]
    assert of(1) == ["A star is hot. Every star shines!", "Bread is baked. Is bread sweet?", "One more star."]
    assert of(2) == ["short"] and of(3) == [] and of(4) == ["x" * 90] and of(5) == []
    assert {r["total_chunks"] for r in got if r["page_number"] == 1} == {3}


def test_oversized_segments_are_packed_again(spark):
    text = " ".join(f"The star number {i} is bright." for i in range(30))
    got = corpus.semantic_chunks(spark.createDataFrame([("f", "p/f", 1, "s", text)], SECTION), by_topic, size=100, overlap=20).collect()
    plain = corpus.chunks(spark.createDataFrame([("f", "p/f", 1, "s", text)], SECTION), 100, 20).collect()
    assert sorted((r["chunk_index"], r["text"]) for r in got) == sorted((r["chunk_index"], r["text"]) for r in plain) and len(got) > 5


def test_semantic_chunks_with_the_default_vectors(spark):
    text = "Alpha beta gamma delta. Alpha beta gamma delta. Oven flour yeast water. Oven flour yeast water."
    got = corpus.semantic_chunks(spark.createDataFrame([("f", "p/f", 1, "s", text)], SECTION), size=60).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: r["chunk_index"])] == ["Alpha beta gamma delta. Alpha beta gamma delta.", "Oven flour yeast water. Oven flour yeast water."]


def test_corpus_build_normalises_and_deduplicates(spark):
    docs = [(1, "f", "p/f", "Títle\n\n-----\n\nBody one."), (2, "f", "p/f", "Títle\n\n-----\n\nBody one."), (3, "g", "p/g", None), (4, "h", "p/h", "")]
    got = corpus.corpus_build(spark.createDataFrame(docs, "doc_id long, file_name string, file_path string, text string")).collect()
    assert [(r["file_path"], r["text"]) for r in got] == [("p/f", "Title\n\n\nBody one.")]  # the rule between the blank lines goes


@pytest.mark.parametrize(("text", "want"), [
    ("Name  Age\nAnn  3\nBob  4  x", "[TABLE]\n| Name | Age |\n| --- | --- |\n| Ann | 3 |\n| Bob | 4 |"),
    ("1 2\n3 4\n5", "[TABLE]\n| Column 1 | Column 2 |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n| 5 |  |"),
    ("one line", "[TABLE]\none line"), ("", "[TABLE]\n"), ("a b c\nd e", "[TABLE]\n| a | b | c |\n| --- | --- | --- |\n| d | e |  |"),
])
def test_text_tables(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(corpus.regular_table(F.col("s"))).first()[0] == want


def test_choice_questions(spark):
    full = {"a)": "one two", "b)": "three four", "c)": "five six", "d)": "x"}
    rows = [
        ("what is it now", full, "b", True), ("what is it now", full, " A) ", True), ("what is it", full, "b", False), ("what is it now", full, "apple", False), ("what is it now", full, "one two", False),
        ("what is it now", full, "d)", False), ("what is it now", {**full, "d)": " "}, "a", False), ("what is it now", {"a)": "one two"}, "a", False), (None, full, "a", False), ("what is it now", None, "a", False), ("what is it now", full, None, False),
    ]
    got = spark.createDataFrame(rows, "q string, o map<string,string>, c string, want boolean").select(grading.valid_choice(F.col("q"), F.col("o"), F.col("c")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_the_gap_is_positive_where_the_system_scored_too_low(spark):
    rows = [(0.9, 0.5), (-1.0, 0.5), (0.2, 0.6)]
    got = rp.reviewed(spark.createDataFrame(rows, "judge_score double, system_score double"))
    assert [r["gap"] for r in got.collect()] == [pytest.approx(0.4), None, pytest.approx(-0.4)]
    audit = got.agg(*rp.audit(got)).first()
    assert audit["over_pct"] == audit["under_pct"] == 50


def test_long_answers_are_graded_in_linear_work(spark):
    long = " ".join(f"word{i % 7919} is not{i}." for i in range(20_000))
    rows = [(1, "q one two three", long, long[: len(long) // 2], "factual"), (2, "q", "The sky is blue. It is wide.", "the sky is blue", "factual"), (3, "q", "", "", "other"), (4, "q", None, None, None), (2, "q", "The sky is blue. It is wide.", "the sky is blue", "factual")]
    answers = spark.createDataFrame(rows, "id int, question string, reference string, answer string, question_type string")
    began = time.time()
    got = {r["id"]: r for r in grading.grade(answers).collect()}
    assert time.time() - began < 60 and set(got) == {1, 2, 3, 4} and grading.grade(answers).count() == 5
    assert got[1]["completeness"] >= 0 and got[1]["semantic"] > 0.7 and 0 < got[1]["keyword"] <= 1
    # the first sentence is said whole; of the second only "is", a cosine of 1 / sqrt(12), which has no credit
    assert got[2]["completeness"] == pytest.approx(0.5) and got[3]["semantic"] == 0


def test_sentence_vectors_of_a_model(spark):
    encode = lambda texts: [[1.0, 0.0] if "sky" in x else [0.0, 1.0] for x in texts]
    answers = spark.createDataFrame([(1, "The sky is blue. Bread is good.", "sky above")], "id int, reference string, answer string")
    assert grading.completeness(answers, encode).first()["completeness"] == 0.5


def test_paragraphs_keep_the_digits_of_their_place(spark):
    docs = spark.createDataFrame([(1, "0 first 0\n 1 second 11 \n\n2 third 2")], "doc_id long, text string")
    assert [r["text"] for r in corpus.paragraph_sections(docs, "\n").collect()] == ["0 first 0\n\n1 second 11\n\n2 third 2"]


def test_siblings_are_all_documents_of_a_source_and_place(spark, data):
    from lectern.plans.q_corpus import j3

    docs = [(r["doc_id"], r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source").collect()]
    want = sorted((a, b) for a, x in docs for b, y in docs if a != b and x == y and a % 50 == b % 50)
    assert want and sorted(map(tuple, j3(spark, data).collect())) == want


def test_words_are_counted_within_the_row(spark):
    rows = [("a", "Trees keep keys in order. Keys are kept.", "Trees keep their keys in order. Nodes hold keys"), ("b", "", "Heaps are no trees"), ("c", None, None), ("d", "heaps", "... the of")]
    df = spark.createDataFrame(rows, "q string, answer string, reference string")
    graded = grading.grade(df.select("*", F.lit("Why?").alias("question"), F.lit("factual").alias("question_type")))
    for plan in (grading.completeness(df), graded):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()  # neither words nor texts are shuffled
    got = {r["q"]: r for r in graded.collect()}
    # counts: answer trees 1 keep 1 keys 2 in 1 order 1 are 1 kept 1; reference trees keep their keys:2 in order nodes hold
    assert got["a"]["semantic"] == pytest.approx(8 / (10 * 11) ** 0.5)
    assert got["a"]["completeness"] == pytest.approx((1.0 + credit_of(2 / (10 * 3) ** 0.5)) / 2)
    assert [got[k]["semantic"] for k in "bcd"] == [0.0] * 3 and [got[k]["keyword"] for k in "bcd"] == [0.0] * 3
    assert sorted(r["pair"] for r in grading.coverage(df.withColumnRenamed("q", "pair")).collect()) == ["a", "b"]


def credit_of(s):
    return 1.0 if s >= 0.6 else 0.6 if s >= 0.45 else 0.2 if s >= 0.3 else 0.0


def test_tagger_finds_words_once(spark):
    from lectern.functions import hooks

    df = spark.createDataFrame([(1, "The trees, the TREES and heaps"), (2, "heaps about an ox"), (3, None), (4, "the and")], "doc_id long, text string")
    tagged = hooks.tagger(df)
    assert "regexp_replace" not in tagged._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["raw"] for r in tagged.collect()} == {1: '{"keywords":"heaps, trees"}', 2: '{"keywords":"heaps"}'}
