"""The contract of section files, and tags from a ledger of replies."""

from __future__ import annotations

import pytest
from lectern.operators import enrich
from lectern.sources import files
from lectern.sources.workspace import workspace
from pyspark.sql import functions as F

LINES = [
    '{"file_path": "a", "page_number": 1, "text": "x", "more": [1]}', '{"file_path": "a", "page_number": "2", "text": ""}', '{"file_path": "a", "page_number": null, "text": "y"}',
    '{"file_path": "a", "page_number": 1.5x', '{"file_path": "a", "page_number": "one", "text": "x"}', '{"file_path": null, "text": "x"}', '{"file_path": "b"}', '{"file_path": "b", "page_number": -3, "text": "x"}',
    "[1]", "  ",
]


def test_json_records_that_break_the_contract_go_to_quarantine(spark):
    path, bad = workspace(spark, "lines"), workspace(spark, "bad")
    spark.createDataFrame([(x,) for x in LINES], "value string").write.text(path)
    good = files.section_table(spark, path, "json", bad)
    assert sorted((r["file_path"], r["page_number"], r["text"]) for r in good.where("page_number is not null").collect()) == [("a", 1, "x"), ("a", 2, "")]
    assert good.schema.names == files.SECTIONS.names and good.count() == 3
    got = {r["record"]: r["reason"] for r in spark.read.parquet(bad).collect()}
    assert got == {LINES[3]: "malformed", LINES[4]: "malformed", LINES[5]: "no file path", LINES[6]: "no text", LINES[7]: "bad page number", LINES[8]: "malformed"}
    with pytest.raises(ValueError, match="no sections"):
        files.section_table(spark, path, "json")


def test_parquet_without_some_columns_and_without_rows(spark):
    path = workspace(spark, "p")
    spark.createDataFrame([("a", "t", 7)], "file_path string, text string, record int").withColumnRenamed("record", "extra").write.parquet(path)
    assert files.section_table(spark, path).collect()[0].asDict() == {"file_path": "a", "file_name": None, "file_type": None, "page_number": None, "section": None, "text": "t"}
    empty = workspace(spark, "p")
    spark.createDataFrame([], files.SECTIONS).write.parquet(empty)
    assert files.section_table(spark, empty).count() == 0


CHUNK = "doc_id long, file_name string, page_number int, section string, topic string, subtopic string, concept_type string, difficulty string, keywords string"


def test_reruns_change_nothing_and_failed_ids_are_asked_again(spark):
    bare = (None,) * 5
    chunks = spark.createDataFrame([(1, "f", 1, "s", *bare), (2, "f", 1, "s", *bare), (3, "f", 1, None, *bare), (4, "g", 1, "s", "Kept", "x", "other", "easy", ""), (5, "g", 1, "s", *bare)], CHUNK)
    rows = [(1, 1, "bad"), (1, 2, 'ok {"topic": "RAW"}'), (1, 3, '{"topic": "late"}'), (2, 1, None), (3, 1, "{"), (3, 2, ""), (3, 3, "x"), (3, 4, '{"topic": "too late"}'), (4, 1, '{"topic": "not taken"}')]
    replies = spark.createDataFrame(rows, "doc_id long, attempt int, raw string")
    topics = spark.createDataFrame([("raw", "Name"), ("Raw", "Name")], "raw string, canonical string")
    once = enrich.enrich_chunks(chunks, replies, topics)
    got = {r["doc_id"]: r["topic"] for r in once.collect()}
    assert got == {1: "Name", 2: None, 3: "Name", 4: "Kept", 5: None}  # 3 is Unknown, and takes its page's topic
    assert once.columns == chunks.columns
    again = enrich.enrich_chunks(once, replies, topics)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    assert sorted(tuple(r) for r in enrich.open_requests(once, replies).collect()) == [(2, 2), (5, 1)]
    more = replies.unionByName(spark.createDataFrame([(2, 2, '{"topic": "raw", "difficulty": " HARD "}')], replies.schema))
    r = enrich.enrich_chunks(once, more, topics).where("doc_id = 2").first()
    assert (r["topic"], r["difficulty"]) == ("Name", "hard")


def test_ledger_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, attempt int, raw string")
    topics = spark.createDataFrame([], "raw string, canonical string")
    assert enrich.enrich_chunks(spark.createDataFrame([], CHUNK), none, topics).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], CHUNK)
    assert enrich.enrich_chunks(one, none, topics).where(F.col("topic").isNull()).count() == 1
