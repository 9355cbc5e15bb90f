"""Questions from replies, one case for each way of reading, worked out by hand."""

from __future__ import annotations

import pytest
from lectern.operators.enrich import parse_questions

E = "Error"
CASES = [
    ('Sure {"question": " Why\nso? ", "reference_answer": "x"} ok', "Why so?", "x", "json"),
    ('{"question": "Q ```python\na = {}\n``` R ```b```", "reference_answer": "see ```c\nd```"}', "Q ```\na = {}\n``` R ```\n\n```", "see", "json"),
    ('{"question": "Q", "reference_answer": "", "why": "one two three four five six", "n": 7}', "Q", "one two three four five six", "json"),
    ('```json\n{"question": "Q", "reference_answer": "A"}\n```', "Q", "A", "json"),
    ('{"question": "say \\"x\\" {", "reference_answer": "A"}', 'say "x" {', "A", "json"),
    ('{"question": 5, "reference_answer": "A"}', "", "A", "json"),
    ('{"question": """Q""", "reference_answer": "A"}', "Q", "A", "json"),
    ('{"question": "Q" "reference_answer": "A"}', "Q", "A", "fields"),
    ('{"question": "Q", "reference_answer": "A"} and } more', "Q", "A", "fields"),
    ('{"question": "Q ```c\nx;\n```", "reference_answer": "A",, }', "Q ```\nx;\n```", "A", "fields"),
    ('{"question": "Q", "reference_answer": "A ```x\ny``` B', "Q", "A  B", "pattern"),
    ('"question": Q ```c\nx;\n``` "reference_answer": "A" }', "```\nx;\n```\nQ ```c\nx;\n```", "A", "pattern"),
    ("Well.\n What is it? \nNo.", "What is it?", E, "line"),
    ("```\nx\n```\nWhat?", "```\nx\n```\nWhat?", E, "line"),
    ("no", E, E, "none"), ("", E, E, "none"), (None, E, E, "none"), ("{}", E, E, "none"),
]


def test_each_way_of_reading(spark):
    rows = [(i, c[0], 1) for i, c in enumerate(CASES)]
    got = parse_questions(spark.createDataFrame(rows, "id int, raw string, path int")).orderBy("id").collect()
    assert [(r["question"], r["reference_answer"], r["parse_path"]) for r in got] == [c[1:] for c in CASES]
    assert [r["path"] for r in got] == [1] * len(CASES)


def test_options_and_answers_of_choice_questions(spark):
    raw = '{"question": "Q", "reference_answer": "A", "options": {"a)": "x", "b)": 3}, "correct_answer": "a)"}'
    r = parse_questions(spark.createDataFrame([(raw,)], "raw string")).first()
    assert r["options"] == {"a)": "x", "b)": "3"} and r["correct_answer"] == "a)"


@pytest.mark.parametrize("body", ["a\\n" * 100_000, "x" * 500_000, "\n" * 100_000 + "y"])
def test_long_replies(spark, body):
    raw = '{"question": "Q' + body + '", "reference_answer": "A"}'
    r = parse_questions(spark.createDataFrame([(raw,), (raw[:-1],), (body,)], "raw string")).collect()
    assert [x["parse_path"] for x in r] == ["json", "pattern", "none"] and r[0]["reference_answer"] == "A"


def test_no_replies(spark):
    assert parse_questions(spark.createDataFrame([], "raw string")).count() == 0
