"""Reports of reviewed logs and the split of code from prose, on small cases."""

from __future__ import annotations

import pytest
from lectern.functions import text as t
from lectern.operators import review_report as rr
from pyspark.sql import functions as F

LOG = "student long, topic string, step int, difficulty string, question_type string, student_type string, system_score double, judge_score double, hop_depth int, q_clarity int, q_relevance int, q_difficulty_fit int, q_type_fit int, mastered boolean"
ROWS = [
    (1, "a", 1, "basic", "factual", "weak", 0.2, 0.6, 5, 5, 4, 3, 4, True), (1, "a", 2, "advanced", "evaluative", "weak", 0.5, -1.0, 0, None, None, None, None, False),
    (1, "b", 1, "basic", "factual", "weak", 0.8, 0.4, 3, 1, 1, 1, 1, True),
]


def test_report(spark):
    got = {(r["section"], r["key"], r["metric"]): round(r["value"], 6) for r in rr.review_report(spark.createDataFrame(ROWS, LOG)).collect()}
    assert got["quality all", "", "q_avg"] == round((4 + 0 + 1) / 3, 6) and got["quality difficulty", "advanced", "q_avg"] == 0
    assert got["audit all", "", "mean_gap"] == 0 and got["audit student_type", "weak", "over_pct"] == 50 == got["audit all", "", "under_pct"]
    assert got["multihop question_type", "factual", "deep_pct"] == 50 and ("multihop question_type", "evaluative", "deep_pct") not in got
    assert got["students", "weak", "mastered"] == 1 and got["students", "weak", "questions"] == 3 and got["students", "weak", "advanced_pct"] == round(100 / 3, 6)


def test_digest(spark):
    got = {(r["section"], r["key"], r["metric"]): round(r["value"], 6) for r in rr.session_digest(spark.createDataFrame(ROWS, LOG), top=1).collect()}
    third = round(100 / 3, 6)
    assert got == {
        ("all", "", "attempts"): 3, ("all", "", "mean"): 0.5, ("all", "", "topics"): 2, ("all", "", "mastered"): 1, ("difficulty", "basic", "pct"): round(200 / 3, 6), ("difficulty", "advanced", "pct"): third,
        ("question_type", "factual", "pct"): round(200 / 3, 6), ("question_type", "evaluative", "pct"): third, ("topic", "a", "attempts"): 2, ("topic", "a", "mean"): 0.35, ("topic", "a", "mastered"): 0,
    }


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], LOG)
    assert rr.session_digest(none).count() == 0
    assert rr.review_report(none).count() == 0


@pytest.mark.parametrize(("text", "code", "rest"), [
    ("Look:\n```python\nx = 1;\n```\nDone.", "x = 1;", "Look:\n\nDone."), ("a ```x``` b ```c\ny\n```", "\n\ny".strip(), "a  b"), ("Is it?\n  return 1\nint x = 2;\nno", "return 1\nint x = 2;", "Is it?\nno"),
    ("only ``` one fence;", "only ``` one fence;", ""), ("", "", ""), (None, None, None),
])
def test_code_and_prose_of_questions(spark, text, code, rest):
    c, p = t.code_and_prose(F.col("s"))
    assert tuple(spark.createDataFrame([(text,)], "s string").select(c, p).first()) == (code, rest)
