"""Queries of the whole review report and the digest of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mastery as m
from ..operators import review_report as rr
from ..registry import query, rounded
from .q_mastery import AL, MASTERED, RUN
from .views import attempts, named, topic_levels

QUALITY_AT = {"q_clarity": 1, "q_relevance": 2, "q_difficulty_fit": 3, "q_type_fit": 5}


def reviewed_log(s: SparkSession, d: str) -> DataFrame:
    """Attempts with their mastery, a judge's score (each twentieth kind has none), a depth and four quality scores."""
    a = named(m.mastered_after(m.replay(attempts(s, d)), topic_levels(s)))
    missing = F.col("k") % 20 == 0
    return a.select(
        "student", "topic", "step", "difficulty", "question_type", (F.col("student") % 3).alias("student_type"), F.col("score").alias("system_score"), "mastered",
        F.when(missing, -1.0).otherwise((F.col("k") % 101) / 100).alias("judge_score"), (F.col("k") % 6).alias("hop_depth"),
        *[F.when(~missing, F.floor(F.col("k") / n) % 5 + 1).alias(c) for c, n in QUALITY_AT.items()],
    )


_Q = ", ".join(f"CASE WHEN k % 20 = 0 THEN 0 ELSE (k // {n}) % 5 + 1 END AS {c}" for c, n in QUALITY_AT.items())
LOG = f"""{AL}, {RUN}, {MASTERED}, raw_log AS (SELECT student, topic, step, difficulty, question_type, student % 3 AS student_type, score AS system_score, mastered,
CASE WHEN k % 20 = 0 THEN NULL ELSE (k % 101) / 100::DOUBLE END AS judge, k % 6 AS hop_depth, {_Q} FROM mast),
log AS (SELECT *, judge - system_score AS gap, 1 - abs(judge - system_score) AS agreement, round((q_clarity + q_relevance + q_difficulty_fit + q_type_fit) / 4.0::DOUBLE, 2) AS q_avg FROM raw_log),
ends AS (SELECT student_type, topic, max_by(mastered, step) AS mastered FROM log GROUP BY student_type, student, topic)"""
_QUALITY = ("q_avg", *QUALITY_AT)
_AUDIT = {
    "n": "count(*)", "mean_judge": "avg(judge)", "mean_system": "avg(system_score)", "mean_gap": "avg(gap)", "mean_agreement": "avg(agreement)",
    "correlation": "CASE WHEN count(*) > 1 THEN corr(judge, system_score) END", "over_pct": "100 * avg((gap < -0.15)::INT)", "under_pct": "100 * avg((gap > 0.15)::INT)",
}
_HOPS = {"mean_depth": "avg(hop_depth)", "deep_pct": "100 * avg((hop_depth >= 4)::INT)"}
_EACH = {"questions": "count(*)", "mean_score": "avg(system_score)", "advanced_pct": "100 * avg((difficulty = 'advanced')::INT)", "evaluative_pct": "100 * avg((question_type = 'evaluative')::INT)"}


def _parts(section: str, key: str | None, metrics: dict[str, str], where: str = "true", table: str = "log") -> list[str]:
    by, group = (f"{key}::VARCHAR", f"GROUP BY {key}") if key else ("''", "")
    return [f"SELECT '{section}' AS section, {by} AS key, '{n}' AS metric, round(({x})::DOUBLE, 6) AS value FROM {table} WHERE {where} {group}" for n, x in metrics.items()]


_MEANS = {c: f"avg({c})" for c in _QUALITY}
REPORT = " UNION ALL ".join([
    *_parts("quality all", None, _MEANS), *_parts("quality difficulty", "difficulty", _MEANS), *_parts("quality question_type", "question_type", _MEANS),
    *_parts("audit all", None, _AUDIT, "judge IS NOT NULL"), *_parts("audit student_type", "student_type", _AUDIT, "judge IS NOT NULL"),
    *_parts("multihop all", None, _HOPS, "hop_depth > 0"), *_parts("multihop question_type", "question_type", _HOPS, "hop_depth > 0"),
    *_parts("students", "student_type", _EACH), *_parts("students", "student_type", {"mastered": "sum(mastered::INT)"}, table="ends"),
])


@query("c9_whole_report", f"{LOG} SELECT * FROM ({REPORT}) WHERE value IS NOT NULL")
def c9_whole(s: SparkSession, d: str) -> DataFrame:
    return rr.review_report(reviewed_log(s, d)).withColumn("value", rounded("value", 6))


DIGEST = """tops AS (SELECT student_type, topic, count(*) AS attempts, avg(system_score) AS mean, row_number() OVER (PARTITION BY student_type ORDER BY count(*) DESC, topic) AS place FROM log GROUP BY student_type, topic),
tot AS (SELECT student_type, count(*) AS n, avg(system_score) AS mean, count(DISTINCT topic) AS topics FROM log GROUP BY ALL), dn AS (SELECT student_type, topic, sum(mastered::INT) AS mastered FROM ends GROUP BY ALL),
dg AS (SELECT student_type, 'all' AS section, '' AS key, 'attempts' AS metric, n::DOUBLE AS value FROM tot UNION ALL SELECT student_type, 'all', '', 'mean', mean FROM tot UNION ALL SELECT student_type, 'all', '', 'topics', topics FROM tot
UNION ALL SELECT student_type, 'all', '', 'mastered', sum(mastered) FROM dn GROUP BY student_type
UNION ALL SELECT student_type, 'difficulty', difficulty, 'pct', 100.0 * count(*) / any_value(n) FROM log JOIN tot USING (student_type) GROUP BY student_type, difficulty
UNION ALL SELECT student_type, 'question_type', question_type, 'pct', 100.0 * count(*) / any_value(n) FROM log JOIN tot USING (student_type) GROUP BY student_type, question_type
UNION ALL SELECT student_type, 'topic', topic, 'attempts', attempts FROM tops WHERE place <= 3 UNION ALL SELECT student_type, 'topic', topic, 'mean', mean FROM tops WHERE place <= 3
UNION ALL SELECT student_type, 'topic', topic, 'mastered', mastered FROM tops JOIN dn USING (student_type, topic) WHERE place <= 3)"""


@query("a28_whole_digest", f"{LOG}, {DIGEST} SELECT student_type, section, key, metric, round(value, 6) AS value FROM dg")
def a28_whole(s: SparkSession, d: str) -> DataFrame:
    return rr.session_digest(reviewed_log(s, d), top=3).withColumn("value", rounded("value", 6))
