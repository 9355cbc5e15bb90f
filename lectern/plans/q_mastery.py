"""Queries over attempts: windows, mastery, rewards, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import mastery as m
from ..operators import reports, trajectory
from ..registry import query, rounded
from .views import LEVELS, QUESTION_TYPES, attempts, named, prereqs, topic_levels, with_views

A = with_views("attempts")
AL = with_views("attempts", "levels")
ALP = with_views("attempts", "levels", "prereqs")
#: Running values after each attempt, for the checking engine.
RUN = """run AS (SELECT *, row_number() OVER t AS attempt, avg(score) OVER (t ROWS UNBOUNDED PRECEDING) AS running_mean,
  coalesce(avg(score) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous_mean, lag(score, 1, 0.0) OVER t AS previous_score,
  lag(d) OVER t AS previous_d, lag(q) OVER t AS previous_q, max(d) OVER (t ROWS UNBOUNDED PRECEDING) AS top_d, max(q) OVER (t ROWS UNBOUNDED PRECEDING) AS top_q,
  coalesce(max(d) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_d, coalesce(max(q) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_q
  FROM named WINDOW t AS (PARTITION BY student, topic ORDER BY step)),
 trended AS (SELECT *, CASE WHEN count(*) OVER r >= 2 THEN greatest(-1.0, least(1.0, regr_slope(score, attempt) OVER r)) ELSE 0.0 END AS trend
  FROM run WINDOW r AS (PARTITION BY student, topic ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
BASE = "CASE level WHEN 'basic' THEN 0.75 WHEN 'intermediate' THEN 0.65 ELSE 0.55 END::DOUBLE"
THRESHOLD = f"({BASE} + CASE d WHEN 0 THEN 0.10 WHEN 1 THEN 0.05 ELSE 0.0 END::DOUBLE + CASE q WHEN 0 THEN 0.05 WHEN 1 THEN 0.02 ELSE 0.0 END::DOUBLE)"
SUFF = "CASE level WHEN 'basic' THEN 0.55 WHEN 'intermediate' THEN 0.45 ELSE 0.35 END::DOUBLE"
STRICT = "CASE level WHEN 'basic' THEN 0.65 WHEN 'intermediate' THEN 0.55 ELSE 0.45 END::DOUBLE"
STATE = """state AS (SELECT student, topic, count(*) AS attempts, avg(score) AS mean, max_by(trend, step) AS trend, max(d) AS top_d, max(q) AS top_q FROM trended GROUP BY ALL)"""
COMBOS = f"""combos AS (SELECT student, topic, count(*) AS combos FROM (SELECT student, topic, d, q, avg(score) AS mean FROM named GROUP BY ALL) JOIN levels USING (topic) WHERE mean >= {THRESHOLD} - 1e-12 GROUP BY ALL)"""
_TESTS = " AND ".join(
    f"coalesce(avg(CASE WHEN d = {d} AND q = {q} THEN score END) OVER w >= {BASE} + {m.BY_DIFFICULTY[d]}::DOUBLE + {m.BY_QUESTION_TYPE[q]}::DOUBLE - 1e-12, false)" for d in range(3) for q in range(3)
)
MASTERED = f"""mast AS (SELECT *, attempt >= 3 AND trend >= 0 AND {_TESTS} AS mastered FROM trended JOIN levels USING (topic)
  WINDOW w AS (PARTITION BY student, topic ORDER BY step ROWS UNBOUNDED PRECEDING))"""
MET = """met AS (SELECT s.student, s.topic, bool_and(p.prereq IS NULL OR coalesce(u.understood, false)) AS met
  FROM (SELECT DISTINCT a.student, l.topic FROM state a, levels l) s LEFT JOIN prereqs p USING (topic) LEFT JOIN understood u ON u.student = s.student AND u.topic = p.prereq GROUP BY ALL)"""
UNDERSTOOD = f"understood AS (SELECT *, attempts >= 3 AND mean >= {SUFF} AS understood FROM state JOIN levels USING (topic))"


def r6(*names: str) -> list:
    return [rounded(n, 6).alias(n) for n in names]


def _replayed(s: SparkSession, d: str) -> DataFrame:
    return m.replay(attempts(s, d))


def _mastered(s: SparkSession, d: str) -> DataFrame:
    return m.mastered_after(_replayed(s, d), topic_levels(s))


@query("session_report", f"""{ALP}, st AS (SELECT student, topic, count(*) AS attempts, avg(score) AS mean FROM attempts GROUP BY ALL)
SELECT student, count(*) AS topics, sum(attempts)::BIGINT AS attempts, round(avg(mean), 6) AS mean_score, count(*) FILTER (mean < 0.5) AS weak_topics FROM st GROUP BY ALL""")  # fmt: skip
def session_report(s: SparkSession, d: str) -> DataFrame:
    st = attempts(s, d).groupBy("student", "topic").agg(F.count("*").alias("attempts"), m.exact_mean(F.col("score")).alias("mean"))
    return st.groupBy("student").agg(F.count("*").alias("topics"), F.sum("attempts").alias("attempts"), rounded(F.avg("mean"), 6).alias("mean_score"), F.count_if(F.col("mean") < 0.5).alias("weak_topics"))


@query("w1_running_mean", f"{A}, {RUN} SELECT student, step, topic, round(running_mean, 6) AS running_mean FROM run")
def w1(s: SparkSession, d: str) -> DataFrame:
    return _replayed(s, d).select("student", "step", "topic", *r6("running_mean"))


@query("w2_attempts_so_far", f"{A}, {RUN} SELECT student, step, topic, attempt, round(least(attempt / 50.0::DOUBLE, 1.0), 6) AS effort FROM run")
def w2(s: SparkSession, d: str) -> DataFrame:
    return _replayed(s, d).select("student", "step", "topic", "attempt", rounded(F.least(F.col("attempt") / m.FULL_ATTEMPTS, F.lit(1.0)), 6).alias("effort"))


@query("w3_trend", f"{A}, {RUN} SELECT student, step, topic, round(trend, 6) AS trend FROM trended")
def w3(s: SparkSession, d: str) -> DataFrame:
    return _replayed(s, d).select("student", "step", "topic", *r6("trend"))


@query("w4_improvement", f"{A}, {RUN} SELECT student, step, topic, round(score - previous_score, 6) AS over_last, round(score - previous_mean, 6) AS over_mean FROM run")
def w4(s: SparkSession, d: str) -> DataFrame:
    return _replayed(s, d).select("student", "step", "topic", rounded(F.col("score") - F.col("previous_score"), 6).alias("over_last"), rounded(F.col("score") - F.col("previous_mean"), 6).alias("over_mean"))


@query("w5_advancement", f"{A}, {RUN} SELECT student, step, topic, top_d, top_q, top_d > before_d OR top_q > before_q AS advanced FROM run")
def w5(s: SparkSession, d: str) -> DataFrame:
    return _replayed(s, d).select("student", "step", "topic", "top_d", "top_q", ((F.col("top_d") > F.col("before_d")) | (F.col("top_q") > F.col("before_q"))).alias("advanced"))


@query("w6_previous_levels", f"""{A}, {RUN} SELECT student, step, topic, CASE previous_d WHEN 0 THEN 0.2 WHEN 1 THEN 0.6 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS difficulty_code,
CASE previous_q WHEN 0 THEN 0.2 WHEN 1 THEN 0.6 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS type_code FROM run""")
def w6(s: SparkSession, d: str) -> DataFrame:
    return _replayed(s, d).select("student", "step", "topic", m.coded(F.col("previous_d")).alias("difficulty_code"), m.coded(F.col("previous_q")).alias("type_code"))


@query("w7_previous_topic", f"{A} SELECT student, step, topic, lag(topic) OVER (PARTITION BY student ORDER BY step) AS previous_topic FROM attempts")
def w7(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).select("student", "step", "topic", F.lag("topic").over(m.by_student()).alias("previous_topic"))


@query("w8_state_features", f"""{AL}, {RUN}, {MASTERED},
full_ AS (SELECT a.student, a.step, l.topic, a.topic AS now, m.running_mean, m.attempt, m.d, m.q, m.trend, m.mastered FROM attempts a CROSS JOIN levels l LEFT JOIN mast m ON m.student = a.student AND m.step = a.step AND m.topic = l.topic)
SELECT student, step, topic, round(coalesce(last_value(running_mean IGNORE NULLS) OVER w, 0), 6) AS mean, round(least(coalesce(last_value(attempt IGNORE NULLS) OVER w, 0) / 50.0::DOUBLE, 1.0), 6) AS effort,
CASE last_value(d IGNORE NULLS) OVER w WHEN 0 THEN 0.2 WHEN 1 THEN 0.6 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS difficulty_code, CASE last_value(q IGNORE NULLS) OVER w WHEN 0 THEN 0.2 WHEN 1 THEN 0.6 WHEN 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS type_code,
round(coalesce(last_value(trend IGNORE NULLS) OVER w, 0), 6) AS trend, coalesce(last_value(mastered IGNORE NULLS) OVER w, false)::INT::DOUBLE AS mastered,
(last_value(attempt IGNORE NULLS) OVER w IS NULL)::INT::DOUBLE AS neglected, (now = topic)::INT::DOUBLE AS current
FROM full_ WINDOW w AS (PARTITION BY student, topic ORDER BY step ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def w8(s: SparkSession, d: str) -> DataFrame:
    f = m.state_features(attempts(s, d), topic_levels(s))
    return f.select("student", "step", "topic", *r6("mean", "effort"), "difficulty_code", "type_code", *r6("trend"), "mastered", "neglected", "current")


@query("w9_first_mastered", f"""{AL}, {RUN}, {MASTERED} SELECT s.student, l.topic, coalesce(min(step) FILTER (mastered), -1) AS step
FROM (SELECT DISTINCT student FROM attempts) s CROSS JOIN levels l LEFT JOIN mast m ON m.student = s.student AND m.topic = l.topic GROUP BY ALL""")
def w9(s: SparkSession, d: str) -> DataFrame:
    return m.first_mastered(_mastered(s, d), attempts(s, d), topic_levels(s)).select("student", "topic", "step")


@query("w10_mastered_count", f"""{AL}, {RUN}, {MASTERED}, ch AS (SELECT student, step, mastered::INT - coalesce(lag(mastered::INT) OVER (PARTITION BY student, topic ORDER BY step), 0) AS c FROM mast)
SELECT student, step, sum(c) OVER (PARTITION BY student ORDER BY step)::BIGINT AS mastered_topics FROM ch""")
def w10(s: SparkSession, d: str) -> DataFrame:
    return m.mastered_count(_mastered(s, d))


@query("w11_recent_memory", f"""{A} SELECT student, step, array_to_string(list(k::VARCHAR) OVER (PARTITION BY student ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ',') AS recent_keys,
array_to_string(list(k::VARCHAR) OVER (PARTITION BY student, topic ORDER BY step ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ',') AS topic_keys FROM attempts""")
def w11(s: SparkSession, d: str) -> DataFrame:
    key = F.col("k").cast("string")
    held = lambda w, n: F.collect_list(key).over(w.rowsBetween(-n, -1))
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return attempts(s, d).select("student", "step", joined(held(m.by_student(), 10)).alias("recent_keys"), joined(held(m.by_topic(), 5)).alias("topic_keys"))


@query("w12_repeat_counter", f"{A} SELECT student, step, topic, d, q, row_number() OVER (PARTITION BY student, topic, d, q ORDER BY step) - 1 AS repeats FROM named")
def w12(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("student", "topic", "d", "q").orderBy("step")
    return attempts(s, d).select("student", "step", "topic", "d", "q", (F.row_number().over(w) - 1).alias("repeats"))


@query("w16_batches_of_answers", f"""{A} SELECT student, (step - 1) // 20 AS batch, count(*) AS answers, round(avg(score), 6) AS mean_score, count(*) = 20 AS full_batch FROM attempts GROUP BY ALL HAVING count(*) >= 2""")
def w16(s: SparkSession, d: str) -> DataFrame:
    return trajectory.batches(attempts(s, d)).select("student", "batch", "answers", *r6("mean_score"), "full_batch")


@query("w17_discounted_returns", f"""{A}, g AS (SELECT student, step, sum(score * pow(0.99, step)) OVER (PARTITION BY student ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.99, step) AS ret FROM attempts)
SELECT student, step, round(ret, 5) AS ret, round((ret - avg(ret) OVER p) / (coalesce(stddev_samp(ret) OVER p, 0) + 1e-8), 4) AS standardised FROM g WINDOW p AS (PARTITION BY student)""")
def w17(s: SparkSession, d: str) -> DataFrame:
    return trajectory.returns(attempts(s, d), F.col("score")).select("student", "step", rounded("ret", 5).alias("ret"), rounded("standardised", 4).alias("standardised"))


@query("w18_advantages", f"""{A}, {RUN}, e AS (SELECT student, step, score AS r, previous_mean AS v, step % 50 = 0 AS done, (step - 1) // 50 AS ep FROM run),
dl AS (SELECT *, r + 0.99 * coalesce(lead(v) OVER (PARTITION BY student, ep ORDER BY step), 0) - v AS delta, row_number() OVER (PARTITION BY student, ep ORDER BY step) AS i FROM e)
SELECT student, step, round(sum(delta * pow(0.891, i)) OVER (PARTITION BY student, ep ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.891, i), 5) AS advantage FROM dl""")
def w18(s: SparkSession, d: str) -> DataFrame:
    t = _replayed(s, d).select("student", "step", F.col("score").alias("reward"), F.col("previous_mean").alias("value"), (F.col("step") % 50 == 0).alias("done"))
    return trajectory.advantages(t).select("student", "step", rounded("advantage", 5).alias("advantage"))


@query("w19_smoothed_scores", f"""{A} SELECT student, step, round(m, 6) AS smoothed FROM (SELECT student, step, avg(score) OVER w AS m, count(*) OVER w AS n FROM attempts WINDOW w AS (PARTITION BY student ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE n = 50""")
def w19(s: SparkSession, d: str) -> DataFrame:
    return trajectory.smoothed(attempts(s, d), 50).select("student", "step", *r6("smoothed"))


@query("w20_recalibration", f"""{A}, b AS (SELECT topic, quantile_cont(score, 0.1) AS lo, quantile_cont(score, 0.9) AS hi FROM attempts GROUP BY ALL)
SELECT student, step, topic, round(greatest(0.0, least(1.0, (score - lo) / (hi - lo))), 6) AS stretched FROM attempts JOIN b USING (topic)""")
def w20(s: SparkSession, d: str) -> DataFrame:
    return reports.recalibrated(attempts(s, d), "topic").select("student", "step", "topic", *r6("stretched"))


@query("a14_topic_means", f"{A} SELECT student, topic, count(*) AS attempts, round(avg(score), 6) AS mean FROM attempts GROUP BY ALL")
def a14(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).groupBy("student", "topic").agg(F.count("*").alias("attempts"), rounded(F.avg("score"), 6).alias("mean"))


@query("a15_combination_means", f"{A} SELECT student, topic, d, q, round(avg(score), 6) AS mean, count(*) AS n FROM named GROUP BY ALL")
def a15(s: SparkSession, d: str) -> DataFrame:
    return m.combination_means(attempts(s, d)).select("student", "topic", "d", "q", *r6("mean"), "n")


@query("a16_mastery", f"{AL}, {RUN}, {STATE}, {COMBOS} SELECT student, topic, attempts, round(mean, 6) AS mean, round(trend, 6) AS trend, coalesce(combos, 0) AS combos, attempts >= 3 AND trend >= 0 AND coalesce(combos, 0) = 9 AS mastered FROM state LEFT JOIN combos USING (student, topic)")
def a16(s: SparkSession, d: str) -> DataFrame:
    return m.mastery(attempts(s, d), topic_levels(s)).select("student", "topic", "attempts", *r6("mean", "trend"), "combos", "mastered")


@query("a17_sufficiency", f"{AL}, {RUN}, {STATE} SELECT student, topic, attempts >= 3 AND mean >= {SUFF} AS understood, attempts >= 5 AND mean >= {STRICT} AND trend >= 0 AS understood_strict FROM state JOIN levels USING (topic)")
def a17(s: SparkSession, d: str) -> DataFrame:
    state = m.topic_state(attempts(s, d), by_step=True)
    strict = m.sufficient(state, topic_levels(s), strict=True).withColumnRenamed("understood", "understood_strict").drop("level")
    return m.sufficient(strict, topic_levels(s)).select("student", "topic", "understood", "understood_strict")


@query("a18_earned_levels", f"{A} SELECT student, topic, max(d) AS top_d, max(q) AS top_q FROM named GROUP BY ALL")
def a18(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).groupBy("student", "topic").agg(F.max("d").alias("top_d"), F.max("q").alias("top_q"))


@query("a19_weak_topics", f"""{ALP}, st AS (SELECT student, topic, count(*) AS attempts, avg(score) AS mean FROM attempts GROUP BY ALL), sp AS (SELECT DISTINCT a.student, l.topic FROM attempts a, levels l)
SELECT student, topic, coalesce(attempts, 0) AS attempts, round(mean, 6) AS mean, CASE WHEN mean < 0.5 THEN 'low' ELSE 'untried' END AS reason FROM sp LEFT JOIN st USING (student, topic)
WHERE mean < 0.5 OR (attempts IS NULL AND topic IN (SELECT topic FROM prereqs))""")
def a19(s: SparkSession, d: str) -> DataFrame:
    return m.weak_topics(attempts(s, d), topic_levels(s), prereqs(s)).select("student", "topic", "attempts", *r6("mean"), "reason")


@query("a20_session_summary", f"""{A} SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(question_type) = 0 THEN 'question_type' WHEN grouping(topic) = 0 THEN 'topic' ELSE 'all' END AS section,
coalesce(difficulty, question_type, topic, '') AS key, count(*) AS n, round(avg(score), 6) AS mean_score FROM named GROUP BY GROUPING SETS ((), (difficulty), (question_type), (topic))""")
def a20(s: SparkSession, d: str) -> DataFrame:
    return reports.by_sections(named(attempts(s, d)), ["difficulty", "question_type", "topic"], [F.count("*").alias("n"), rounded(F.avg("score"), 6).alias("mean_score")])


@query("a21_last_rows", f"""{A} SELECT student, topic, max(step) AS step, round(max_by(score, step), 6) AS last_score, round(max_by(CASE WHEN k % 20 <> 0 THEN score END, CASE WHEN k % 20 <> 0 THEN step END), 6) AS last_known FROM named GROUP BY ALL""")
def a21(s: SparkSession, d: str) -> DataFrame:
    a = attempts(s, d).withColumn("known", F.when(F.col("k") % 20 != 0, F.col("score")))
    return reports.last_rows(a, ["student", "topic"], "step", ["score"], ["known"]).select("student", "topic", "step", rounded("score", 6).alias("last_score"), rounded("known", 6).alias("last_known"))


@query("a22_log_report", f"""{ALP}, t AS (SELECT student, topic, step, coalesce(TRY_CAST(CASE WHEN k % 10 = 0 THEN 'n/a' ELSE score::VARCHAR END AS DOUBLE), 0.0) AS score, upper(trim(CASE WHEN k % 2 = 0 THEN ' true' ELSE 'False' END)) = 'TRUE' AS flag FROM attempts)
SELECT student, topic, round(max_by(score, step), 6) AS last_score, max_by(flag, step) AS last_flag, count(*) AS attempts, round(avg(score), 6) AS mean, avg(score) < 0.5 AS weak FROM t GROUP BY ALL""")
def a22(s: SparkSession, d: str) -> DataFrame:
    raw = attempts(s, d).select(
        "student", "topic", "step", F.when(F.col("k") % 10 == 0, "n/a").otherwise(F.col("score").cast("string")).alias("score"), F.when(F.col("k") % 2 == 0, " true").otherwise("False").alias("flag")
    )
    return reports.log_report(raw).select("student", "topic", *r6("last_score"), "last_flag", "attempts", *r6("mean"), "weak")


@query("a23_dashboard", f"""{AL}, {RUN}, {STATE}, {COMBOS}, f AS (SELECT *, attempts >= 3 AND trend >= 0 AND coalesce(combos, 0) = 9 AS mastered FROM state LEFT JOIN combos USING (student, topic))
SELECT student, round(avg(mean), 6) AS mean_score, count(*) FILTER (mastered) AS mastered, sum(attempts)::BIGINT AS attempts, round(100.0 * count(*) FILTER (mastered) / count(*), 6) AS mastered_pct,
count(*) FILTER (mean >= 0.75) AS strong, count(*) FILTER (mean >= 0.5 AND mean < 0.75) AS medium, count(*) FILTER (mean < 0.5) AS weak FROM f GROUP BY ALL""")
def a23(s: SparkSession, d: str) -> DataFrame:
    return reports.dashboard(m.mastery(attempts(s, d), topic_levels(s), by_step=True)).select("student", *r6("mean_score"), "mastered", "attempts", *r6("mastered_pct"), "strong", "medium", "weak")


@query("a29_cohort", f"""{AL}, {RUN}, {STATE}, {COMBOS}, f AS (SELECT *, attempts >= 3 AND trend >= 0 AND coalesce(combos, 0) = 9 AS mastered FROM state LEFT JOIN combos USING (student, topic)),
p AS (SELECT student, sum(mean * attempts) / sum(attempts) AS mean, count(*) FILTER (mastered) AS mastered FROM f GROUP BY ALL)
SELECT count(*) AS students, round(avg(mean), 6) AS mean_of_means, round(avg(mastered), 6) AS mastered_mean, round(stddev_pop(mastered), 6) AS mastered_std FROM p""")
def a29(s: SparkSession, d: str) -> DataFrame:
    return reports.cohort(m.mastery(attempts(s, d), topic_levels(s))).select("students", *r6("mean_of_means", "mastered_mean", "mastered_std"))


@query("a30_topic_type_means", f"""{AL}, st AS (SELECT student, topic, question_type, avg(score) AS mean FROM named GROUP BY ALL), sp AS (SELECT DISTINCT a.student, l.topic, t.question_type FROM attempts a, levels l, (SELECT DISTINCT question_type FROM named) t)
SELECT topic, question_type, round(avg(coalesce(mean, 0)), 6) AS mean FROM sp LEFT JOIN st USING (student, topic, question_type) GROUP BY ALL""")
def a30(s: SparkSession, d: str) -> DataFrame:
    kinds = s.createDataFrame([(q,) for q in QUESTION_TYPES], "question_type string")
    return reports.topic_type_means(named(attempts(s, d)), topic_levels(s), kinds).select("topic", "question_type", *r6("mean"))


@query("a31_learning_curve", f"{A} SELECT step, count(*) AS students, round(avg(score), 6) AS mean FROM attempts GROUP BY ALL")
def a31(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).groupBy("step").agg(F.count("*").alias("students"), rounded(F.avg("score"), 6).alias("mean"))


@query("j11_prerequisites_met", f"{ALP}, {RUN}, {STATE}, {UNDERSTOOD}, {MET} SELECT student, topic, met FROM met")
def j11(s: SparkSession, d: str) -> DataFrame:
    return m.prerequisites_met(m.sufficient(m.topic_state(attempts(s, d), by_step=True), topic_levels(s)), topic_levels(s), prereqs(s))


def _actions(s: SparkSession) -> DataFrame:
    return trajectory.actions(topic_levels(s).select("topic"), s.createDataFrame([(i, v) for i, v in enumerate(LEVELS)], "d int, difficulty string"), s.createDataFrame([(i, v) for i, v in enumerate(QUESTION_TYPES)], "q int, question_type string"))


@query("f35_valid_actions", f"""{ALP}, {RUN}, {STATE}, {UNDERSTOOD}, {MET}, e AS (SELECT m.student, m.topic, coalesce(top_d, 0) AS td, coalesce(top_q, 0) AS tq FROM met m LEFT JOIN state USING (student, topic) WHERE met)
SELECT student, topic, d, q FROM e, range(3) a(d), range(3) b(q) WHERE (d <= td AND q <= tq) OR (tq < 2 AND d = td AND q = tq + 1) OR (tq >= 2 AND td < 2 AND d = td + 1 AND q = 0)""")
def f35(s: SparkSession, d: str) -> DataFrame:
    state = m.topic_state(attempts(s, d), by_step=True)
    met = m.prerequisites_met(m.sufficient(state, topic_levels(s)), topic_levels(s), prereqs(s))
    return m.valid_actions(state, met, _actions(s).select("topic", F.col("d").cast("long").alias("d"), F.col("q").cast("long").alias("q")))


@query("j16_action_codes", f"""{A}, tp AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS t FROM (SELECT DISTINCT topic FROM attempts))
SELECT student, step, CASE WHEN k % 10 = 0 THEN -1 ELSE t * 9 + d * 3 + q END AS action_id FROM named JOIN tp USING (topic)""")
def j16(s: SparkSession, d: str) -> DataFrame:
    a = named(attempts(s, d)).withColumn("question_type", F.when(F.col("k") % 10 == 0, "other").otherwise(F.col("question_type")))
    return trajectory.encoded(a, _actions(s)).select("student", "step", "action_id")


@query("f34_rewards", f"""{ALP}, {RUN}, {MASTERED}, und AS (SELECT student, step, topic, attempt >= 3 AND running_mean >= {SUFF} AS u FROM mast),
need AS (SELECT m.student, m.step, e.topic AS o, p.prereq FROM mast m JOIN prereqs e ON e.prereq = m.topic JOIN prereqs p ON p.topic = e.topic),
oth AS (SELECT n.student, n.step, n.o, bool_and(coalesce(u.u, false)) AS met FROM need n ASOF LEFT JOIN und u ON n.student = u.student AND n.prereq = u.topic AND n.step >= u.step GROUP BY ALL),
blocked AS (SELECT student, step, count(*) FILTER (NOT met) AS blocked FROM oth GROUP BY ALL), ch AS (SELECT student, step, mastered::INT - coalesce(lag(mastered::INT) OVER (PARTITION BY student, topic ORDER BY step), 0) AS c FROM mast),
mc AS (SELECT student, step, sum(c) OVER (PARTITION BY student ORDER BY step) AS n FROM ch)
SELECT student, step, round((0.6 * score + 0.4 * (score - previous_score)) * CASE d WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 1.2 END, 6) AS simple,
round(score - previous_mean - CASE WHEN score < 0.3 AND attempt > 3 THEN 0.2 ELSE 0 END + 0.5 * CASE WHEN attempt > 5 AND running_mean < 0.2 THEN -0.5 WHEN attempt < 5 THEN 0.7 WHEN trend < 0 THEN 0.4 ELSE 0 END
+ 0.1 * CASE WHEN top_d > before_d OR top_q > before_q THEN 0.2 ELSE 0 END - 0.5 * mastered::INT + 0.2 * 0.2 * running_mean * coalesce(blocked, 0), 5) AS shaped, round(0.6 * (score - running_mean) + 0.4 * n / 5, 6) AS gain FROM mast JOIN mc USING (student, step) LEFT JOIN blocked USING (student, step)""")
def f34(s: SparkSession, d: str) -> DataFrame:
    r = m.gain_rewards(m.shaped_rewards(_mastered(s, d), prereqs(s)), 5)
    return r.select("student", "step", rounded(m.simple_reward(F.col("score"), F.col("previous_score"), F.col("d")), 6).alias("simple"), rounded("shaped", 5).alias("shaped"), rounded("gain_reward", 6).alias("gain"))


@query("f36_level_ladder", f"""{A}, l AS (SELECT student, topic, list(score ORDER BY step) AS x FROM attempts GROUP BY ALL)
SELECT student, topic, list_reduce(list_prepend(0.0::DOUBLE, x), lambda level, v: CASE WHEN v > 0.8 THEN least(level + 1, 2) WHEN v < 0.4 THEN greatest(level - 1, 0) ELSE level END)::INTEGER AS level FROM l""")
def f36(s: SparkSession, d: str) -> DataFrame:
    scores = F.transform(F.array_sort(F.collect_list(F.struct("step", "score"))), lambda x: x["score"])
    return attempts(s, d).groupBy("student", "topic").agg(scores.alias("scores")).select("student", "topic", m.next_level(F.col("scores")).alias("level"))


@query("o7_report_order", f"{A} SELECT topic, round(avg(score), 6) AS mean, row_number() OVER (ORDER BY avg(score) DESC, topic) AS place FROM attempts GROUP BY topic")
def o7(s: SparkSession, d: str) -> DataFrame:
    t = attempts(s, d).groupBy("topic").agg(F.avg("score").alias("mean"))
    return t.select("topic", rounded("mean", 6).alias("mean"), F.row_number().over(W.orderBy(F.desc("mean"), "topic")).alias("place"))  # a row per topic


@query("c7_mastery_replay", f"""{AL}, {RUN}, {MASTERED}, ch AS (SELECT student, step, mastered::INT - coalesce(lag(mastered::INT) OVER (PARTITION BY student, topic ORDER BY step), 0) AS c FROM mast),
mc AS (SELECT student, step, sum(c) OVER (PARTITION BY student ORDER BY step)::BIGINT AS mastered_topics FROM ch)
SELECT student, step, topic, attempt, round(running_mean, 6) AS running_mean, round(trend, 6) AS trend, top_d, top_q, mastered, mastered_topics FROM mast JOIN mc USING (student, step)""")
def c7(s: SparkSession, d: str) -> DataFrame:
    r = _mastered(s, d)
    return r.join(m.mastered_count(r), ["student", "step"]).select("student", "step", "topic", "attempt", *r6("running_mean", "trend"), "top_d", "top_q", "mastered", "mastered_topics")


@query("c10_trajectories", f"""{AL}, {RUN}, tp AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS t FROM (SELECT DISTINCT topic FROM attempts)),
e AS (SELECT student, step, t * 9 + d * 3 + q AS action_id, (0.6 * score + 0.4 * (score - previous_score)) * CASE d WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 ELSE 1.2 END AS reward, previous_mean AS value, (step - 1) // 50 AS ep FROM run JOIN tp USING (topic)),
dl AS (SELECT *, reward + 0.99 * coalesce(lead(value) OVER w, 0) - value AS delta, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY student, ep ORDER BY step))
SELECT student, step, action_id, round(reward, 6) AS reward, round(value, 6) AS value, round(sum(delta * pow(0.891, i)) OVER f / pow(0.891, i), 5) AS advantage, round(sum(reward * pow(0.99, i)) OVER f / pow(0.99, i), 5) AS ret
FROM dl WINDOW f AS (PARTITION BY student, ep ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def c10(s: SparkSession, d: str) -> DataFrame:
    a = named(attempts(s, d))
    t = trajectory.encoded(m.replay(a), _actions(s)).withColumn("reward", m.simple_reward(F.col("score"), F.col("previous_score"), F.col("d"))).withColumn("value", F.col("previous_mean")).withColumn("done", F.col("step") % 50 == 0)
    return trajectory.dataset(t).select("student", "step", "action_id", *r6("reward", "value"), rounded("advantage", 5).alias("advantage"), rounded("ret", 5).alias("ret"))
