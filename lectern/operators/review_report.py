"""The report of a reviewed log, and the digest of a log for a reviewer: tables of section, key, metric, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import reports

QUALITY = ("q_clarity", "q_relevance", "q_difficulty_fit", "q_type_fit")
#: Depths from which an answer counts as deep.
DEEP = 4


def quality(log: DataFrame) -> DataFrame:
    """``log`` with missing quality scores as 0, and ``q_avg``, their mean."""
    scores = [F.coalesce(F.col(c), F.lit(0)) for c in QUALITY]
    return log.withColumns({c: s for c, s in zip(QUALITY, scores)}).withColumn("q_avg", F.round(sum(scores[1:], scores[0]) / len(QUALITY), 2))


def _long(rows: DataFrame, name: str | Column, metrics: list[str]) -> DataFrame:
    section = F.lit(name) if isinstance(name, str) else name
    r = rows.select(section.alias("section"), F.col("key").cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in metrics])
    return r.unpivot(["section", "key"], metrics, "metric", "value").where(F.col("value").isNotNull())


def _pct(test: Column) -> Column:
    return 100.0 * F.count_if(test) / F.count("*")


def last_mastered(log: DataFrame, keys: list[str]) -> DataFrame:
    """How many pairs of student and topic are mastered at their last row, by keys."""
    last = log.groupBy("student_type", "student", "topic").agg(F.max_by("mastered", "step").alias("mastered"))
    return last.groupBy(*keys).agg(F.count_if("mastered").alias("mastered"))


def review_report(log: DataFrame) -> DataFrame:
    """section, key, metric, value of ``log(student, topic, step, difficulty, question_type, student_type, system_score,
    judge_score, hop_depth, the scores of QUALITY, mastered)``.

    quality: means over all, by difficulty and question type. audit: over all and by student type, of rows with a judge's
    score. multihop: over all and by question type, of rows with a depth above 0. students: totals by student type.
    Values that are not defined (a correlation of one row) have no row, and an empty log gives no rows.
    """
    q = quality(log)
    measures = ["q_avg", *QUALITY]
    by_quality = reports.by_sections(q, ["difficulty", "question_type"], [F.avg(c).alias(c) for c in measures])
    rv = reports.reviewed(log).where(F.col("judge").isNotNull())
    audit = reports.by_sections(rv, ["student_type"], reports.audit(rv))
    deep = [F.avg("hop_depth").alias("mean_depth"), _pct(F.col("hop_depth") >= DEEP).alias("deep_pct")]
    hops = reports.by_sections(log.where("hop_depth > 0"), ["question_type"], deep)
    each = log.groupBy("student_type").agg(
        F.count("*").alias("questions"), F.avg("system_score").alias("mean_score"),
        _pct(F.col("difficulty") == "advanced").alias("advanced_pct"), _pct(F.col("question_type") == "evaluative").alias("evaluative_pct"),
    )
    students = each.join(last_mastered(log, ["student_type"]), "student_type").withColumnRenamed("student_type", "key")
    named = lambda name: F.concat(F.lit(f"{name} "), F.col("section"))
    parts = [
        _long(by_quality, named("quality"), measures), _long(audit, named("audit"), [c for c in audit.columns if c not in ("section", "key")]),
        _long(hops, named("multihop"), ["mean_depth", "deep_pct"]), _long(students, "students", ["questions", "mean_score", "advanced_pct", "evaluative_pct", "mastered"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def session_digest(log: DataFrame, top: int = 5) -> DataFrame:
    """student_type, section, key, metric, value: what a reviewer is shown of each kind of student. Totals, shares of
    difficulties and question types in percent, and the ``top`` topics by attempts (ties by name) with attempts, mean
    and mastered."""
    of = F.col("student_type")
    sets = [[of], [of, F.col("difficulty")], [of, F.col("question_type")], [of, F.col("topic")]]
    section = F.when(F.grouping("difficulty") == 0, "difficulty").when(F.grouping("question_type") == 0, "question_type").when(F.grouping("topic") == 0, "topic").otherwise("all")
    counts = log.groupingSets(sets, of, F.col("difficulty"), F.col("question_type"), F.col("topic")).agg(
        section.alias("section"), F.count("*").alias("attempts"), F.avg("system_score").alias("mean"), F.count_distinct("topic").alias("topics")
    )
    counts = counts.withColumn("key", F.coalesce("difficulty", "question_type", "topic", F.lit("")))
    pct = 100.0 * F.col("attempts") / F.max("attempts").over(W.partitionBy("student_type"))
    place = F.row_number().over(W.partitionBy("student_type", "section").orderBy(F.desc("attempts"), "key"))
    counts = counts.withColumn("pct", pct).withColumn("place", place)
    done = last_mastered(log, ["student_type", "topic"])
    done = done.select("student_type", F.lit("topic").alias("section"), F.col("topic").alias("key"), "mastered").unionByName(
        done.groupBy("student_type").agg(F.sum("mastered").alias("mastered")).select("student_type", F.lit("all").alias("section"), F.lit("").alias("key"), "mastered")
    )
    j = counts.join(done, ["student_type", "section", "key"], "left").where((F.col("section") != "topic") | (F.col("place") <= top))
    values = {"attempts": F.col("section").isin("all", "topic"), "mean": F.col("section").isin("all", "topic"), "mastered": F.col("section").isin("all", "topic"), "topics": F.col("section") == "all", "pct": F.col("section").isin("difficulty", "question_type")}
    r = j.select("student_type", "section", "key", *[F.when(test, F.col(c)).cast("double").alias(c) for c, test in values.items()])
    return r.unpivot(["student_type", "section", "key"], list(values), "metric", "value").where(F.col("value").isNotNull())
