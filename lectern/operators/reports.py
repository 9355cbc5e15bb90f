"""Reports over graded and reviewed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_sections(rows: DataFrame, keys: list[str], measures: list[Column], overall: bool = True) -> DataFrame:
    """Measures over all rows and by each key, in one pass: columns section, key, and the measures."""
    sets = ([[]] if overall else []) + [[F.col(k)] for k in keys]
    section = F.lit("all")
    for k in reversed(keys):
        section = F.when(F.grouping(k) == 0, k).otherwise(section)
    grouped = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(section.alias("section"), *measures)
    return grouped.select("section", F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("")).alias("key"), *[c for c in grouped.columns if c not in (*keys, "section")])


def last_rows(rows: DataFrame, keys: list[str], order: str, plain: list[str], known: list[str]) -> DataFrame:
    """Per key the last row's ``plain`` columns, and of ``known`` columns the last value that is not null."""
    return rows.groupBy(*keys).agg(
        F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in plain], *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in known]
    )


def tolerant_double(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def tolerant_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def is_true(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)) == "TRUE", F.lit(False))


def log_report(raw: DataFrame, below: float = 0.5) -> DataFrame:
    """Last row per student and topic of a log of strings, with attempts, mean and weakness."""
    t = raw.select("student", "topic", "step", tolerant_double(F.col("score")).alias("score"), is_true(F.col("flag")).alias("flag"))
    return t.groupBy("student", "topic").agg(
        F.max_by("score", "step").alias("last_score"), F.max_by("flag", "step").alias("last_flag"), F.count("*").alias("attempts"), F.avg("score").alias("mean")
    ).withColumn("weak", F.col("mean") < below)


def dashboard(mastery: DataFrame) -> DataFrame:
    mean = F.col("mean")
    return mastery.groupBy("student").agg(
        F.avg("mean").alias("mean_score"), F.count_if("mastered").alias("mastered"), F.sum("attempts").alias("attempts"),
        (100.0 * F.count_if("mastered") / F.count("*")).alias("mastered_pct"),
        F.count_if(mean >= 0.75).alias("strong"), F.count_if((mean >= 0.5) & (mean < 0.75)).alias("medium"), F.count_if(mean < 0.5).alias("weak"),
    )


def cohort(mastery: DataFrame) -> DataFrame:
    each = mastery.groupBy("student").agg((F.sum(F.col("mean") * F.col("attempts")) / F.sum("attempts")).alias("mean"), F.count_if("mastered").alias("mastered"))
    return each.agg(F.count("*").alias("students"), F.avg("mean").alias("mean_of_means"), F.avg("mastered").alias("mastered_mean"), F.stddev_pop("mastered").alias("mastered_std"))


def topic_type_means(attempts: DataFrame, topics: DataFrame, kinds: DataFrame) -> DataFrame:
    """Mean over students of their means by topic and question type; 0 where a student has none."""
    every = attempts.select("student").distinct().join(F.broadcast(topics.select("topic"))).join(F.broadcast(kinds))
    means = attempts.groupBy("student", "topic", "question_type").agg(F.avg("score").alias("own"))
    return every.join(means, ["student", "topic", "question_type"], "left").groupBy("topic", "question_type").agg(F.avg(F.coalesce("own", F.lit(0.0))).alias("mean"))


def recalibrated(rows: DataFrame, key: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Scores stretched linearly between two percentiles of their group, within 0..1."""
    bounds = rows.groupBy(key).agg(F.percentile("score", F.lit(low)).alias("lo"), F.percentile("score", F.lit(high)).alias("hi"))
    s = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return rows.join(F.broadcast(bounds), key).withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def missing(value: Column) -> Column:
    """-1 stands for a missing score."""
    return F.when(value >= 0, value)


def reviewed(judged: DataFrame) -> DataFrame:
    """Reviews with missing scores as null, the gap (positive where the system scored too low) and the agreement."""
    j = missing(F.col("judge_score"))
    return judged.withColumn("judge", j).withColumn("gap", j - F.col("system_score")).withColumn("agreement", 1 - F.abs(F.col("system_score") - j))


def audit(judged: DataFrame, tolerance: float = 0.15) -> list[Column]:
    n = F.count("judge")
    return [
        F.count("*").alias("n"), F.avg("judge").alias("mean_judge"), F.avg(F.when(F.col("judge").isNotNull(), F.col("system_score"))).alias("mean_system"),
        F.avg("gap").alias("mean_gap"), F.avg("agreement").alias("mean_agreement"), F.when(n > 1, F.corr("judge", "system_score")).alias("correlation"),
        (100 * F.avg(F.when(F.col("gap") < -tolerance, 1.0).when(F.col("gap").isNotNull(), 0.0))).alias("over_pct"),
        (100 * F.avg(F.when(F.col("gap") > tolerance, 1.0).when(F.col("gap").isNotNull(), 0.0))).alias("under_pct"),
    ]


def digest(rows: DataFrame, key: str) -> DataFrame:
    """Share of all rows by value of ``key``, in percent."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(F.col(key).alias("value"), "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their place; they are chosen before they are numbered, so one task numbers n rows."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order)))
