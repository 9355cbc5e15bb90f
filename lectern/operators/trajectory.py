"""Offline trajectory data: action codes, batches of answers, discounted returns and advantages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAMMA, LAMBDA, BATCH = 0.99, 0.9, 20


def by_step() -> WindowSpec:
    return W.partitionBy("student").orderBy("step")


def actions(topics: DataFrame, difficulties: DataFrame, kinds: DataFrame) -> DataFrame:
    """Dimension table of all combinations with their code; three small tables."""
    dense = topics.select("topic", (F.row_number().over(W.orderBy("topic")) - 1).alias("t"))  # a dimension table
    kinds_n = kinds.count()
    levels_n = difficulties.count()
    every = F.broadcast(dense).join(F.broadcast(difficulties)).join(F.broadcast(kinds))
    return every.select("topic", "d", "difficulty", "q", "question_type", (F.col("t") * levels_n * kinds_n + F.col("d") * kinds_n + F.col("q")).cast("long").alias("action_id"))


def encoded(rows: DataFrame, coded: DataFrame) -> DataFrame:
    """``rows`` with the code of their topic, difficulty and question type; -1 for an unknown combination."""
    key = ["topic", "difficulty", "question_type"]
    return rows.join(F.broadcast(coded.select(*key, "action_id")), key, "left").withColumn("action_id", F.coalesce("action_id", F.lit(-1).cast("long")))


def batches(attempts: DataFrame, size: int = BATCH) -> DataFrame:
    """A row per ``size`` answers of a student; the rest at the end counts if it holds two or more."""
    b = F.floor((F.col("step") - 1) / size).alias("batch")
    return attempts.groupBy("student", b).agg(F.count("*").alias("answers"), F.avg("score").alias("mean_score")).where("answers >= 2").withColumn("full_batch", F.col("answers") == size)


def _discounted(rows: DataFrame, value: Column, rate: float, keys: list[str], place: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of this and all later values of the keys, each step later times ``rate``.

    Places (from 1) are cut into segments over which the rate's powers fall to about 1e-18. A row needs the sums of its
    own segment and, times a power, that of the next one; what is further off is below the precision of the sum. Powers
    are of the place in the segment, so they do not underflow, and sums run backwards, so that each is the one before it
    and one value more.
    """
    length = max(1, math.ceil(math.log(1e-18) / math.log(rate))) if rate < 1 else 1 << 40
    at = (place - 1) % length
    rows = rows.withColumn("__place", place).withColumn("__at", at).withColumn("__segment", F.floor((place - 1) / length))
    back = W.partitionBy(*keys, "__segment").orderBy(F.desc("__place")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("__own", F.sum(value * F.pow(F.lit(rate), F.col("__at"))).over(back) / F.pow(F.lit(rate), F.col("__at")))
    later = W.partitionBy(*keys).orderBy(F.desc("__place")).rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.last(F.when(F.col("__at") == 0, F.struct("__own", "__segment")), ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__next", start)
    ahead = F.when(F.col("__next.__segment") == F.col("__segment") + 1, F.col("__next.__own") * F.pow(F.lit(rate), length - F.col("__at")))
    return rows.withColumn(name, F.col("__own") + F.coalesce(ahead, F.lit(0.0))).drop("__place", "__at", "__segment", "__own", "__next")


def returns(rows: DataFrame, reward: Column, gamma: float = GAMMA) -> DataFrame:
    """Discounted return from each step on, and standardised over the student's steps."""
    whole = W.partitionBy("student")
    r = _discounted(rows.withColumn("__reward", reward), F.col("__reward"), gamma, ["student"], F.col("step"), "ret").select("student", "step", "ret")
    return r.withColumn("standardised", (F.col("ret") - F.avg("ret").over(whole)) / (F.coalesce(F.stddev_samp("ret").over(whole), F.lit(0.0)) + 1e-8))


def dataset(rows: DataFrame, gamma: float = GAMMA, lam: float = LAMBDA) -> DataFrame:
    """``rows`` (student, step, reward, value, done) with advantage and return, both ending where ``done`` holds.

    Powers are taken of the place within the episode, so that long logs do not underflow.
    """
    before = F.coalesce(F.sum(F.col("done").cast("int")).over(by_step().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = rows.withColumn("episode", before)
    w = W.partitionBy("student", "episode").orderBy("step")
    following = F.when(F.col("done"), 0.0).otherwise(F.coalesce(F.lead("value").over(w), F.lit(0.0)))
    e = e.withColumn("delta", F.col("reward") + gamma * following - F.col("value")).withColumn("place", F.row_number().over(w))
    e = _discounted(e, F.col("delta"), gamma * lam, ["student", "episode"], F.col("place"), "advantage")
    return _discounted(e, F.col("reward"), gamma, ["student", "episode"], F.col("place"), "ret")


def advantages(rows: DataFrame) -> DataFrame:
    return dataset(rows)


def smoothed(attempts: DataFrame, size: int = 50) -> DataFrame:
    """Moving mean of the last ``size`` scores, full windows only."""
    w = by_step().rowsBetween(1 - size, W.currentRow)
    return attempts.select("student", "step", F.avg("score").over(w).alias("smoothed"), F.count("*").over(w).alias("n")).where(F.col("n") == size)
